"""Vocabulary files: one token a line, ``id repr(token) byte_length``."""

from __future__ import annotations

import ast
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def parse_line(line: str) -> tuple[int, bytes]:
    """Id and bytes of a line; literals are parsed, never evaluated; a wrong length is an error."""
    first, last = line.index(" "), line.rindex(" ")
    token = ast.literal_eval(line[first:last].strip())
    token = token.encode() if isinstance(token, str) else token
    if not isinstance(token, bytes):
        raise ValueError(f"not a token: {line!r}")
    if len(token) != int(line[last:]):
        raise ValueError(f"declared length differs from the token's: {line!r}")
    return int(line[:first]), token


def format_line(token_id: int, token: bytes) -> str:
    try:
        text = repr(token.decode())
    except UnicodeDecodeError:
        text = repr(token)
    return f"{token_id} {text} {len(token)}"


def parse(lines: Iterable[str]) -> dict[int, bytes]:
    return dict(parse_line(line.rstrip("\n")) for line in lines if line.strip())


def read(path: str) -> dict[int, bytes]:
    with open(path, encoding="utf-8") as f:
        return parse(f)


def size(vocab: dict[int, bytes]) -> int:
    """Largest id plus one."""
    return max(vocab) + 1


def frame(spark: SparkSession, vocab: dict[int, bytes]) -> DataFrame:
    """``(token_id, token)``; a vocabulary is of bounded size."""
    return spark.createDataFrame(sorted(vocab.items()), "token_id int, token binary")


def byte_vocab(pieces: Iterable[str] = ()) -> dict[int, bytes]:
    """A small vocabulary: id 0 has no entry and ends documents, 1 to 256 are the single bytes, then ``pieces``."""
    vocab = {b + 1: bytes([b]) for b in range(256)}
    return vocab | {257 + i: p.encode() for i, p in enumerate(pieces)}
