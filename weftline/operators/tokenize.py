"""Greedy longest-match tokenization.

Small vocabularies of text pieces stay inside Catalyst: an alternation with the longest piece first matches as
greedily as a trie does.  Real vocabularies of byte strings use a trie in an Arrow UDF, built once in a worker.
Segments are tokenized one by one, as a match never crosses their border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Ids with a role of their own: end of a document, padding and mask.
EOS, PAD, MASK = 0, 65534, 65535


def pieces_pattern(pieces: list[str]) -> str:
    """A pattern that cuts a text into pieces and single characters, longest piece first."""
    longest = sorted(dict.fromkeys(p for p in pieces if p), key=lambda p: (-len(p), p))
    return "|".join([*map(re.escape, longest), "(?s:.)"])


def cut(text: Column, pieces: list[str]) -> Column:
    """Pieces of a text in order."""
    return F.regexp_extract_all(text, F.lit(pieces_pattern(pieces)), F.lit(0))


class Trie:
    """Greedy longest-match encoder over the bytes of a text.

    With ``ahocorasick`` installed its automaton finds the leftmost longest tokens; bytes are its characters.  Without
    it a trie of nested dictionaries does, in which ``None`` holds the id of a node that ends a token.
    """

    def __init__(self, vocab: dict[int, bytes], native: bool = True):
        self.automaton = None
        if native and ahocorasick is not None and vocab:
            self.automaton = ahocorasick.Automaton()
            for token_id, token in vocab.items():
                if token:
                    self.automaton.add_word(token.decode("latin-1"), (token_id, len(token)))
            self.automaton.make_automaton()
            return
        self.root: dict = {}
        for token_id, token in vocab.items():
            node = self.root
            for byte in token:
                node = node.setdefault(byte, {})
            node[None] = token_id

    def encode(self, data: bytes) -> list[int]:
        if self.automaton is not None:
            found = [v for _, v in self.automaton.iter_long(data.decode("latin-1"))]
            if sum(n for _, n in found) != len(data):
                raise ValueError("some bytes begin no token")
            return [i for i, _ in found]
        out, at = [], 0
        while at < len(data):
            node, best, end = self.root, None, at
            for i in range(at, len(data)):
                node = node.get(data[i])
                if node is None:
                    break
                if None in node:
                    best, end = node[None], i + 1
            if best is None:
                raise ValueError(f"no token begins with byte {data[at]} at {at}")
            out.append(best)
            at = end
        return out


class Table:
    """The plain twin of ``Trie``: tokens by their first byte, longest first, of equal ones the last, tried one after another."""

    def __init__(self, vocab: dict[int, bytes]):
        self.by_first: dict[int, list[tuple[bytes, int]]] = {}
        for token_id, token in sorted(reversed(vocab.items()), key=lambda x: -len(x[1])):
            if token:
                self.by_first.setdefault(token[0], []).append((token, token_id))

    def encode(self, data: bytes) -> list[int]:
        out, at = [], 0
        while at < len(data):
            found = next(((t, i) for t, i in self.by_first.get(data[at], ()) if data.startswith(t, at)), None)
            if found is None:
                raise ValueError(f"no token begins with byte {data[at]} at {at}")
            out.append(found[1])
            at += len(found[0])
        return out


def encoder(vocab: dict[int, bytes], plain: bool = False):
    """A UDF from text to ids, by a trie or plainly by a table; null gives null."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Table(vocab) if plain else Trie(vocab)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else trie.encode(t.encode()))

    return encode


def decode_ids(ids, vocab: dict[int, bytes]) -> str:
    """Strict: an id without a token and bytes that are no text are errors."""
    return b"".join(vocab[int(i)] for i in ids).decode("utf-8")


def _decode_run(ids: list[int], vocab: dict[int, bytes]) -> str:
    for keep in range(len(ids), -1, -1):
        try:
            text = decode_ids(ids[:keep], vocab)
        except (KeyError, UnicodeDecodeError):
            continue
        lost = len(ids) - keep
        if keep == 0 and lost and ids:
            return f"<undecodable tail x{lost}>"
        return text + (f"<undecodable tail x{lost}>" if lost else "")
    return f"<undecodable x{len(ids)}>"


def safe_decode_ids(ids, vocab: dict[int, bytes], special: frozenset[int] = frozenset({PAD, MASK})) -> str:
    """Without special ids if that is text; else runs between them, whose undecodable ends are counted."""
    ids = [int(i) for i in ids]
    try:
        return decode_ids([i for i in ids if i not in special], vocab)
    except (KeyError, UnicodeDecodeError):
        pass
    out: list[str] = []
    run: list[int] = []
    for i in [*ids, None]:
        if i is None or i in special:
            if run:
                out.append(_decode_run(run, vocab))
                run = []
            if i is not None:
                out.append(f"<{i}>")
        else:
            run.append(i)
    return "".join(out)


def decoder(vocab: dict[int, bytes], safe: bool = False):
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else (safe_decode_ids if safe else decode_ids)(x, vocab))

    return decode


def emitted_ids(ids, vocab: dict[int, bytes]) -> list[str]:
    """What an incremental printer shows after each token: the held-back bytes once they are whole characters."""
    out, held = [], b""
    for i in ids:
        held += vocab[int(i)]
        try:
            text = held.decode("utf-8")
        except UnicodeDecodeError:
            text = ""
        if text and "�" not in text:
            out.append(text)
            held = b""
        else:
            out.append("")
    return out


def emitter(vocab: dict[int, bytes]):
    """A UDF from ids to what is shown after each of them."""

    @F.pandas_udf("array<string>")
    def emit(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else emitted_ids(x, vocab))

    return emit


def token_streams(df: DataFrame, segments: str, vocab: dict[int, bytes], append_eos: bool = True) -> DataFrame:
    """Add ``tokens`` and ``lossable``, two arrays of one length, of a segment array.

    Empty segments add nothing; the end token is not lossable.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(vocab)
        for rows in batches:
            tokens, bits = [], []
            for row in rows:
                t: list[int] = []
                b: list[int] = []
                for s in row if row is not None else ():
                    if s["text"]:
                        ids = trie.encode(s["text"].encode())
                        t += ids
                        b += [int(bool(s["lossable"]))] * len(ids)
                if append_eos:
                    t.append(EOS)
                    b.append(0)
                tokens.append(t)
                bits.append(b)
            yield pd.DataFrame({"tokens": tokens, "lossable": bits})

    stream = F.pandas_udf(run, "tokens array<int>, lossable array<tinyint>")
    return df.withColumn("__stream", stream(F.col(segments))).select("*", "__stream.tokens", "__stream.lossable").drop("__stream")
