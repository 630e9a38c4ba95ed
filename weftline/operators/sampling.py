"""Samples of a token store: permuted document choice, padding, block masks, triplets and targets.

The order of samples is a computed permutation, so nothing is sorted or shuffled to randomise it; the one shuffle is
the join of slots with the ordinals of valid documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import slot, uniform_array
from weftline.operators.ranks import ranked

IGNORE = -100


def raw_length(ctx_len: int, block: int) -> int:
    """Tokens of a document that fit into a sample of masked, masked and clean copies."""
    return ctx_len // (3 * block) * block


def sampled_documents(samples: DataFrame, valid: DataFrame, p: int, number: str = "ii") -> DataFrame:
    """``(ii, slot, doc_id)``: the document of each sample; ``valid`` holds the documents that pass the length filter."""
    numbered = ranked(valid.select("doc_id"), [], ["doc_id"], "slot").select("doc_id", F.col("slot").cast("bigint"))
    return samples.select(number, slot(F.col(number), p).alias("slot")).join(numbered, "slot").select(number, "slot", "doc_id")


def flat_window_parts(sizes: DataFrame, ctx_len: int) -> DataFrame:
    """``(win, doc_id, doc_from, doc_to)``: documents under each window ``[i*ctx, i*ctx + ctx + 1)`` of the flat stream.

    The windows that a document meets follow from its offset, so it is exploded to them instead of being compared
    with all windows.
    """
    placed = ranked(sizes, [], ["doc_id"], total=F.col("size"), total_name="start").select("doc_id", "size", "start")
    end = F.col("start") + F.col("size")
    first = F.greatest(F.expr(f"(start - {ctx_len} - 1) div {ctx_len}"), F.lit(0))
    met = placed.select("doc_id", "size", "start", F.explode(F.sequence(first, F.expr(f"(start + size - 1) div {ctx_len}"))).alias("win"))
    windows = F.floor(F.coalesce(sizes.agg(F.sum("size")).scalar(), F.lit(0)) / ctx_len)
    lo, hi = F.col("win") * ctx_len, F.col("win") * ctx_len + ctx_len + 1
    inside = met.where((F.col("win") < windows) & (F.col("start") < hi) & (end > lo))
    return inside.select("win", "doc_id", (F.greatest("start", lo) - F.col("start")).alias("doc_from"), (F.least(end, hi) - F.col("start")).alias("doc_to"))


#: Positions assembled at a time, which bounds the memory of a task; a longer document is assembled alone.
PIECE = 1 << 18
_INPUT = {"doc_id": "bigint", "tokens": "array<int>", "lossable": "array<tinyint>"}


def _pieces(batches: Iterator[pa.RecordBatch], block: int, blocks: int | None, epoch: int, r_min: float, r_max: float, p_full: float, force_eos: bool, force_pad: bool, eos: int, pad: int, mask: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, blocks of each document, and by block: its number, ``masked``, ``x`` and ``y``.

    A document is cut or filled to ``blocks``, or with None held in as many as it needs.
    """
    for b in batches:
        sizes = np.diff(b.column(1).offsets.to_numpy()).astype(np.int64)
        each = -(-sizes // block) if blocks is None else np.full(len(b), blocks)
        ends = np.cumsum(each * block)
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")))
            ids, count = b.column(0).slice(lo, hi - lo), each[lo:hi]
            first = np.cumsum(count) - count
            clean, lossable = np.full((count.sum(), block), pad, np.int32), np.zeros((count.sum(), block), bool)
            for column, out in ((b.column(1), clean), (b.column(2), lossable)):
                start, values = column.offsets.to_numpy()[lo : hi + 1], column.values.to_numpy(zero_copy_only=False)
                held = np.minimum(np.diff(start), count * block)
                inner = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                out.reshape(-1)[np.repeat(first * block, held) + inner] = values[np.repeat(start[:-1], held) + inner]
            doc, number = np.repeat(ids.to_numpy(), count), np.arange(count.sum()) - np.repeat(first, count)
            ratio = r_min + (r_max - r_min) * uniform_array(doc, epoch, number, 1)
            ratio = np.where(uniform_array(doc, epoch, number, 2) < p_full, 1.0, ratio)
            masked = (uniform_array(doc[:, None], epoch, number[:, None] * block + np.arange(block), 3) < ratio[:, None]) & lossable
            ends_here = clean == eos
            if force_eos:
                masked |= ends_here
            if force_pad:
                masked |= (clean == pad) & ends_here.any(axis=1, keepdims=True)
            noisy = np.where(masked, mask, clean).astype(np.int32)
            y = np.full((len(clean), 3, block), IGNORE, np.int32)
            y[:, 1] = np.where(masked & (clean != pad), clean, IGNORE)
            yield ids, count, number, masked, np.stack([noisy, noisy, clean], axis=1), y
            lo = hi


def _checked(docs: DataFrame, eos: int, pad: int) -> DataFrame:
    if pad == eos:
        raise ValueError("padding and end token must differ")
    return docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in _INPUT.items()])


def assemble(docs: DataFrame, ctx_len: int | None, block: int, epoch: int = 0, r_min: float = 0.0, r_max: float = 1.0, p_full: float = 0.1, force_eos: bool = True, force_pad: bool = True, eos: int = 0, pad: int = 65534, mask: int = 65535) -> DataFrame:
    """``(doc_id, masked, x, y)`` of ``docs(doc_id, tokens, lossable)``.

    Each block draws its own mask ratio, and with ``p_full`` it is 1.  Lossable positions are masked by that ratio;
    end tokens always, and so is the padding in a block with an end token.  ``x`` holds two masked copies and the
    clean one of each block, ``y`` the clean token at masked positions of the second copy that are no padding,
    -100 elsewhere.  All draws are functions of document, epoch and position.

    A document is cut or filled to what ``ctx_len`` holds; drop longer ones before, or give None: then each document
    is held whole in as many blocks as it needs.  Blocks that both have are equal.
    """
    raw = None if ctx_len is None else raw_length(ctx_len, block)
    schema = pa.schema([("doc_id", pa.int64()), ("masked", pa.list_(pa.bool_())), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))])

    def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.reshape(-1), kind))

    def filled(values: np.ndarray, n: int, fill: int) -> np.ndarray:
        return values if ctx_len is None else np.pad(values.reshape(n, 3 * raw), ((0, 0), (0, ctx_len - 3 * raw)), constant_values=fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, count, _, masked, x, y in _pieces(batches, block, None if raw is None else raw // block, epoch, r_min, r_max, p_full, force_eos, force_pad, eos, pad, mask):
            n = len(ids)
            sizes = 3 * count * block if ctx_len is None else np.full(n, ctx_len)
            yield pa.RecordBatch.from_arrays([ids, lists(masked, count * block, pa.bool_()), lists(filled(x, n, pad), sizes, pa.int32()), lists(filled(y, n, IGNORE), sizes, pa.int32())], schema=schema)

    return _checked(docs, eos, pad).mapInArrow(run, "doc_id bigint, masked array<boolean>, x array<int>, y array<int>")


def block_sums(docs: DataFrame, block: int, ctx_len: int | None = None, epoch: int = 0, r_min: float = 0.0, r_max: float = 1.0, p_full: float = 0.1, force_eos: bool = True, force_pad: bool = True, eos: int = 0, pad: int = 65534, mask: int = 65535) -> DataFrame:
    """Sums of every block as ``assemble(docs, ctx_len, block)`` builds them, of whole documents without ``ctx_len``, a row a block.

    ``(doc_id, block, n_masked, places, has_eos, padding, total, weighted, supervised, targets)``: masked positions and
    the sum of their places from 1 on; the clean tokens' sum; the sums of each of the three copies and of the targets,
    each token times its place.  The samples themselves do not leave the task.
    """
    place = np.arange(1, block + 1)
    kinds = {"doc_id": pa.int64(), "block": pa.int32(), "n_masked": pa.int64(), "places": pa.int64(), "has_eos": pa.bool_(), "padding": pa.int64(), "total": pa.int64(), "weighted": pa.list_(pa.int64()), "supervised": pa.int64(), "targets": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, count, number, masked, x, y in _pieces(batches, block, None if ctx_len is None else raw_length(ctx_len, block) // block, epoch, r_min, r_max, p_full, force_eos, force_pad, eos, pad, mask):
            clean, told = x[:, 2], y != IGNORE
            weighted = (x * place.astype(np.int64)).sum(axis=2)
            three = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * 3), pa.array(weighted.reshape(-1)))
            sums = [np.repeat(ids.to_numpy(), count), number.astype(np.int32), masked.sum(axis=1), masked @ place, (clean == eos).any(axis=1), (clean == pad).sum(axis=1), clean.sum(axis=1, dtype=np.int64), three, told.sum(axis=(1, 2)), (np.where(told, y, 0) * place.astype(np.int64)).sum(axis=(1, 2))]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in sums], schema=schema)

    return _checked(docs, eos, pad).mapInArrow(run, "doc_id bigint, block int, n_masked bigint, places bigint, has_eos boolean, padding bigint, total bigint, weighted array<bigint>, supervised bigint, targets bigint")
