"""Packing texts into containers of fixed capacity by large-item matching.

Sizes are whole numbers up to the capacity, so the plan is made on the histogram of sizes, a table of at most
``capacity`` rows however many texts there are:

1. Items above a third of the capacity: at most two fit into a container.  From the largest down, each is matched
   with the largest other such item that still fits; equal pairs are handled as runs of containers.
2. Smaller items, from the largest down, go where they leave the smallest gap (best fit), again by runs; what finds
   no gap opens new containers.

The plan maps ranks within a size to containers, so items are placed by their rank without being gathered.
A text larger than the capacity is cut into full containers and one remainder, no other text is cut.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranks import ranked
from weftline.session import spread, staged

#: A public byte-level vocabulary, one base64 token and its rank a line, and the pattern that cuts texts into words.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    key = hash((vocabulary, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens)`` once for each id; a null text has no tokens."""
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, pattern)
        for b in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], schema=schema)

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return spread(src).mapInArrow(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots ``(size, first rank, items a container, first container, start in it)`` by size and rank; number of containers."""
    slots: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    gaps: list[int] = []  # sorted; runs[gap]: (first container, containers)
    runs: dict[int, list[tuple[int, int]]] = {}
    containers = 0

    def put(size: int, each: int, first: int, many: int, start: int) -> None:
        slots.append((size, used[size], each, first, start))
        used[size] += each * many

    def leave(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, many))

    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        at = bisect_left(large, capacity - s + 1) - 1
        if at < 0 or (large[at] == s and left[s] < 2):
            at -= at >= 0 and large[at] == s
        if at < 0:
            many = left[s]
            put(s, 1, containers, many, 0)
            leave(capacity - s, containers, many)
            left[s] = 0
        else:
            t = large[at]
            many = left[s] // 2 if t == s else min(left[s], left[t])
            put(s, 2 if t == s else 1, containers, many, 0)
            if t != s:
                put(t, 1, containers, many, s)
                left[t] -= many
            left[s] -= many * (2 if t == s else 1)
            leave(capacity - s - t, containers, many)
            if t != s and not left[t]:
                large.pop(at)
        containers += many
        if not left[s]:
            large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                each = capacity // s
                many = -(-n // each)
                leave(capacity, containers, many)
                containers += many
                continue
            gap = gaps[at]
            first, many = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            each = gap // s
            full = min(many, n // each)
            if full:
                put(s, each, first, full, capacity - gap)
                leave(gap - each * s, first, full)
                n -= full * each
                first, many = first + full, many - full
            if many and n:  # fewer than ``each`` are left
                put(s, n, first, 1, capacity - gap)
                leave(gap - n * s, first, 1)
                n, first, many = 0, first + 1, many - 1
            leave(gap, first, many)
    return np.array(sorted(slots), np.int64).reshape(-1, 5), containers


def pack(sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``(spec_id, container_id, doc_id, piece, start, doc_start, n_tokens)``: where each text or piece lies.

    Every text comes once for each distinct spec with a positive capacity, in ``ceil(size / capacity)`` pieces.
    Texts of size 0 take no room: one row with a null container.  Null ids, null sizes and null specs are left
    out; equal rows count once; empty tables give an empty result.
    """
    spec = specs.where("spec_id is not null and capacity > 0").groupBy("spec_id").agg(F.max("capacity").cast("bigint").alias("capacity"))
    caps = dict(sorted((int(r["spec_id"]), int(r["capacity"])) for r in spec.collect()))
    spark = sizes.sparkSession
    out_schema = "spec_id int, container_id bigint, doc_id bigint, piece int, start bigint, doc_start bigint, n_tokens bigint"
    once = sizes.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(size_col).cast("bigint").alias("n")).where("doc_id is not null and n is not null").distinct()
    if not caps:
        return spark.createDataFrame([], out_schema)
    spec_rows = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in caps.items()])).alias("spec")
    each = once.select("doc_id", "n", spec_rows).select("doc_id", "n", "spec.*")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1, F.lit(0))
    pieces = each.select("spec_id", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    doc_start = F.col("piece") * F.col("capacity")
    items = staged(pieces.select("spec_id", "doc_id", "piece", doc_start.alias("doc_start"), F.least(F.col("capacity"), F.col("n") - doc_start).alias("size")), "pack-items")
    # at most one row for each spec and size up to its capacity
    histogram = items.where("size > 0").groupBy("spec_id", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    plans = {s: plan({int(r["size"]): int(r["n"]) for r in histogram if r["spec_id"] == s}, c)[0] for s, c in caps.items()}
    shared = spark.sparkContext.broadcast(plans)
    order = ranked(items.where("size > 0"), ["spec_id", "size"], ["doc_id", "piece"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {f.name: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(b.schema)}
            container, start = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for s, slots in shared.value.items():
                rows = np.flatnonzero(c["spec_id"] == s)
                if not len(rows):
                    continue
                size, rank = c["size"][rows], c["rank"][rows]
                width = int(max(slots[:, 1].max(), rank.max())) + 1
                at = np.searchsorted(slots[:, 0] * width + slots[:, 1], size * width + rank, side="right") - 1
                of = slots[at]
                nth = rank - of[:, 1]
                container[rows] = of[:, 3] + nth // of[:, 2]
                start[rows] = of[:, 4] + nth % of[:, 2] * size
            cols = [pa.array(c["spec_id"], pa.int32()), pa.array(container), pa.array(c["doc_id"]), pa.array(c["piece"], pa.int32()), pa.array(start), pa.array(c["doc_start"]), pa.array(c["size"])]
            yield pa.RecordBatch.from_arrays(cols, names=["spec_id", "container_id", "doc_id", "piece", "start", "doc_start", "n_tokens"])

    placed = order.select("spec_id", "doc_id", "piece", "doc_start", "size", F.col("rank").cast("bigint").alias("rank")).mapInArrow(place, out_schema)
    null = F.lit(None).cast("bigint")
    empty = items.where("size <= 0").select("spec_id", null.alias("container_id"), "doc_id", "piece", null.alias("start"), "doc_start", F.col("size").alias("n_tokens"))
    return placed.unionByName(empty)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, capacity, containers, tokens, fewest, fill)``: use of the containers; ``fewest`` is the bound by total size."""
    used = packed.where("container_id is not null").groupBy("spec_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    out = used.join(specs.groupBy("spec_id").agg(F.max("capacity").cast("bigint").alias("capacity")), "spec_id")
    return out.select("spec_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))


def invariants(packed: DataFrame, sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """What must hold of a packing, counted where it does not: ``(spec_id, texts, overfull, overlapping, needless_cuts, incomplete)``.

    Containers with more than their capacity, pieces that begin before the one before them ends, texts in more than
    ``ceil(size / capacity)`` pieces, and texts whose pieces are not each of their tokens once.
    """
    capacity = specs.where("spec_id is not null and capacity > 0").groupBy("spec_id").agg(F.max("capacity").cast("bigint").alias("capacity"))
    held = packed.join(F.broadcast(capacity), "spec_id")  # one row a spec
    inside = Window.partitionBy("spec_id", "container_id").orderBy("start")
    # a container holds at most its capacity of pieces
    placed = held.where("container_id is not null").withColumn("before", F.lag(F.col("start") + F.col("n_tokens"), 1, 0).over(inside))
    room = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count_if(F.col("start") < F.col("before")).alias("overlapping"), F.first("capacity").alias("capacity"))
    rooms = room.groupBy("spec_id").agg(F.count_if(F.greatest("used", "end") > F.col("capacity")).alias("overfull"), F.sum("overlapping").alias("overlapping"))
    once = sizes.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(size_col).cast("bigint").alias("n")).where("doc_id is not null and n is not null").distinct()
    pieces = held.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different"), F.sum("n_tokens").alias("tokens"), F.sum("doc_start").alias("starts"), F.first("capacity").alias("capacity"))
    texts = pieces.join(once, "doc_id", "full")
    needed = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1))
    whole = (F.col("tokens") == F.col("n")) & (F.col("different") == F.col("pieces")) & (F.col("starts") * 2 == F.col("capacity") * F.col("pieces") * (F.col("pieces") - 1))
    docs = texts.groupBy("spec_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("pieces") != needed).alias("needless_cuts"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("incomplete"))
    return docs.join(rooms, "spec_id", "left").select("spec_id", "texts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("overfull", "overlapping", "needless_cuts", "incomplete")])
