"""Near-duplicate texts by signature trees.

Texts are sets of hashed word runs.  Exact copies (equal sets) are one class.  Between classes all pairs with
Jaccard similarity of at least the threshold are found, none lost:

1. Texts are packed into blocks of about ``BLOCK_RUNS`` runs, 6 bytes a run; copies within a block are one class there,
   the others are matched by the digest of their runs, without moving the runs.
2. Runs are ordered by rarity: by the binary logarithm of their number of classes, then by hash.  To learn it a block sends each
   of its distinct runs once, with a count, to the bucket of the run's leading bits, and gets one byte back for it.
   However hot a run is, it costs a block one entry.
3. A pair above the threshold shares a run among the ``n - ceil(t*n) + 1`` rarest of both, so a class goes to the
   cells of those runs only.  Runs of one class need no cell.
4. Cells arrive sorted by run and are gathered into signature trees of about ``CELL`` rows.  Rows are the lowest nodes; each
   node holds the OR of two token bitmaps below it, of the runs its rows were routed by and of all runs that
   other classes have too, the range of its sizes and the most runs that remain from the routing run on.  A dual
   traversal of the tree with itself drops a pair of nodes whose largest possible overlap of routing runs is
   zero or whose largest possible overlap of all runs (shared bits, bits that collide, remaining runs) is below
   the smallest that the threshold needs at these sizes.
5. Pairs of rows that survive are made distinct and counted exactly on the whole sets.

The cell of a run that may have more than ``block`` classes is cut by salts into a triangle of sub-cells, each of about two
blocks, in which only rows of different salts meet (on the diagonal, of the same); no task holds more of a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.groups import pairs_within
from weftline.llm.words import distinct_runs, words_of
from weftline.session import spread, staged

#: Bits of a run's hash: two runs of a pair of texts of 100 runs coincide with a probability below 1e-10.
RUN_BITS = 48
#: Runs of a block of texts and of a bucket of the count, and rows of a tree.
BLOCK_RUNS, BUCKET_RUNS, CELL = 1 << 17, 1 << 22, 1 << 12
#: Texts hashed together.
TOGETHER = 512
#: Bits of the bitmaps of all shared runs and of routing runs, as 64-bit words.
WORDS, ROUTES = 2, 8
#: Children of a node.
FANOUT = 8
#: Rows of a table that may be broadcast: at most 40 bytes each.
SMALL = 1 << 20
#: Runs of a collection whose rarities may be broadcast, one byte each.
SMALL_RUNS = 1 << 26
EPS = 1e-9
_PLACE = 17  # bits of a class's place in its block; at most 65,536 classes lie in one


def need(na, nb, t: float):
    """Smallest overlap that two sets of these sizes must have."""
    return np.ceil(t / (1 + t) * (na + nb) - EPS)


def _packed(runs: np.ndarray) -> tuple[bytes, bytes]:
    return runs.astype("<u4").tobytes(), (runs >> np.uint64(32)).astype("<u2").tobytes()


def _unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_BLOCKS = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("place", pa.binary()), ("keys", pa.binary()), ("first", pa.binary()), ("n", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _blocks(min_words: int, k: int):
    mask = np.uint64((1 << RUN_BITS) - 1)

    def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Each text that is long enough, with its distinct runs."""
        for whole in batches:
            for lo in range(0, len(whole), TOGETHER):
                b = whole.slice(lo, TOGETHER)
                words = [words_of(t) for t in b.column(1).to_pylist()]
                use = [j for j, w in enumerate(words) if len(w) >= max(min_words, k)]
                if use:
                    ids = b.column(0).to_pylist()
                    yield from zip([ids[j] for j in use], distinct_runs([words[j] for j in use], k, mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, place, known, first, runs, size = [], [], {}, [], [], 0

        def packed() -> pa.RecordBatch:
            low, high = _packed(np.concatenate(runs))
            arrays = (np.array(ids, "<i8"), np.array(place, "<i4"), np.array(first, "<i8"), np.array([len(r) for r in runs], "<i4"))
            a, b, c, d = (x.tobytes() for x in arrays)
            return _batch(_BLOCKS, [block], [size], [a], [b], [b"".join(known)], [c], [d], [low], [high])

        for i, h in _runs(batches):
            key = xxhash.xxh3_128_digest(h.tobytes())
            at = known.get(key)
            if at is None:
                at = known[key] = len(runs)
                first.append(i)
                runs.append(h)
                size += len(h)
            first[at] = min(first[at], i)
            ids.append(i)
            place.append(at)
            if size >= BLOCK_RUNS or len(ids) >= 1 << 16:
                yield packed()
                block += 1
                ids, place, known, first, runs, size = [], [], {}, [], [], 0
        if ids:
            yield packed()

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, key, loc)`` of every text; ``loc`` numbers the classes of all blocks."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("loc", pa.int64())])
    for b in batches:
        for block, ids, place, keys in zip(*(b.column(i).to_pylist() for i in range(4))):
            at = np.frombuffer(place, "<i4").astype(np.int64)
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys) // 16, [None, pa.py_buffer(keys)]).take(pa.array(at)).cast(pa.binary())
            yield _batch(schema, pa.array(np.frombuffer(ids, "<i8")), key, pa.array((block << _PLACE) + at))


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(loc, cid, n, runs)`` of every class of a block; ``cid`` is its smallest id."""
    schema = pa.schema([("loc", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("runs", pa.list_(pa.int64()))])
    for b in batches:
        for block, first, n, low, high in zip(*(b.column(i).to_pylist() for i in range(5))):
            n, runs = np.frombuffer(n, "<i4"), _unpacked(low, high).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(runs))
            yield _batch(schema, pa.array((block << _PLACE) + np.arange(len(n))), pa.array(np.frombuffer(first, "<i8")), pa.array(n), lists)


_COUNTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())])
_RARITY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("rarity", pa.binary())])


def _counts(buckets: int):
    """The distinct runs of each block with their number of classes there, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, low, high in zip(*(b.column(i).to_pylist() for i in range(3))):
                runs, n = np.unique(_unpacked(low, high), return_counts=True)
                bucket = ((runs >> np.uint64(RUN_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                low_high = [_packed(r) for r in np.split(runs, at[1:])]
                parts = [np.minimum(x, 0xFFFF).astype("<u2").tobytes() for x in np.split(n, at[1:])]
                yield _batch(_COUNTS, bucket[at], [block] * len(at), [x[0] for x in low_high], [x[1] for x in low_high], parts)

    return run


def _rarity(t: pa.Table) -> pa.Table:
    """The binary logarithm of the number of classes of each run, in the order in which the blocks sent them.  Of one
    bucket: an entry for each block that has the run."""
    low, high, n = ([*t.column(c).to_pylist()] for c in ("low", "high", "n"))
    _, at = np.unique(_unpacked(b"".join(low), b"".join(high)), return_inverse=True)
    df = np.bincount(at, weights=np.frombuffer(b"".join(n), "<u2"))[at]
    log = np.floor(np.log2(df)).astype(np.uint8)
    parts = np.split(log, np.cumsum([len(x) // 4 for x in low])[:-1])
    return pa.Table.from_arrays([t.column("block"), t.column("bucket"), pa.array([p.tobytes() for p in parts], pa.binary())], schema=_RARITY)


#: Rows of cells; ``counts`` holds the size (27 bits), the remaining runs and the surplus (18 bits each).  The last two are bounds:
#: the greatest value that fits stands for any number.
_ROWS = pa.schema([("run", pa.int64()), ("rarity", pa.int32()), ("loc", pa.int64()), ("counts", pa.int64()), *((f"b{i}", pa.int64()) for i in range(WORDS))])
_BITS = 18


def _joined(n: np.ndarray, rem: np.ndarray, surplus: np.ndarray) -> np.ndarray:
    most = (1 << _BITS) - 1
    return n << 2 * _BITS | np.minimum(rem, most) << _BITS | np.minimum(surplus, most)


def _parted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    most = (1 << _BITS) - 1
    bound = lambda x: np.where(x == most, 1 << 40, x)
    return counts >> 2 * _BITS, bound(counts >> _BITS & most), bound(counts & most)


def _routed(t: float):
    """The rows of the necessary prefixes of the classes of each block, by what the buckets told it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n, low, high, told, places in zip(*(b.column(i).to_pylist() for i in range(6))):
                yield rows(block, np.frombuffer(n, "<i4").astype(np.int64), _unpacked(low, high), told or [], places or [])

    def rows(block: int, n: np.ndarray, runs: np.ndarray, told: list[dict], places: list[int]) -> pa.RecordBatch:
        _, at = np.unique(runs, return_inverse=True)
        log = np.frombuffer(b"".join(x["rarity"] for x in sorted(told, key=lambda x: x["bucket"])), np.uint8)[at]
        here = np.ones(len(n), bool)
        here[places] = False  # classes of another block
        own = np.repeat(np.arange(len(n)), n)
        use = np.flatnonzero((log > 0) & here[own])
        use = use[np.lexsort((runs[use], log[use], own[use]))]
        own, log, runs = own[use], log[use], runs[use]
        held = np.bincount(own, minlength=len(n))
        bits = np.zeros((len(n), WORDS), np.uint64)
        np.bitwise_or.at(bits.reshape(-1), own * WORDS + ((runs >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (runs & np.uint64(63)))
        surplus = held - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        pos = np.arange(len(own)) - (np.cumsum(held) - held)[own]
        cut = np.flatnonzero(pos < held[own] - np.ceil(t * n[own] - EPS) + 1)
        own, pos = own[cut], pos[cut]
        cols = [runs[cut].astype(np.int64), log[cut], (block << _PLACE) + own, _joined(n[own], held[own] - pos, surplus[own]), *bits[own].view(np.int64).T]
        return _batch(_ROWS, *(pa.array(np.ascontiguousarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _ROWS)))

    return run


def _max_overlap(bits_a, bits_b, sur_a, sur_b, rem_a, rem_b):
    shared = np.bitwise_count(bits_a & bits_b).sum(axis=1).astype(np.int64)
    return np.minimum(shared + np.minimum(sur_a, sur_b), np.minimum(rem_a, rem_b))


class Tree:
    """Signature tree over rows in order.  A level holds, for each node, the OR of the bitmaps of routing runs and of all shared
    runs, least and greatest size, most remaining runs and most collisions; a node covers ``FANOUT`` nodes below."""

    def __init__(self, routes: np.ndarray, bits: np.ndarray, n: np.ndarray, rem: np.ndarray, surplus: np.ndarray):
        self.levels = [(routes, bits, n, n, rem, surplus)]
        while len(n := self.levels[-1][2]) > 1:
            at = np.arange(0, len(n), FANOUT)
            how = (np.bitwise_or, np.bitwise_or, np.minimum, np.maximum, np.maximum, np.maximum)
            self.levels.append(tuple(f.reduceat(v, at) for f, v in zip(how, self.levels[-1])))

    def below(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a child of ``x`` and a child of ``y``."""
        size, step = len(self.levels[level - 1][2]), np.arange(FANOUT)
        a = np.repeat(x * FANOUT, FANOUT**2) + np.tile(np.repeat(step, FANOUT), len(x))
        b = np.repeat(y * FANOUT, FANOUT**2) + np.tile(step, len(x) * FANOUT)
        held = (a <= b) & (b < size)
        return a[held], b[held]


def traverse(tree: Tree, t: float, group: np.ndarray, side: np.ndarray, pruned: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``x < y`` of the same group and of sides that meet (different ones, or 0) that the bounds allow.

    ``pruned`` gathers how many pairs of nodes each bound dropped at each kind of level.
    """
    x = y = np.zeros(1, np.int64)
    for level in range(len(tree.levels) - 1, -1, -1):
        routes, bits, lo, hi, rem, surplus = tree.levels[level]
        kind = "rows" if level == 0 else "nodes"
        if pruned is not None:
            pruned[f"{kind} tested"] = pruned.get(f"{kind} tested", 0) + len(x)

        def keep(ok: np.ndarray, bound: str) -> None:
            nonlocal x, y
            if pruned is not None:
                pruned[f"{kind} by {bound}"] = pruned.get(f"{kind} by {bound}", 0) + len(x) - int(ok.sum())
            x, y = x[ok], y[ok]

        if level == 0:
            ok = (x < y) & (group[x] == group[y]) & ((side[x] != side[y]) | (side[x] == 0))
        else:
            ok = (routes[x] & routes[y]).any(axis=1)
        keep(ok, "routing")
        keep((hi[x] >= np.ceil(t * lo[y] - EPS)) & (hi[y] >= np.ceil(t * lo[x] - EPS)), "size")
        least = need(lo[x], lo[y], t)
        ok = np.minimum(rem[x], rem[y]) >= least
        least = least[ok]
        keep(ok, "position")
        keep(_max_overlap(bits[x], bits[y], surplus[x], surplus[y], rem[x], rem[y]) >= least, "bitmap")
        if level == 0 or not len(x):
            return x, y
        x, y = tree.below(level, x, y)
    return x, y


def tree_pairs(c: dict[str, np.ndarray], t: float, pruned: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of whole cells, in order of run, salts and size, from one tree."""
    new = np.append(True, (c["run"][1:] != c["run"][:-1]) | (c["salts"][1:] >> 2 != c["salts"][:-1] >> 2))
    group = np.cumsum(new) - 1
    at = group * (64 * ROUTES) // (group[-1] + 1)  # neighbours share bits, which keeps those of a node few
    routes = np.zeros((len(group), ROUTES), np.uint64)
    routes[np.arange(len(group)), at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    return traverse(Tree(routes, c["bits"], c["n"], c["rem"], c["surplus"]), t, group, c["side"], pruned)


def _traversed(t: float):
    schema = pa.schema([("loc_a", pa.int64()), ("loc_b", pa.int64())])

    def pairs(b: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        """Candidates of the complete cells of a sorted batch, and the rows of the cell that may go on."""
        c = {f.name: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(b.schema)}
        c["bits"] = np.stack([c.pop(f"b{i}") for i in range(WORDS)], axis=1).view(np.uint64)
        c |= dict(zip(("n", "rem", "surplus"), _parted(c.pop("counts")))) | {"side": c["salts"] & 3}
        new = np.append(True, (c["run"][1:] != c["run"][:-1]) | (c["salts"][1:] >> 2 != c["salts"][:-1] >> 2))
        starts = np.append(np.flatnonzero(new), len(b))
        end = len(b) if last else starts[-2]
        lo, found = 0, []
        while lo < end:
            hi = starts[np.searchsorted(starts, lo + CELL, side="right") - 1]
            if hi <= lo:  # one cell of more rows
                hi = starts[np.searchsorted(starts, lo, side="right")]
            hi = min(hi, end)
            x, y = tree_pairs({k: v[lo:hi] for k, v in c.items()}, t)
            found.append(np.stack([c["loc"][lo:hi][x], c["loc"][lo:hi][y]], axis=1))
            lo = hi
        ids = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), np.int64)
        return _batch(schema, pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy())), None if last else b.slice(int(end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            out, rest = pairs(b, False)
            yield out
        if rest is not None:
            yield pairs(rest, True)[0]

    return run


def _small(df: DataFrame) -> DataFrame:
    """A staged table to be joined: broadcast if it is counted to be small, else shuffled."""
    return F.broadcast(df) if df.count() <= SMALL else df


def prefix_cells(blocks: DataFrame, dropped: DataFrame, threshold: float, block: int) -> DataFrame:
    """The rows of all cells, cut by salts: ``run, salts, loc, counts`` and the bitmap of shared runs.

    ``salts`` is 0 for a cell that is whole, else the two salts of a sub-cell; its last two bits are the side of the row in it: 1 or 2, and 0
    on the diagonal.
    """
    total = int(blocks.agg(F.sum("size")).first()[0] or 0)
    buckets = max(total // BUCKET_RUNS + 1, blocks.sparkSession.sparkContext.defaultParallelism)
    kind = "bucket bigint, block bigint, low binary, high binary, n binary"
    counted = blocks.select("block", "low", "high").mapInArrow(_counts(buckets), kind)
    rarity = counted.groupBy("bucket").applyInArrow(_rarity, "block bigint, bucket bigint, rarity binary")
    # of each block a byte a distinct run, and at most its classes
    told = rarity.groupBy("block").agg(F.collect_list(F.struct("bucket", "rarity")).alias("told"))
    place = F.expr(f"cast(loc & {(1 << _PLACE) - 1} as int)").alias("place")
    places = dropped.select(F.shiftright("loc", _PLACE).alias("block"), place).groupBy("block").agg(F.collect_list("place").alias("places"))
    told = told.join(places, "block", "left")
    sent = blocks.select("block", "n", "low", "high").join(F.broadcast(told) if total <= SMALL_RUNS else told, "block")
    fields = ["loc", "counts", *[f"b{i}" for i in range(WORDS)]]
    kind = "run bigint, rarity int, loc bigint, counts bigint, " + ", ".join(f"b{i} bigint" for i in range(WORDS))
    rows = sent.select("block", "n", "low", "high", "told", "places").mapInArrow(_routed(threshold), kind)
    # less than 2 << rarity classes have the run; salts of a hot one follow from that alone
    salts = F.expr(f"cast(if((2L << rarity) > {block}, ceil((2L << rarity) / {block}), 1) as int)")
    cut = rows.withColumn("s", F.pmod(F.xxhash64("loc"), salts).cast("int")).select("run", "s", F.explode(F.sequence(F.lit(0), salts - 1)).alias("j"), *fields)
    side = F.when(F.col("s") == F.col("j"), 0).when(F.col("s") < F.col("j"), 1).otherwise(2)
    pair = F.shiftleft(F.least("s", "j").cast("bigint"), 33) + F.shiftleft(F.greatest("s", "j").cast("bigint"), 2)
    return cut.select("run", (pair + side).alias("salts"), *fields)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 0, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts, and the members of the classes.

    Returns ``links(cid_a, cid_b, similarity)`` with ``cid_a < cid_b``, every pair of classes whose Jaccard
    similarity over distinct ``k``-word runs is at least ``threshold``, and ``members(id, cid)``, one row per
    id; ``cid`` is the smallest id of the class.  Repeated rows count once; null ids and texts and texts below
    ``k`` or ``min_words`` words have no row; an empty table gives empty results; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    kinds = {pa.int64(): "bigint", pa.binary(): "binary"}
    blocks = staged(spread(src).mapInArrow(_blocks(min_words, k), ", ".join(f"{f.name} {kinds[f.type]}" for f in _BLOCKS)), "neardup-blocks")
    entries = blocks.select("block", "ids", "place", "keys").mapInArrow(_entries, "id bigint, key binary, loc bigint")
    copied = entries.groupBy("key").agg(F.min(F.struct("id", "loc")).alias("c"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = _small(staged(copied.select("key", F.col("c.id").alias("cid"), F.col("c.loc").alias("kept")), "neardup-copies"))
    members = entries.join(copied, "key", "left").select("id", F.coalesce("cid", "id").alias("cid")).distinct()
    dropped = entries.join(copied, "key").where("loc <> kept").select("loc").distinct()

    cells = prefix_cells(blocks, dropped, threshold, block)
    cell = F.shiftright("salts", 2)
    found = cells.repartition("run", cell).sortWithinPartitions("run", cell, "counts").mapInArrow(_traversed(threshold), "loc_a bigint, loc_b bigint").distinct()
    found = staged(found, "neardup-candidates")
    ends = _small(staged(found.select(F.explode(F.array("loc_a", "loc_b")).alias("loc")).distinct(), "neardup-ends"))
    classes = blocks.select("block", "first", "n", "low", "high").mapInArrow(_class_rows, "loc bigint, cid bigint, n int, runs array<bigint>").join(ends, "loc")
    a, b = (classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("loc", "cid", "n", "runs")]) for s in "ab")
    overlap = F.size(F.array_intersect("runs_a", "runs_b"))
    counted = found.join(a, "loc_a").join(b, "loc_b").select("cid_a", "cid_b", (overlap / (F.col("n_a") + F.col("n_b") - overlap)).alias("similarity"))
    return counted.where(F.col("similarity") >= threshold).select(F.least("cid_a", "cid_b").alias("cid_a"), F.greatest("cid_a", "cid_b").alias("cid_b"), "similarity"), members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids ``(id_a, id_b)``, ``id_a < id_b``: those of linked classes and those within a class.

    The result grows with the square of a class; ``link_counts`` has one row an id instead.
    """
    a, b = (members.select(F.col("id").alias(f"id_{s}"), F.col("cid").alias(f"cid_{s}")) for s in "ab")
    across = links.join(a, "cid_a").join(b, "cid_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return across.unionByName(pairs_within(members.join(sizes, "cid"), "cid", "id", "size").select("id_a", "id_b"))


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, cid, copies, linked_classes)``: one row per id, copies not expanded."""
    ends = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("linked_classes"))
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(sizes.join(ends, "cid", "left").na.fill(0, ["linked_classes"]), "cid").select("id", "cid", "copies", "linked_classes")
