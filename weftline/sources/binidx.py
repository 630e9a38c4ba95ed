"""The indexed binary token store: ``<prefix>.idx``, ``<prefix>.bin`` and the loss bits beside them.

``.idx`` is little-endian: 9 bytes of magic, version (u64), type code (u8), number of documents n (u64), length of
the document index (u64), n sizes (i32), n byte pointers (i64), the document index (i64).  ``.bin`` holds the
tokens of all documents, ``.lossable.bin`` one byte a token.

A store is one such set of files or, for large corpora, a folder of shards: every task writes the set of its range of
documents, and ``manifest.json`` lists the shards in order with their numbers of documents and tokens, so that no byte passes
through the driver.  ``export`` joins shards into one set where a reader of single files needs it.

Reading is a data source over both: the driver reads headers only, each task its range of documents, conditions on
``doc_id`` narrow the ranges, and with ``columns=sizes`` no token is read.  Files are opened through Arrow's file systems, by URI.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from weftline.operators.ranks import ranked

#: Fixed values of the format.
MAGIC, VERSION = b"MMIDIDX\x00\x00", 1
DTYPES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 7: np.float64, 8: np.uint16}
HEADER = len(MAGIC) + 8 + 1 + 8 + 8
SUFFIXES = ("_text_document.lossable.bin", ".lossable.bin")
SCHEMA = "doc_id bigint, size int, pointer bigint, tokens array<int>, lossable array<tinyint>"
SIZES = "doc_id bigint, size int"
MANIFEST = "manifest.json"
_COPY = 1 << 24


def _file(path: str) -> tuple[afs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)


def _length(path: str) -> int | None:
    """Bytes of a file; None where there is none."""
    system, at = _file(path)
    info = system.get_file_info(at)
    return info.size if info.type == afs.FileType.File else None


def _read(path: str, dtype, count: int, offset: int = 0) -> np.ndarray:
    system, at = _file(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype)


class Files:
    """Files of a store kept open for many small reads, the last ``held`` of them."""

    def __init__(self, held: int = 32):
        self.open = lru_cache(held)(lambda path: _file(path)[0].open_input_file(_file(path)[1]))

    def read(self, path: str, dtype, count: int, offset: int = 0) -> np.ndarray:
        return np.frombuffer(self.open(path).read_at(count * np.dtype(dtype).itemsize, offset), dtype)


def header(prefix: str) -> tuple[int, int, int]:
    """Type code, number of documents and length of the document index; errors on another format."""
    head = _read(prefix + ".idx", np.uint8, HEADER).tobytes()
    if len(head) < HEADER or head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{prefix}.idx is no index")
    version, code, n, docs = struct.unpack("<QBQQ", head[len(MAGIC) :])
    if version != VERSION:
        raise ValueError(f"version {version} of {prefix}.idx is unknown")
    if code not in DTYPES:
        raise ValueError(f"type code {code} cannot be read")
    return code, n, docs


def exists(path: str) -> bool:
    """Whether a store is there: an index and its tokens, or a manifest of shards."""
    return _length(f"{path}/{MANIFEST}") is not None or None not in (_length(path + ".idx"), _length(path + ".bin"))


def sidecar(prefix: str) -> str | None:
    """Path of the loss bits, if there are any; the longer name comes first."""
    return next((prefix + s for s in SUFFIXES if _length(prefix + s) is not None), None)


def tokens_by_file(prefix: str) -> int:
    """Tokens of the stream by the length of its file."""
    width, length = np.dtype(DTYPES[header(prefix)[0]]).itemsize, _length(prefix + ".bin")
    if length % width:
        raise ValueError(f"{prefix}.bin is torn")
    return length // width


@dataclass
class Shard:
    """One set of files of a store, with the numbers of documents and tokens before it."""

    prefix: str
    docs: int
    tokens: int
    first_doc: int = 0
    first_token: int = 0

    @cached_property
    def dtype(self) -> np.dtype:
        return np.dtype(DTYPES[header(self.prefix)[0]])

    def sizes(self, lo: int, hi: int) -> np.ndarray:
        return _read(self.prefix + ".idx", "<i4", hi - lo, HEADER + 4 * lo)

    def pointers(self, lo: int, hi: int) -> np.ndarray:
        return _read(self.prefix + ".idx", "<i8", hi - lo, HEADER + 4 * self.docs + 8 * lo)


def shards(path: str) -> list[Shard]:
    """The shards of a store in order; a single set of files is one."""
    if _length(f"{path}/{MANIFEST}") is None:
        return [Shard(path, header(path)[1], tokens_by_file(path))]
    system, at = _file(f"{path}/{MANIFEST}")
    with system.open_input_file(at) as f:
        out, docs, tokens = [], 0, 0
        for s in json.loads(f.read())["shards"]:
            out.append(Shard(f"{path}/{s['name']}", s["docs"], s["tokens"], docs, tokens))
            docs, tokens = docs + s["docs"], tokens + s["tokens"]
    return out


@dataclass
class Range(InputPartition):
    """Documents ``lo`` to ``hi`` of one shard."""

    shard: Shard
    lo: int
    hi: int


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: str, per_task: int):
        self.columns, self.per_task = columns, per_task
        self.shards = shards(path)
        self.least, self.most = 0, sum(s.docs for s in self.shards)
        for s in self.shards if columns == "all" else ():
            bits = sidecar(s.prefix)
            if bits is not None and _length(bits) != s.tokens:
                raise ValueError(f"{bits} has another number of tokens than {s.prefix}.bin")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ``doc_id`` narrow the documents read; Spark checks every condition again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("doc_id",):
                match f:
                    case EqualTo():
                        lo, hi = f.value, f.value + 1
                    case In():
                        values = [v for v in f.value if v is not None] or [-1]
                        lo, hi = min(values), max(values) + 1
                    case GreaterThan():
                        lo, hi = f.value + 1, self.most
                    case GreaterThanOrEqual():
                        lo, hi = f.value, self.most
                    case LessThan():
                        lo, hi = 0, f.value
                    case LessThanOrEqual():
                        lo, hi = 0, f.value + 1
                    case _:
                        lo, hi = 0, self.most
                self.least, self.most = max(self.least, lo), min(self.most, hi)
            yield f

    def partitions(self) -> list[Range]:
        out = []
        for s in self.shards:
            least, most = max(0, self.least - s.first_doc), min(s.docs, self.most - s.first_doc)
            out += [Range(s, lo, min(lo + self.per_task, most)) for lo in range(least, most, self.per_task)]
        return out or [Range(self.shards[0] if self.shards else Shard("", 0, 0), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        s, lo, hi = part.shard, part.lo, part.hi
        if hi <= lo:
            return
        size = s.sizes(lo, hi)
        ids = np.arange(lo, hi, dtype=np.int64) + s.first_doc
        if self.columns == "sizes":
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size)], names=["doc_id", "size"])
            return
        dtype, at, bits = s.dtype, s.pointers(lo, hi), sidecar(s.prefix)
        total = int(size.sum())
        tokens = _read(s.prefix + ".bin", dtype, total, int(at[0])).astype(np.int32)
        loss = np.ones(total, np.int8) if bits is None else _read(bits, np.int8, total, int(at[0]) // dtype.itemsize)
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (tokens, loss)]
        pointer = at + s.first_token * dtype.itemsize
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(pointer), *lists], names=["doc_id", "size", "pointer", "tokens", "lossable"])


class BinidxSource(DataSource):
    """``spark.read.format("binidx").option("columns", "sizes" or "all").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "binidx"

    def _columns(self) -> str:
        return self.options.get("columns", "all")

    def schema(self) -> str:
        return SIZES if self._columns() == "sizes" else SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._columns(), int(self.options.get("docsPerTask", "20000")))


def read(spark: SparkSession, path: str, columns: str = "all") -> DataFrame:
    """Documents of a store; a prefix is taken as it is, without guessing a suffix."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinidxSource)
    return spark.read.format("binidx").option("columns", columns).load(path)


def at(store: DataFrame, i: int) -> DataFrame:
    """Document ``i``; its range alone is read."""
    return store.where(F.col("doc_id") == i)


def contiguous(store: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    if step != 1:
        raise ValueError("only contiguous slices can be read")
    return store.where(F.col("doc_id").between(start, stop - 1))


def flat(path: str, offset: int, length: int) -> np.ndarray:
    """Tokens of the flat stream, over the borders of documents and shards; an error beyond its end."""
    return _flat(shards(path), offset, length)


def _flat(parts: list[Shard], offset: int, length: int, read=_read) -> np.ndarray:
    k = bisect.bisect_right([s.first_token for s in parts], offset) - 1
    found = []
    while length > 0:
        if not 0 <= k < len(parts):
            raise ValueError("the stream ends before the tokens asked for")
        s = parts[k]
        n = min(length, s.first_token + s.tokens - offset)
        if n > 0:
            dtype = s.dtype
            found.append(read(s.prefix + ".bin", dtype, n, (offset - s.first_token) * dtype.itemsize))
            offset, length = offset + n, length - n
        k += 1
    return np.concatenate(found) if found else np.empty(0, np.int32)


def get(requests: DataFrame, path: str) -> DataFrame:
    """Add ``tokens`` to ``requests(idx, offset, length)``: random access to the store.

    ``length`` tokens from ``offset`` of document ``idx`` on, which may run on into the documents behind; a null length
    goes to the end of the document.  A document that is not there and a length beyond the stream are errors.
    """
    parts = shards(path)
    starts = [s.first_doc for s in parts]
    rest = [c for c in requests.columns if c not in ("idx", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Files().read
        for b in batches:
            tokens = []
            for idx, offset, length in zip(*(b.column(c).to_pylist() for c in ("idx", "offset", "length"))):
                s = parts[bisect.bisect_right(starts, idx) - 1] if idx >= 0 and parts else None
                if s is None or idx >= s.first_doc + s.docs:
                    raise ValueError(f"no document {idx}")
                own = idx - s.first_doc
                if length is None:
                    length = max(0, int(read(s.prefix + ".idx", "<i4", 1, HEADER + 4 * own)[0]) - offset)
                start = int(read(s.prefix + ".idx", "<i8", 1, HEADER + 4 * s.docs + 8 * own)[0]) // s.dtype.itemsize
                tokens.append(_flat(parts, s.first_token + start + offset, length, read))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.int32()))], names=[*b.schema.names, "tokens"])

    src = requests.select(F.col("idx").cast("bigint"), F.col("offset").cast("bigint"), F.col("length").cast("bigint"), *rest)
    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes)
    return src.mapInArrow(run, f"{schema}, tokens array<int>")


def write_shards(df: DataFrame, path: str, order: str = "doc_order", partitions: int | None = None) -> list[dict]:
    """Store ``df(order, tokens, lossable)`` by ``order`` as a folder of shards; documents without tokens are left out.

    There are ``partitions`` of them, or as many as adaptive execution makes.
    Each task writes files of its own attempt; the manifest, written last, names those of the attempts that counted.
    """
    system, folder = _file(path)
    system.create_dir(folder, recursive=True)
    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, system = TaskContext.get().partitionId(), _file(path)[0]
        name = f"shard-{part:08d}-{TaskContext.get().taskAttemptId()}"
        at, lengths = _file(f"{path}/{name}")[1], [np.empty(0, np.int32)]
        with system.open_output_stream(at + ".bin") as tokens, system.open_output_stream(at + SUFFIXES[1]) as bits:
            for b in batches:
                t, l = b.column(0), b.column(1)
                lengths.append(np.diff(t.offsets.to_numpy()).astype("<i4"))
                if not np.array_equal(lengths[-1], np.diff(l.offsets.to_numpy())):
                    raise ValueError("tokens and loss bits differ in number")
                tokens.write(t.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes())
                bits.write(l.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        size = np.concatenate(lengths)
        with system.open_output_stream(at + ".idx") as index:
            _write_index(index, len(size), [size])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(size)], pa.int64()), pa.array([int(size.sum())], pa.int64())], schema=schema)

    rows = df.where(F.size("tokens") > 0).select(order, F.col("tokens").cast("array<int>").alias("tokens"), F.col("lossable").cast("array<tinyint>").alias("lossable"))
    spread = rows.repartitionByRange(partitions, order) if partitions else rows.repartitionByRange(order)
    ordered = spread.sortWithinPartitions(order).select("tokens", "lossable")
    written = sorted(ordered.mapInArrow(save, "part int, name string, docs bigint, tokens bigint").collect())  # one row a task
    listed = [{k: r[k] for k in ("name", "docs", "tokens")} for r in written]
    names = tuple(s["name"] + "." for s in listed)
    for f in system.get_file_info(afs.FileSelector(folder)):  # of attempts that failed or came second
        if f.base_name.startswith("shard-") and not f.base_name.startswith(names):
            system.delete_file(f.path)
    with system.open_output_stream(f"{folder}/{MANIFEST}") as f:
        f.write(json.dumps({"shards": listed}).encode())
    return listed


def _write_index(out, n: int, sizes: list[np.ndarray] | Iterator[np.ndarray]) -> None:
    """The index of ``n`` documents; ``sizes`` are read twice."""
    out.write(MAGIC + struct.pack("<QBQQ", VERSION, 4, n, n + 1))
    for size in sizes:
        out.write(size.astype("<i4").tobytes())
    before = 0
    for size in sizes:
        ends = before + np.cumsum(size.astype(np.int64) * 4)
        out.write((ends - size.astype(np.int64) * 4).astype("<i8").tobytes())
        before = int(ends[-1]) if len(ends) else before
    for lo in range(0, n + 1, 1 << 20):
        out.write(np.arange(lo, min(lo + (1 << 20), n + 1), dtype="<i8").tobytes())


class _Sizes:
    """The sizes of all shards, one shard after another, as often as they are asked for."""

    def __init__(self, parts: list[Shard]):
        self.parts = parts

    def __iter__(self) -> Iterator[np.ndarray]:
        return (s.sizes(0, s.docs) for s in self.parts)


def export(path: str, prefix: str) -> None:
    """Join the shards of a store into one set of files.  This copies every byte on one machine, as the format demands."""
    parts, system = shards(path), _file(prefix)[0]
    for suffix in (".bin", SUFFIXES[1]):
        with system.open_output_stream(_file(prefix + suffix)[1]) as out:
            for s in parts:
                source, at = _file(s.prefix + suffix)
                with source.open_input_stream(at) as f:
                    while block := f.read(_COPY):
                        out.write(block)
    with system.open_output_stream(_file(prefix + ".idx")[1]) as out:
        _write_index(out, sum(s.docs for s in parts), _Sizes(parts))


def fill(path: str, value: int, count: int) -> None:
    """A file of ``count`` bytes of one value, written a block at a time."""
    system, at = _file(path)
    block = memoryview(bytes([value]) * min(count, _COPY))
    with system.open_output_stream(at) as out:
        for lo in range(0, count, _COPY):
            out.write(block[: min(_COPY, count - lo)])


def write(df: DataFrame, prefix: str, order: str = "doc_order") -> None:
    """Store ``df(order, tokens, lossable)`` by ``order`` as one set of files: shards, joined and removed."""
    parts = f"{prefix}.parts-{uuid.uuid4().hex}"
    try:
        write_shards(df, parts, order)
        export(parts, prefix)
    finally:
        system, at = _file(parts)
        if system.get_file_info(at).type == afs.FileType.Directory:
            system.delete_dir(at)


def index(sizes_df: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, size, pointer)`` without files: pointers by a two-pass prefix sum."""
    return ranked(sizes_df, [], ["doc_id"], total=F.col("size"), total_name="before").select("doc_id", "size", (F.col("before") * width).alias("pointer"))
