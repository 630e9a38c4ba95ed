"""Sampling plans and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.operators import sampling as P
from weftline.plans.registry import query, table
from weftline.plans.tokens import _LENGTHS, length_filter
from weftline.session import spread

_SLOTS = (101, 1000, 4321, 60000)


@query(
    "mth2_magic_prime",
    f"""WITH s(slots) AS (VALUES {", ".join(f"({s})" for s in _SLOTS)}), c AS (SELECT slots, unnest(range((0.9 * slots)::BIGINT + 1, slots + 1)) AS p FROM s)
SELECT slots::BIGINT AS slots, max(p)::BIGINT AS p FROM c WHERE p > floor(0.9 * slots) AND p % 3 = 2 AND len(list_filter(range(2, floor(sqrt(p))::BIGINT + 1), lambda d: p % d = 0)) = 0 GROUP BY slots""",
)
def magic_primes(spark: SparkSession, d: str) -> DataFrame:
    largest = F.pandas_udf(lambda slots: slots.map(N.magic_prime), "bigint")
    return spark.createDataFrame([(s,) for s in _SLOTS], "slots bigint").select("slots", largest("slots").alias("p"))


@query("mth1_is_prime", "SELECT i AS n, i >= 2 AND len(list_filter(range(2, floor(sqrt(i))::BIGINT + 1), lambda d: i % d = 0)) = 0 AS prime FROM range(0, 5000) r(i)")
def primes(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(5000).select(F.col("id").alias("n"), N.is_prime_column(F.col("id")).alias("prime"))


_P = 59999


@query("mth3_slots", f"SELECT 1 + i AS ii, ({N.slot_factor(_P)} * ((((1 + i) % {_P}) * ((1 + i) % {_P}) % {_P}) * ((1 + i) % {_P}) % {_P})) % {_P} AS slot FROM range(0, 40320) r(i)")
def slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of the samples of one epoch."""
    return spark.range(N.SAMPLES_PER_EPOCH).select((F.col("id") + 1).alias("ii")).select("ii", N.slot(F.col("ii"), _P).alias("slot"))


@query("mth4_sample_number", "SELECT e AS epoch, i AS idx, r AS rank, 1 + e * 40320 + i * 4 + r AS ii FROM range(0, 3) a(e), range(0, 50) b(i), range(0, 4) c(r)")
def sample_numbers(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(600).select(F.expr("id div 200").alias("epoch"), F.expr("(id div 4) % 50").alias("idx"), (F.col("id") % 4).alias("rank"))
    return grid.select("*", N.sample_number(F.col("epoch"), F.col("idx"), F.col("rank"), 4).alias("ii"))


@query("mth5_exit_tokens", "SELECT p, acc, ceil(p * 6144.0 / acc)::BIGINT AS exit_tokens, round_even(p * 6144.0 / acc * 2.5, 0)::BIGINT AS after_epochs FROM (VALUES (983), (59999)) a(p), (VALUES (1), (3), (8)) b(acc)")
def exit_tokens(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(p, a) for p in (983, 59999) for a in (1, 3, 8)], "p int, acc int")
    tokens = F.col("p") * F.lit(6144.0) / F.col("acc")
    return grid.select("p", "acc", F.ceil(tokens).cast("bigint").alias("exit_tokens"), F.bround(tokens * 2.5, 0).cast("bigint").alias("after_epochs"))


@query("mth6_epoch_plan", "SELECT p, bsz, p // 40320 AS epoch_count, 40320 // bsz AS epoch_steps FROM (VALUES (59999), (2926181)) a(p), (VALUES (8), (96)) b(bsz) WHERE 40320 % bsz = 0")
def epoch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Epochs in a period and steps in an epoch; the batch must divide the epoch."""
    grid = spark.createDataFrame([(p, b) for p in (59999, 2926181) for b in (8, 96)], "p int, bsz int")
    even = F.when(F.lit(N.SAMPLES_PER_EPOCH) % F.col("bsz") == 0, F.expr(f"cast({N.SAMPLES_PER_EPOCH} div bsz as int)")).otherwise(F.raise_error(F.lit("the batch does not divide the epoch")).cast("int"))
    return grid.select("p", "bsz", F.expr(f"cast(p div {N.SAMPLES_PER_EPOCH} as int)").alias("epoch_count"), even.alias("epoch_steps"))


@query("mth9_real_batch", "SELECT n AS nodes, g AS devices, m AS micro, n * g * m AS real_bsz FROM range(1, 4) a(n), range(1, 9) b(g), range(1, 4) c(m)")
def real_batch(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(72).select(F.expr("id div 24 + 1").alias("nodes"), F.expr("(id div 3) % 8 + 1").alias("devices"), F.expr("id % 3 + 1").alias("micro"))
    return grid.select("*", F.expr("nodes * devices * micro").alias("real_bsz"))


_INIT, _FINAL, _WARM, _EXIT = 6e-4, 6e-5, 50, 2_000_000


@query(
    "mth7_learning_rate",
    f"""WITH s AS (SELECT i AS step, greatest(0.0, least(1.0, (i * 4096.0 - {_WARM} * 4096.0) / ({_EXIT} - {_WARM} * 4096.0))) AS p FROM range(0, 600) r(i)),
l AS (SELECT step, {_INIT}::DOUBLE * ((0.5 + {_FINAL / _INIT!r} / 2) + (0.5 - {_FINAL / _INIT!r} / 2) * cos({math.pi!r} * p)) AS lr FROM s)
SELECT step, round(CASE WHEN step < {_WARM} THEN lr * (0.01 + 0.99 * step / {_WARM}.0) ELSE lr END, 12) AS lr FROM l""",
)
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = N.learning_rate(F.col("id"), _WARM, 512, 8, _EXIT, _INIT, _FINAL)
    return spark.range(600).select(F.col("id").alias("step"), F.round(rate, 12).alias("lr"))


@query(
    "mth8_resize",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(0, 100)) AS i FROM embeddings), q AS (SELECT vec_id, i, v, i / 100.0::DOUBLE * len(v) AS pos FROM e)
SELECT vec_id, i::INTEGER AS i, round(CASE WHEN pos >= len(v) - 1 THEN v[len(v)] ELSE v[floor(pos)::INT + 1] * (1 - (pos - floor(pos))) + v[floor(pos)::INT + 2] * (pos - floor(pos)) END, 5) + 0.0::DOUBLE AS value FROM q""",
)
def resize(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return wide.select("vec_id", F.posexplode(N.resized(F.col("v"), 100)).alias("i", "value")).select("vec_id", "i", (F.round("value", 5) + F.lit(0.0)).alias("value"))  # no negative zeros


_VALID = "valid AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM sizes WHERE size BETWEEN 1 AND 2048)"


@query(
    "jon2_sampled_docs",
    f"""WITH {_LENGTHS}, {_VALID}, n AS (SELECT count(*) AS n FROM valid),
m AS (SELECT max(p)::BIGINT AS p FROM (SELECT unnest(range(2, n + 1)) AS p FROM n) WHERE p % 3 = 2 AND len(list_filter(range(2, floor(sqrt(p))::BIGINT + 1), lambda d: p % d = 0)) = 0),
s AS (SELECT i AS ii, (floor(p * ((sqrt(5::DOUBLE) - 1) / 2))::BIGINT * (((i % p) * (i % p) % p) * (i % p) % p)) % p AS slot FROM (SELECT p, unnest(range(1, p + 1)) AS i FROM m))
SELECT ii, slot, doc_id FROM s JOIN valid USING (slot)""",
)
def sampled_docs(spark: SparkSession, d: str) -> DataFrame:
    """One period of samples; the prime is taken from the number of valid documents, whatever its coverage."""
    valid = length_filter(spark, d)
    p = N.magic_prime(valid.count(), 0.0)
    return P.sampled_documents(spark.range(1, p + 1).withColumnRenamed("id", "ii"), valid, p)


def char_streams(spark: SparkSession, d: str) -> DataFrame:
    """Characters as tokens with an end token: code point plus one, small Latin letters lossable."""
    chars = F.regexp_extract_all("text", F.lit("(?s:.)"), F.lit(0))
    docs = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", chars.alias("c"))
    tokens = F.concat(F.transform("c", lambda c: F.ascii(c) % 60000 + 1), F.array(F.lit(0)))
    return docs.select("doc_id", tokens.alias("tokens"), F.transform("c", lambda c: F.when(c.between("a", "z"), 1).otherwise(0)).alias("lossable"))


_CTX, _BLOCK = 6144, 32
_RAW = P.raw_length(_CTX, _BLOCK)


def _sample(condition: str, length: str) -> str:
    """Characters as tokens with an end token, filled to ``length``, and what is masked of them."""
    return f"""cut AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE text <> ''{condition}),
wide AS (SELECT doc_id, c || list_transform(range(len(c), {length}), lambda i: '') AS c, len(c) AS n FROM cut),
pos AS (SELECT doc_id, i AS pos, i // {_BLOCK} AS block, i % {_BLOCK} AS off, CASE WHEN i < n THEN unicode(ch) % 60000 + 1 WHEN i = n THEN 0 ELSE 65534 END AS tok, i < n AND ch BETWEEN 'a' AND 'z' AS lossable
  FROM (SELECT doc_id, n, unnest(c) AS ch, unnest(range(0, len(c))) AS i FROM wide)),
drawn AS (SELECT *, {N.sql_uniform("doc_id", "0", "block", 1)} AS r, {N.sql_uniform("doc_id", "0", "block", 2)} AS f, {N.sql_uniform("doc_id", "0", "pos", 3)} AS u, bool_or(tok = 0) OVER (PARTITION BY doc_id, block) AS has_eos FROM pos),
sample AS (SELECT doc_id, block, off, pos, tok, (lossable AND u < CASE WHEN f < 0.1 THEN 1.0 ELSE r END) OR tok = 0 OR (tok = 65534 AND has_eos) AS masked FROM drawn)"""


#: Samples of one context: the documents that pass its length filter, none of them cut.
_SAMPLE = _sample(f" AND length(text) < {_RAW}", f"{_RAW}")
#: All documents whole, in as many blocks as each needs.
_WHOLE = _sample("", f"(len(c) // {_BLOCK} + 1) * {_BLOCK}")


def whole_streams(spark: SparkSession, d: str) -> DataFrame:
    """The streams of ``char_streams`` with a loss bit for the end token too, by code points in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                codes = [np.frombuffer(t.encode("utf-32-le"), np.int32) for t in b.column(1).to_pylist()]
                ends = np.cumsum([len(c) + 1 for c in codes])
                flat = np.concatenate([np.append(c, -1) for c in codes])
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (np.where(flat < 0, 0, flat % 60000 + 1).astype(np.int32), ((flat >= ord("a")) & (flat <= ord("z"))).astype(np.int8))]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "tokens", "lossable"])

    docs = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("bigint"), "text")
    return spread(docs).mapInArrow(run, "doc_id bigint, tokens array<int>, lossable array<tinyint>")


def fitting_streams(spark: SparkSession, d: str) -> DataFrame:
    """The streams that one context holds, end token included."""
    return whole_streams(spark, d).where(F.size("tokens") <= _RAW)


def _block_sums(spark: SparkSession, d: str) -> DataFrame:
    return P.block_sums(whole_streams(spark, d), _BLOCK)


def _sample_sums(spark: SparkSession, d: str) -> DataFrame:
    return P.block_sums(fitting_streams(spark, d), _BLOCK, _CTX)


@query("arr_block_mask", f"WITH {_SAMPLE} SELECT doc_id, block::INTEGER AS block, count_if(masked) AS n_masked, coalesce(sum(off + 1) FILTER (WHERE masked), 0)::BIGINT AS places FROM sample GROUP BY doc_id, block")
def block_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masks of all blocks of a context: how many and where."""
    return _sample_sums(spark, d).select("doc_id", "block", "n_masked", "places")


@query(
    "arr_triplet",
    f"""WITH {_SAMPLE}, m AS (SELECT *, CASE WHEN masked THEN 65535 ELSE tok END AS noisy FROM sample)
SELECT doc_id, block::INTEGER AS block, role, sum(CASE WHEN role < 2 THEN noisy ELSE tok END * (off + 1))::BIGINT AS weighted FROM m, (VALUES (0), (1), (2)) r(role) GROUP BY doc_id, block, role""",
)
def triplet(spark: SparkSession, d: str) -> DataFrame:
    """The three copies of each block, as position-weighted sums."""
    return _sample_sums(spark, d).select("doc_id", "block", F.posexplode("weighted").alias("role", "weighted"))


@query("arr_targets", f"WITH {_SAMPLE} SELECT doc_id, block::INTEGER AS block, count(*) AS supervised, sum(tok * (off + 1))::BIGINT AS weighted FROM sample WHERE masked AND tok <> 65534 GROUP BY doc_id, block")
def targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets stand in the second copy only, at masked positions that are no padding; from the assembled samples."""
    samples = P.assemble(fitting_streams(spark, d), _CTX, _BLOCK)
    each = samples.select("doc_id", F.posexplode("y").alias("i", "y")).where("y <> -100")
    return each.groupBy("doc_id", F.expr(f"cast(i div {3 * _BLOCK} as int)").alias("block")).agg(F.count(F.lit(1)).alias("supervised"), F.sum(F.col("y").cast("bigint") * (F.col("i") % _BLOCK + 1)).alias("weighted"))


@query("arr1_padded", f"WITH {_SAMPLE} SELECT doc_id, count_if(tok = 65534) AS padding, sum(tok * (pos + 1))::BIGINT AS weighted FROM sample GROUP BY doc_id")
def padded(spark: SparkSession, d: str) -> DataFrame:
    """Documents filled to the raw length, as array expressions."""
    fixed = F.slice(F.concat("tokens", F.array_repeat(F.lit(65534), _RAW)), 1, _RAW)
    each = fitting_streams(spark, d).select("doc_id", F.posexplode(fixed).alias("pos", "t"))
    return each.groupBy("doc_id").agg(F.count_if(F.col("t") == 65534).alias("padding"), F.sum(F.col("t").cast("bigint") * (F.col("pos") + 1)).alias("weighted"))


@query("agg19_eos_blocks", f"WITH {_SAMPLE} SELECT doc_id, block::INTEGER AS block, bool_or(tok = 0) AS has_eos FROM sample GROUP BY doc_id, block")
def eos_blocks(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.slice(F.concat("tokens", F.array_repeat(F.lit(65534), _RAW)), 1, _RAW)
    each = fitting_streams(spark, d).select("doc_id", F.posexplode(fixed).alias("pos", "t"))
    return each.groupBy("doc_id", F.expr(f"cast(pos div {_BLOCK} as int)").alias("block")).agg(F.bool_or(F.col("t") == 0).alias("has_eos"))


@query("arr_block_mask_whole", f"WITH {_WHOLE} SELECT doc_id, block::INTEGER AS block, count_if(masked) AS n_masked, coalesce(sum(off + 1) FILTER (WHERE masked), 0)::BIGINT AS places FROM sample GROUP BY doc_id, block")
def block_mask_whole(spark: SparkSession, d: str) -> DataFrame:
    """Masks of all blocks of all documents, none cut and none left out for its length."""
    return _block_sums(spark, d).select("doc_id", "block", "n_masked", "places")


@query(
    "arr_triplet_whole",
    f"""WITH {_WHOLE}, m AS (SELECT *, CASE WHEN masked THEN 65535 ELSE tok END AS noisy FROM sample)
SELECT doc_id, block::INTEGER AS block, role, sum(CASE WHEN role < 2 THEN noisy ELSE tok END * (off + 1))::BIGINT AS weighted FROM m, (VALUES (0), (1), (2)) r(role) GROUP BY doc_id, block, role""",
)
def triplet_whole(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(spark, d).select("doc_id", "block", F.posexplode("weighted").alias("role", "weighted"))


@query("arr_targets_whole", f"WITH {_WHOLE} SELECT doc_id, block::INTEGER AS block, count(*) AS supervised, sum(tok * (off + 1))::BIGINT AS weighted FROM sample WHERE masked AND tok <> 65534 GROUP BY doc_id, block")
def targets_whole(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(spark, d).where("supervised > 0").select("doc_id", "block", "supervised", F.col("targets").alias("weighted"))


@query("arr1_padded_whole", f"WITH {_WHOLE} SELECT doc_id, count_if(tok = 65534) AS padding, sum(tok * (pos + 1))::BIGINT AS weighted FROM sample GROUP BY doc_id")
def padded_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents filled to whole blocks."""
    placed = F.col("weighted")[2] + F.col("block").cast("bigint") * _BLOCK * F.col("total")
    return _block_sums(spark, d).groupBy("doc_id").agg(F.sum("padding").alias("padding"), F.sum(placed).alias("weighted"))


@query("agg19_eos_blocks_whole", f"WITH {_WHOLE} SELECT doc_id, block::INTEGER AS block, bool_or(tok = 0) AS has_eos FROM sample GROUP BY doc_id, block")
def eos_blocks_whole(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(spark, d).select("doc_id", "block", "has_eos")


_DIGITS = N.sql_uniform("i", "0", "0", 11)
_VALUE = N.sql_uniform("i", "0", "1", 12)


@query(
    "src21_digit_strings",
    f"""WITH u AS (SELECT i AS id, 1 + floor({_DIGITS} * 6)::BIGINT AS k, {_VALUE} AS v FROM range(0, 1000) r(i)),
n AS (SELECT id, (CASE WHEN k = 1 THEN 0 ELSE 10 ** (k - 1) END + floor(v * (10 ** k - CASE WHEN k = 1 THEN 0 ELSE 10 ** (k - 1) END)))::BIGINT::VARCHAR AS s FROM u)
SELECT id, (s || ',' || reverse(s) || '#')[1:12] AS line FROM n""",
)
def digit_strings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a random count of digits with their reverse, cut at 12 characters."""
    k = F.floor(N.uniform(F.col("id"), 0, F.lit(0), 11) * 6) + 1
    drawn = spark.range(1000).select("id", k.alias("k"), N.uniform(F.col("id"), 0, F.lit(1), 12).alias("v"))
    low = F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), F.col("k") - 1))
    number = (low + F.floor(F.col("v") * (F.pow(F.lit(10.0), F.col("k")) - low))).cast("bigint").cast("string")
    return drawn.select("id", number.alias("s")).select("id", F.substring(F.concat("s", F.lit(","), F.reverse("s"), F.lit("#")), 1, 12).alias("line"))
