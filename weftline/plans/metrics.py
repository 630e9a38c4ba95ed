"""Metrics: embeddings as logits, events as metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import decode as D
from weftline.operators import metrics as M
from weftline.operators.ranks import ranked
from weftline.plans.decoding import _CHARS, _LOGITS, _chars, logits
from weftline.plans.registry import query, table

_STATS = f"""{_LOGITS}, y AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -100 ELSE label * 6 END AS target, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings),
z AS (SELECT vec_id, token, logit - max(logit) OVER (PARTITION BY vec_id) AS z FROM logits),
s AS (SELECT vec_id, ln(sum(exp(z))) AS lse, sum(exp(z) * z) / sum(exp(z)) AS ez FROM z GROUP BY vec_id),
p AS (SELECT y.vec_id, target, best, lse - zy.z AS nll, lse - ez AS entropy FROM y JOIN s USING (vec_id) LEFT JOIN z zy ON zy.vec_id = y.vec_id AND zy.token = y.target)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """Positions with a target each; every fourth is not supervised."""
    target = F.when(F.col("vec_id") % 4 == 0, M.IGNORE).otherwise(F.col("label") * 6)
    wide = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return M.position_stats(wide, "vec_id", target)


@query("agg14_masked_ce", f"WITH {_STATS} SELECT round(sum(nll) FILTER (WHERE target <> -100) / greatest(count_if(target <> -100), 1), 8) AS loss FROM p")
def masked_ce(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).agg(F.round(M.masked_cross_entropy(F.col("nll"), F.col("target")), 8).alias("loss"))


@query("agg15_masked_accuracy", f"WITH {_STATS} SELECT greatest(count_if(target <> -100), 1) AS n_masked, round(count_if(target <> -100 AND best = target) / greatest(count_if(target <> -100), 1), 9) AS accuracy FROM p")
def masked_accuracy(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.count_if(F.col("target") != M.IGNORE), F.lit(1))
    return _stats(spark, d).agg(n.alias("n_masked"), F.round(M.masked_accuracy(F.col("best"), F.col("target")), 9).alias("accuracy"))


@query("agg16_selective_entropy", f"WITH {_STATS} SELECT round(coalesce(avg(entropy) FILTER (WHERE target <> -100 AND best = target), 0), 8) AS entropy FROM p")
def selective_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).agg(F.round(M.selective_entropy(F.col("entropy"), F.col("best"), F.col("target")), 8).alias("entropy"))


@query("agg20_bench_summary", "SELECT event_type, round(avg(value), 6) AS mean_value, max(value) AS max_value, arg_min(event_id, (value, event_id)) FILTER (WHERE value > 0.05) AS best FROM events GROUP BY event_type")
def bench_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means, peaks and the best run among those with a sample."""
    best = F.min_by("event_id", F.when(F.col("value") > 0.05, F.struct("value", "event_id")))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), best.alias("best"))


@query("agg21_latest_checkpoints", "WITH n AS (SELECT c_custkey * 3 AS n FROM customer WHERE c_custkey % 7 <> 0 UNION SELECT -1), m AS (SELECT max(n) AS latest FROM n) SELECT latest::INTEGER AS latest, (SELECT max(n) FROM n WHERE n < latest)::INTEGER AS previous FROM m")
def latest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The two newest numbers; the final checkpoint does not count, the initial one is -1."""
    names = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("model-"), (F.col("c_custkey") * 3).cast("string"), F.lit(".pth")).alias("name"))
    extra = spark.createDataFrame([("model-init.pth",), ("model-final.pth",), ("notes.txt",)], "name string")
    return M.latest_two(names.union(extra), "name")


@query("agg22_epoch_means", "SELECT event_type, user_id % 8 AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY ALL")
def epoch_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 8).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query("win4_running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 10) AS running FROM events")
def running_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the loss so far, begun anew in each epoch; users stand for epochs."""
    placed = ranked(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], total=F.col("value"))
    return placed.select("event_id", F.round((F.col("before") + F.col("value")) / (F.col("rank") + 1), 10).alias("running"))


@query("agg23_extremes", f"WITH {_LOGITS} SELECT vec_id % 10 AS tensor, round(max(abs(logit)), 6) AS max_abs, count_if(isnan(logit) OR isinf(logit)) AS non_finite FROM logits GROUP BY 1")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    """Largest values and values that are no numbers, by tensor."""
    bad = F.isnan("logit") | (F.abs("logit") == float("inf"))
    return logits(spark, d).groupBy((F.col("vec_id") % 10).alias("tensor")).agg(F.round(F.max(F.abs("logit")), 6).alias("max_abs"), F.count_if(bad).alias("non_finite"))


@query(
    "agg24_parity",
    f"WITH {_LOGITS}, r AS (SELECT vec_id, token, logit, round(logit, 1) AS other FROM logits) SELECT round(max(abs(logit - other)), 6) AS max_abs, round(avg(abs(logit - other)), 6) AS mean_abs, round(max(abs(logit - other)) / greatest(max(abs(other)), 1e-12), 6) AS relative FROM r",
)
def parity(spark: SparkSession, d: str) -> DataFrame:
    both = logits(spark, d).withColumn("other", F.round("logit", 1))
    return M.compared(both, "logit", "other").select(*[F.round(c, 6).alias(c) for c in ("max_abs", "mean_abs", "relative")])


@query("agg24_argmax_agreement", f"WITH {_LOGITS}, b AS (SELECT vec_id, arg_max(token, (logit, -token)) AS x, arg_max(token, (round(logit, 1), -token)) AS y FROM logits GROUP BY vec_id) SELECT round(count_if(x = y) / count(*), 9) AS agreement FROM b")
def argmax_agreement(spark: SparkSession, d: str) -> DataFrame:
    best = logits(spark, d).groupBy("vec_id").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("x"), F.max_by("token", F.struct(F.round("logit", 1), -F.col("token"))).alias("y"))
    return best.agg(F.round(F.count_if(F.col("x") == F.col("y")) / F.count(F.lit(1)), 9).alias("agreement"))


@query(
    "agg25_region_accuracy",
    f"""WITH {_CHARS}, m AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS guess, last_value(CASE WHEN token IN (45, 47) THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM chars)
SELECT doc_id, coalesce(round(count(*) FILTER (WHERE coalesce(mark = 45, false) AND guess = token) / nullif(count(*) FILTER (WHERE coalesce(mark = 45, false)), 0), 9), 'nan'::DOUBLE)::VARCHAR = 'nan' AS undefined, count(*) FILTER (WHERE coalesce(mark = 45, false) AND guess = token) AS correct FROM m GROUP BY doc_id""",
)
def region_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Guesses right within regions; the accuracy is no number where a document has none."""
    guessed = _chars(spark, d).withColumn("guess", F.lag("token").over(Window.partitionBy("doc_id").orderBy("pos")))
    inside = D.in_region(guessed, ["doc_id"], "pos", "token", 45, 47)
    hit, n = F.count_if(F.col("inside") & (F.col("guess") == F.col("token"))), F.count_if("inside")
    rate = F.coalesce(F.try_divide(hit, n), F.lit(float("nan")))
    return inside.groupBy("doc_id").agg(F.isnan(rate).alias("undefined"), hit.alias("correct"))


@query("agg26_decode_speed", "SELECT user_id, round(1 / min(value), 6) AS per_second FROM events WHERE value > 0 GROUP BY user_id")
def decode_speed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value > 0").groupBy("user_id").agg(F.round(1 / F.min("value"), 6).alias("per_second"))


@query("agg27_speedup", "WITH m AS (SELECT avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events) SELECT round(1000 / a, 6) AS floor_per_second, round(b / a, 6) AS speedup FROM m")
def speedup(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a second at one commit a step, and how much faster one side is."""
    mean = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    return table(spark, d, "events").agg(mean(0).alias("a"), mean(1).alias("b")).select(F.round(1000 / F.col("a"), 6).alias("floor_per_second"), F.round(F.col("b") / F.col("a"), 6).alias("speedup"))


@query("snk9_keep_latest", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 2")
def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """Files to delete when the two newest of each folder stay; orders stand for files."""
    files = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return M.superseded(files, "o_orderpriority", [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_orderpriority", "o_orderkey")


_RUNS = "runs AS (SELECT o_custkey AS grid, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'stage_2_offload' WHEN 1 THEN 'stage_2' ELSE 'stage_3' END AS strategy, floor(o_totalprice / 20000)::INTEGER AS batch, o_totalprice > 200000 AS oom FROM orders)"


@query(
    "flt12_frontier",
    f"""WITH {_RUNS}, k AS (SELECT *, min(CASE WHEN oom THEN batch END) OVER (PARTITION BY strategy = 'stage_2_offload' ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM runs)
SELECT seq, coalesce(strategy IN ('stage_2', 'stage_2_offload') AND batch >= known, false) AS skipped FROM k""",
)
def frontier(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark grid whose larger configurations are skipped once one ran out of memory."""
    kind = F.element_at(F.array(F.lit("stage_2_offload"), F.lit("stage_2"), F.lit("stage_3")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), kind.alias("strategy"), F.floor(F.col("o_totalprice") / 20000).cast("int").alias("batch"), (F.col("o_totalprice") > 200000).alias("oom"))
    return M.oom_frontier(runs).select("seq", "skipped")


@query("flt13_samples", "SELECT event_id, value FROM events WHERE value > 0.05")
def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value > 0.05").select("event_id", "value")


_LINE = "'step ' || event_id || ' s/step=' || round(value, 3)::DECIMAL(18,3)::VARCHAR || ' Kt/s=' || round(value * 2, 2)::DECIMAL(18,2)::VARCHAR || CASE WHEN event_id % 11 = 0 THEN ' CUDA out of memory' ELSE '' END"


@query("prj21_log_lines", f"WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT event_id, regexp_extract(line, 's/step=([0-9.]+)', 1)::DOUBLE AS s_per_step, regexp_extract(line, 'Kt/s=([0-9.]+)', 1)::DOUBLE AS kt_per_s, regexp_matches(line, '(?i)out of memory') AS oom FROM l")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Step times, throughput and failures read from log lines."""
    number = lambda x, k: F.round(x, k).cast(f"decimal(18,{k})").cast("string")
    oom = F.when(F.col("event_id") % 11 == 0, " CUDA out of memory").otherwise("")
    line = F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" s/step="), number(F.col("value"), 3), F.lit(" Kt/s="), number(F.col("value") * 2, 2), oom)
    lines = table(spark, d, "events").select("event_id", line.alias("line"))
    field = lambda p: F.try_to_number(F.nullif(F.regexp_extract("line", p, 1), F.lit("")), F.lit("999999999.999")).cast("double")
    return lines.select("event_id", field(r"s/step=([0-9.]+)").alias("s_per_step"), field(r"Kt/s=([0-9.]+)").alias("kt_per_s"), F.col("line").rlike("(?i)out of memory").alias("oom"))


@query("snk7_train_log", "WITH e AS (SELECT user_id AS epoch, avg(value) AS loss FROM events GROUP BY user_id) SELECT epoch, epoch || ' ' || round(loss, 6)::DECIMAL(18,6)::VARCHAR || ' ' || round(exp(loss / 100), 4)::DECIMAL(18,4)::VARCHAR || ' ' || epoch AS line FROM e")
def train_log(spark: SparkSession, d: str) -> DataFrame:
    """One line an epoch: number, loss, perplexity, number.  The loss is scaled here so that its exponential is moderate."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("epoch")).agg(F.avg("value").alias("loss"))
    text = lambda x, k: F.round(x, k).cast(f"decimal(18,{k})").cast("string")
    return e.select("epoch", F.concat_ws(" ", F.col("epoch").cast("string"), text(F.col("loss"), 6), text(F.exp(F.col("loss") / 100), 4), F.col("epoch").cast("string")).alias("line"))


@query("win12_shift", "SELECT event_id, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM events")
def shift(spark: SparkSession, d: str) -> DataFrame:
    """Each value with the one before it in its sequence, zero at the start."""
    before = F.lag("value", 1, 0.0).over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", "value", before.alias("before"))
