"""Logits: embeddings stand for rows of logits over 64 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.numbers import sql_uniform, uniform
from weftline.operators import decode as D
from weftline.plans.registry import query, table
from weftline.plans.sampling import char_streams

_LOGITS = "logits AS (SELECT vec_id, (i - 1)::INTEGER AS token, embedding[i]::DOUBLE AS logit FROM embeddings, range(1, 65) r(i))"
_PROBS = f"{_LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM logits), probs AS (SELECT vec_id, token, logit, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM e)"


def logits(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))
    return wide.withColumn("logit", F.col("logit").cast("double"))


def probs(spark: SparkSession, d: str) -> DataFrame:
    return D.softmax(logits(spark, d), ["vec_id"])


@query("arr11_softmax", f"WITH {_PROBS} SELECT vec_id, token, round(prob, 9) AS prob FROM probs")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    return probs(spark, d).select("vec_id", "token", F.round("prob", 9).alias("prob"))


_PEN = "CASE WHEN token IN (62, 63) THEN '-inf'::DOUBLE ELSE logit - (CASE WHEN token % 3 > 0 THEN 0.5 ELSE 0.0 END + 0.25 * (token % 3)) END"


@query(
    "arr10_penalties",
    f"WITH {_LOGITS}, p AS (SELECT vec_id, token, ({_PEN}) / 0.7 AS z FROM logits), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM p) SELECT vec_id, token, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS prob FROM e",
)
def penalties(spark: SparkSession, d: str) -> DataFrame:
    """Tokens seen up to twice, two ids suppressed, a temperature of 0.7."""
    z = D.suppressed(D.penalized(F.col("logit"), (F.col("token") % 3).cast("double"), 0.5, 0.25), F.col("token"), (62, 63))
    return D.softmax(logits(spark, d).withColumn("logit", z), ["vec_id"], temperature=0.7).select("vec_id", "token", F.round("prob", 9).alias("prob"))


@query("srt5_topk", f"WITH {_LOGITS}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM logits) SELECT vec_id, token FROM r WHERE r <= 5")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return D.top_k(logits(spark, d), ["vec_id"], 5).select("vec_id", "token")


@query("win7_nucleus", f"WITH {_PROBS}, c AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM probs) SELECT vec_id, token FROM c WHERE before <= 0.7")
def nucleus(spark: SparkSession, d: str) -> DataFrame:
    return D.nucleus(probs(spark, d), ["vec_id"], 0.7).select("vec_id", "token")


@query(
    "win8_nucleus_by_value",
    f"""WITH {_PROBS}, c AS (SELECT *, sum(prob) OVER (PARTITION BY vec_id ORDER BY prob DESC, token ROWS UNBOUNDED PRECEDING) AS cum FROM probs), k AS (SELECT *, max(prob) FILTER (WHERE cum >= 0.5) OVER (PARTITION BY vec_id) AS cut FROM c),
z AS (SELECT *, CASE WHEN prob < cut THEN 0 ELSE prob END AS p FROM k), t AS (SELECT *, sum(CASE WHEN p = cut THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id) AS tied, sum(p) OVER (PARTITION BY vec_id) AS total FROM z)
SELECT vec_id, token, round(pow(CASE WHEN p = cut THEN cut + (0.5 - total) / tied ELSE p END, 1 / 0.8::DOUBLE), 8) AS prob FROM t""",
)
def nucleus_by_value(spark: SparkSession, d: str) -> DataFrame:
    return D.nucleus_by_value(probs(spark, d), ["vec_id"], 0.5, 0.8).select("vec_id", "token", F.round("prob", 8).alias("prob"))


@query("agg17_argmax", f"WITH {_LOGITS} SELECT vec_id, arg_max(token, (logit, -token)) AS best FROM logits GROUP BY vec_id")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    """Largest logit, the first among equals."""
    return logits(spark, d).groupBy("vec_id").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("best"))


_U = sql_uniform("vec_id", "0", "0", 31)


@query("arr14_draw", f"WITH {_PROBS}, c AS (SELECT vec_id, token, sum(prob) OVER (PARTITION BY vec_id ORDER BY token) / sum(prob) OVER (PARTITION BY vec_id) AS cum FROM probs) SELECT vec_id, min(token) AS token FROM c WHERE cum > {_U} GROUP BY vec_id")
def draw(spark: SparkSession, d: str) -> DataFrame:
    """Drawn by inverse distribution with a hashed uniform number."""
    return D.drawn(probs(spark, d), ["vec_id"], uniform(F.col("vec_id"), 0, F.lit(0), 31))


_STEP = f"{_PROBS}, pred AS (SELECT vec_id, vec_id // 16 AS block, vec_id % 16 AS pos, max(prob) AS confidence, vec_id % 3 <> 0 AS is_masked FROM probs GROUP BY vec_id)"


def _step(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen positions a block, a third of them clean already."""
    pred = probs(spark, d).groupBy("vec_id").agg(F.max("prob").alias("confidence"))
    return pred.select("vec_id", F.expr("vec_id div 16").alias("block"), (F.col("vec_id") % 16).alias("pos"), "confidence", (F.col("vec_id") % 3 != 0).alias("is_masked"))


@query(
    "arr12_threshold_commit",
    f"""WITH {_STEP}, s AS (SELECT *, is_masked AND confidence > 0.06 AS above FROM pred), r AS (SELECT *, sum(above::INT) OVER (PARTITION BY block) AS n, row_number() OVER (PARTITION BY block ORDER BY is_masked DESC, confidence DESC, pos) AS k FROM s)
SELECT block, pos, CASE WHEN n >= 4 THEN above ELSE is_masked AND k <= 4 END AS commit FROM r""",
)
def threshold_commit(spark: SparkSession, d: str) -> DataFrame:
    return D.committed(_step(spark, d), ["block"], 0.06, 4, 16).select("block", "pos", "commit")


@query(
    "arr13_linear_commit",
    f"""WITH {_STEP}, r AS (SELECT *, sum((NOT is_masked)::INT) OVER (PARTITION BY block) AS clean, row_number() OVER (PARTITION BY block ORDER BY is_masked DESC, confidence DESC, pos) AS k FROM pred)
SELECT block, pos, is_masked AND k <= greatest(0, least(floor(16.0 * 5 / 8), 16) - clean) AS commit FROM r""",
)
def linear_commit(spark: SparkSession, d: str) -> DataFrame:
    return D.committed_linear(_step(spark, d), ["block"], F.lit(5), 8, 16).select("block", "pos", "commit")


@query("srt6_top_confident", f"WITH {_STEP}, r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY confidence DESC, pos) AS k FROM pred) SELECT block, pos FROM r WHERE k <= 3")
def top_confident(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("block").orderBy(F.desc("confidence"), "pos")
    return _step(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("block", "pos")


_CHARS = "cut AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE text <> ''), chars AS (SELECT doc_id, pos - 1 AS pos, unicode(ch) % 60000 + 1 AS token FROM (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) AS pos FROM cut))"


def _chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters by position, as a generation would emit them."""
    return char_streams(spark, d).select("doc_id", F.posexplode("tokens").alias("pos", "token")).where("token <> 0")


@query(
    "win9_decayed_counts",
    f"""WITH {_CHARS}, n AS (SELECT doc_id, pos // 64 AS block, token, count(*) AS n FROM chars GROUP BY ALL), m AS (SELECT doc_id, max(block) AS last FROM n GROUP BY doc_id)
SELECT doc_id, token, round(sum(n * pow(0.5, last - block)), 6) AS count FROM n JOIN m USING (doc_id) GROUP BY doc_id, token""",
)
def decayed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts after the last block of 64 characters."""
    blocks = _chars(spark, d).select("doc_id", F.expr("pos div 64").alias("block"), "token")
    return D.decayed_counts(blocks, ["doc_id"], 0.5).select("doc_id", "token", F.round("count", 6).alias("count"))


@query(
    "win10_region",
    f"""WITH {_CHARS}, m AS (SELECT *, last_value(CASE WHEN token IN (45, 47) THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM chars)
SELECT doc_id, count_if(coalesce(mark = 45, false)) AS inside, coalesce(sum(pos) FILTER (WHERE coalesce(mark = 45, false)), 0)::BIGINT AS places FROM m GROUP BY doc_id""",
)
def region(spark: SparkSession, d: str) -> DataFrame:
    """Characters after a comma up to the next full stop."""
    inside = D.in_region(_chars(spark, d), ["doc_id"], "pos", "token", 45, 47)
    return inside.groupBy("doc_id").agg(F.count_if("inside").alias("inside"), F.sum(F.when(F.col("inside"), F.col("pos")).otherwise(0)).alias("places"))


@query("flt10_eos_truncate", "SELECT doc_id, CASE WHEN instr(text, '.') > 0 THEN instr(text, '.') - 1 ELSE least(length(text), 64) END::BIGINT AS kept, CASE WHEN instr(text, '.') > 0 THEN 'stop' ELSE 'length' END AS finish FROM documents WHERE text <> ''")
def eos_truncate(spark: SparkSession, d: str) -> DataFrame:
    """A full stop stands for the end token."""
    tokens, finish = D.truncated(F.slice("tokens", F.lit(1), F.size("tokens") - 1), 64, 47)
    return char_streams(spark, d).select("doc_id", F.size(tokens).cast("bigint").alias("kept"), finish.alias("finish"))


@query("win6_first_marker", "SELECT doc_id, instr(text, '.')::BIGINT AS first_stop FROM documents WHERE text <> ''")
def first_marker(spark: SparkSession, d: str) -> DataFrame:
    return char_streams(spark, d).select("doc_id", F.array_position("tokens", 47).alias("first_stop"))


@query("flt9_text_ids", "SELECT doc_id, length(regexp_replace(text, '[ea]', '', 'g'))::BIGINT AS kept FROM documents WHERE text <> ''")
def text_ids(spark: SparkSession, d: str) -> DataFrame:
    """Two letters stand for the special ids."""
    return char_streams(spark, d).select("doc_id", (F.size(D.text_ids(F.col("tokens"), (102, 98))) - 1).cast("bigint").alias("kept"))
