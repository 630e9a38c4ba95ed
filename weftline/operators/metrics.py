"""Training and benchmark metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100


def masked_cross_entropy(nll: Column, target: Column) -> Column:
    """Sum over supervised positions by their number, at least one."""
    valid = target != IGNORE
    return F.coalesce(F.sum(F.when(valid, nll)), F.lit(0.0)) / F.greatest(F.count_if(valid), F.lit(1))


def masked_accuracy(best: Column, target: Column) -> Column:
    valid = target != IGNORE
    return F.count_if(valid & (best == target)) / F.greatest(F.count_if(valid), F.lit(1))


def selective_entropy(entropy: Column, best: Column, target: Column) -> Column:
    """Mean entropy of supervised positions predicted right; 0 without any."""
    return F.coalesce(F.avg(F.when((target != IGNORE) & (best == target), entropy)), F.lit(0.0))


def position_stats(logits: DataFrame, key: str, target: Column, token: str = "token", logit: str = "logit") -> DataFrame:
    """``(key, target, nll, entropy, best)``: one pass over the logits of each position."""
    w = Window.partitionBy(key)
    z = logits.withColumn("__z", F.col(logit) - F.max(logit).over(w)).withColumn("__y", target)
    top = F.max_by(token, F.struct(logit, -F.col(token)))
    agg = z.groupBy(key).agg(F.max("__y").alias("target"), F.log(F.sum(F.exp("__z"))).alias("__lse"), F.sum(F.exp("__z") * F.col("__z")).alias("__ez"), F.max(F.when(F.col(token) == F.col("__y"), F.col("__z"))).alias("__zy"), top.alias("best"))
    return agg.select(key, "target", (F.col("__lse") - F.col("__zy")).alias("nll"), (F.col("__lse") - F.col("__ez") / F.exp("__lse")).alias("entropy"), "best")


def checkpoint_number(name: Column) -> Column:
    """Number in the name of a checkpoint: -1 for the initial one, null for the final one and other names."""
    digits = F.regexp_extract(name, r"-(\d+)\.\w+$", 1)
    return F.when(name.rlike(r"-init\.\w+$"), F.lit(-1)).when(digits != "", F.try_to_number(digits, F.lit("9999999999")).cast("int"))


def latest_two(df: DataFrame, name: str) -> DataFrame:
    """``(latest, previous)`` checkpoint numbers."""
    n = df.select(checkpoint_number(F.col(name)).alias("n")).where("n is not null").distinct()
    two = n.orderBy(F.desc("n")).limit(2)
    return two.agg(F.max("n").alias("latest"), F.when(F.count(F.lit(1)) == 2, F.min("n")).alias("previous"))


def superseded(df: DataFrame, by: str, newest: list[Column], keep: int) -> DataFrame:
    """Rows beyond the ``keep`` newest of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).where(F.col("__r") > keep).drop("__r")


def oom_frontier(runs: DataFrame, order: str = "seq", strategy: str = "strategy", batch: str = "batch", oom: str = "oom", apart: str = "stage_2_offload", plain: str = "stage_2") -> DataFrame:
    """Add ``skipped``: runs at or above the smallest batch that ran out of memory before.

    The offload strategy has a frontier of its own; all others feed the one that only the plain strategy heeds.
    """
    w = Window.partitionBy(F.col(strategy) == apart).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.min(F.when(F.col(oom), F.col(batch))).over(w)
    return runs.withColumn("skipped", F.coalesce(F.col(strategy).isin(apart, plain) & (F.col(batch) >= known), F.lit(False)))


def compared(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(max_abs, mean_abs, relative)`` of two numeric columns; our own difference tool."""
    delta = F.abs(F.col(a) - F.col(b))
    return df.agg(F.max(delta).alias("max_abs"), F.avg(delta).alias("mean_abs"), (F.max(delta) / F.greatest(F.max(F.abs(F.col(b))), F.lit(1e-12))).alias("relative"))


def sweep_report(runs: DataFrame, title: str, settings: str, prompt: str) -> DataFrame:
    """``(ord, block)``: a Markdown report, a head and one section for each of ``runs(ord, name, knobs, text, finish, n_tokens, seconds, error)``.

    ``ord`` counts from 1; a run with an ``error`` shows its kind and message in place of the text.  The blocks in order are the file.
    """
    fence = lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```\n\n"))
    kind = F.regexp_extract("error", r"^\w+", 0)
    status = F.when(F.col("error").isNull(), F.concat(F.lit("OK ["), "finish", F.lit(", "), F.col("n_tokens").cast("string"), F.lit(" tok]"))).otherwise(F.concat(F.lit("FAIL: "), kind))
    seconds = F.round("seconds", 1).cast("decimal(18,1)").cast("string")
    top = F.concat(F.lit("## "), F.col("ord").cast("string"), F.lit(". `"), "name", F.lit("`  ("), status, F.lit(", "), seconds, F.lit("s)\n\n"))
    sections = runs.select(F.col("ord").cast("int").alias("ord"), F.concat(top, fence(F.col("knobs")), fence(F.coalesce("error", "text", F.lit(""))), F.lit("---\n\n")).alias("block"))
    head = runs.sparkSession.createDataFrame([(0, f"# {title}\n\n{settings}\n- **prompt**:\n\n```\n{prompt}\n```\n\n")], "ord int, block string")
    return head.unionByName(sections)


def write_report(blocks: DataFrame, path: str) -> None:
    """The blocks of a report in order, as one text file in a folder."""
    blocks.coalesce(1).sortWithinPartitions("ord").select(F.regexp_replace("block", r"\n\z", "")).write.text(path)
