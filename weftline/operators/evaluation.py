"""Metrics over tasks, repeats and task groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of ``k`` draws of ``n`` attempts with ``c`` passes is a pass; 1 when fewer than ``k`` fail."""
    factors = F.transform(F.sequence(n - c + 1, n), lambda i: F.lit(1.0) - F.lit(float(k)) / i)
    missed = F.aggregate(factors, F.lit(1.0), lambda a, x: a * x)
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - missed)


def weighted_rollup(leaves: DataFrame, levels: list[str], metric: str = "metric", value: str = "value", weight: str = "n") -> DataFrame:
    """Means of a metric weighted by size at every level; ``level`` is the grouping id, 0 for leaves.

    One rollup gives all levels; leaves without a value do not count.
    """
    sized = leaves.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    sets = [levels[:i] for i in range(len(levels), -1, -1)]
    out = sized.groupingSets([[F.col(metric), *map(F.col, s)] for s in sets], F.col(metric), *map(F.col, levels))
    return out.agg(F.grouping_id(metric, *levels).cast("bigint").alias("level"), F.sum(weight).alias("n"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"))


def first_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """First rows of each group.  The rank limit is pushed below the shuffle, so a hot group sends ``n`` rows a task."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def few_shot(docs: DataFrame, demos: DataFrame, by: str, order: str, text: str, n: int, delimiter: str = "\n\n") -> DataFrame:
    """Add ``prompt``: the first ``n`` demonstrations of the group, then the document's text.  Groups without any keep it alone."""
    head = first_n(demos.select(by, order, F.col(text).alias("__demo")), by, order, n)
    joined = head.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "__demo"))).alias("__demos"))
    each = docs.join(joined, by, "left")
    before = F.coalesce(F.transform("__demos", lambda s: s["__demo"]), F.array().cast("array<string>"))
    return each.withColumn("prompt", F.array_join(F.concat(before, F.array(text)), delimiter)).drop("__demos")


def summary(metrics: DataFrame, task: str = "task") -> DataFrame:
    """``(task, metrics)``: a JSON object of sorted names and numbers with nine decimals.

    Null values and names that begin with ``alias`` are left out.
    """
    kept = metrics.where(F.col("value").isNotNull() & ~F.startswith("metric", F.lit("alias")))
    entries = kept.groupBy(task).agg(F.array_sort(F.collect_set(F.struct("metric", "value"))).alias("e"))
    name = lambda m: F.replace(F.replace(m, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform("e", lambda x: F.concat(F.lit('"'), name(x["metric"]), F.lit('":'), x["value"].cast("decimal(28,9)").cast("string")))
    return entries.select(task, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("metrics"))
