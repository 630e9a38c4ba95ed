"""Ranks and prefix sums over a whole table without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import staged


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", total: Column | None = None, total_name: str = "before") -> DataFrame:
    """Add the 0-based ``rank`` of each row within ``keys`` by ``order``, and optionally the exclusive prefix sum of ``total``.

    Two passes: rows are range-partitioned by keys and order and numbered within each partition; the sizes of
    the (partition, keys) pieces, of which there are at most one more per partition than there are keys, give
    the offsets.  However large a group is, it is spread over as many partitions as its rows need.  ``order``
    must be unique within ``keys``.
    """
    part, local, value = "__part", "__local", "__value"
    spread = df.withColumn(value, total if total is not None else F.lit(0))
    spread = staged(spread.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranked")
    inner = Window.partitionBy(part, *keys).orderBy(*order)
    numbered = spread.withColumn(local, F.row_number().over(inner) - 1)
    if total is not None:
        numbered = numbered.withColumn(total_name, F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = spread.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__s"))
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*keys, part, F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__before_n"), F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__before_s"))
    out = numbered.join(offsets, [*keys, part]).withColumn(rank, F.col(local) + F.col("__before_n"))
    if total is not None:
        out = out.withColumn(total_name, F.col(total_name) + F.col("__before_s"))
    return out.drop(part, local, value, "__before_n", "__before_s")
