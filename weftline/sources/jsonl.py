"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "segments array<struct<text: string, lossable: boolean>>, text string, meta string"


def rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of segment or legacy files; blank lines are skipped, a malformed line is an error."""
    parsed = lines.where(F.trim(F.col(line)) != "").select(F.from_json(line, ROW, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return parsed.select(with_fallback(F.col("segments"), F.col("text")).alias("segments"))


def with_fallback(segments: Column, text: Column) -> Column:
    """Segments as they are, a legacy text as one lossable segment, else an error."""
    legacy = F.array(F.struct(text.alias("text"), F.lit(True).alias("lossable")))
    tidy = F.transform(segments, lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["lossable"], F.lit(False)).alias("lossable")))
    missing = F.raise_error(F.lit("a row has neither segments nor text")).cast("array<struct<text: string, lossable: boolean>>")
    return F.when(segments.isNotNull(), tidy).when(text.isNotNull(), legacy).otherwise(missing)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Segments of one or several files."""
    return rows(spark.read.text(list(paths)))


def segment_lines(df: DataFrame, *keys: str) -> DataFrame:
    """``(keys, line)``: the line written for each row."""
    return df.select(*keys, F.to_json(F.struct("segments")).alias("line"))


def write(df: DataFrame, path: str) -> None:
    segment_lines(df).select(F.col("line").alias("value")).write.text(path)
