"""Incremental ingestion of segment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.jsonl import rows


def segment_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Segments of JSON-lines files as they arrive: a map over lines, so there is no state to bound."""
    return rows(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Write what is new to Parquet and stop; the checkpoint makes finished files stay finished."""
    stream = segment_stream(spark, folder)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
