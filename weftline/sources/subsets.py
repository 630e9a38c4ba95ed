"""Datasets by name and in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed names of the variants of a reasoning chat dataset and their files.
VARIANTS = {"full": "full_train.jsonl", "instruct": "instruct_train.jsonl", "roleplay": "roleplay_train.jsonl", "code": "code_train.jsonl"}


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A dataset by the kind of its file; JSON lines need a schema, nothing is inferred."""
    if path.endswith((".parquet", "/")):
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError("a schema is needed for JSON lines")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_variant(spark: SparkSession, folder: str, schema: T.StructType | str, variant: str = "full", data_file: str | None = None) -> DataFrame:
    """A named variant; an explicit ``data_file`` comes before the name."""
    if data_file is None and variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant!r}")
    return read(spark, f"{folder}/{data_file or VARIANTS[variant]}", schema)


def concatenated(frames: list[DataFrame], ordinal: str = "source_ord") -> DataFrame:
    """All rows of all frames; ``ordinal`` tells the frame, as rows have no order of their own."""
    return reduce(DataFrame.unionByName, [f.withColumn(ordinal, F.lit(i)) for i, f in enumerate(frames)])


def mirrored(spark: SparkSession, source: str, target: str, names: list[str]) -> DataFrame:
    """Copy the folders of ``source`` that ``target`` lacks: ``(name, action)``, ``copied``, ``kept`` or ``missing``.

    A folder that is there already is kept as it is, so a second call copies nothing.
    """
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    out = []
    for name in names:
        a, b = path(f"{source}/{name}"), path(f"{target}/{name}")
        here, there = a.getFileSystem(conf), b.getFileSystem(conf)
        if not here.exists(a):
            action = "missing"
        elif there.exists(b):
            action = "kept"
        else:
            there.mkdirs(b.getParent())
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(here, a, there, b, False, conf)
            action = "copied"
        out.append((name, action))
    return spark.createDataFrame(out, "name string, action string")
