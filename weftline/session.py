"""Session defaults and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the library is tested with.  Partition counts are left to AQE on a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset and all runs on one machine (tests), a local one is set; on a cluster that is an error, as a
    folder of one machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = default_dir(spark.sparkContext.master)
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def default_dir(master: str) -> str:
    """The folder where none is named, by the master's URL."""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "weftline-shared")


_made: dict[str, list[str]] = {}


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by ``workspace`` or when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at its end; write or collect results before."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        for path in made[before:]:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        del made[before:]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: executors lost afterwards cost a re-read of files, not a recomputation.
    """
    path = own_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores where its files give fewer tasks than half of them.

    Meant for small inputs in one file before heavy work on each row; an input of many files stays as it is.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or 2 * len(files) >= cores:
        return df
    path, hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), spark._jsparkSession.sessionState().conf()
    sizes = [path(f).getFileSystem(hadoop).getFileStatus(path(f)).getLen() for f in files]
    split = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), sum(sizes) // cores), sum(sizes) or 1)
    return df.repartition(cores) if 2 * sum(-(-n // split) for n in sizes) < cores else df
