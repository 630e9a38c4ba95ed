"""Task configurations and result files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "task string, num_fewshot int, unsafe_code boolean, fewshot_as_multiturn boolean, max_gen_toks int, gen_kwargs map<string,string>"


def _value(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_mapping(text: str) -> dict:
    """A mapping of mappings by indentation: the part of YAML that task files use."""
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent = len(bare) - len(bare.lstrip())
        key, colon, value = bare.strip().partition(":")
        if not colon:
            raise ValueError(f"not a mapping: {line!r}")
        while levels[-1][0] >= indent:
            levels.pop()
        if value.strip():
            levels[-1][1][key.strip()] = _value(value)
        else:
            levels[-1][1][key.strip()] = child = {}
            levels.append((indent, child))
    return root


def task_rows(text: str) -> list[tuple]:
    """One row a task; a blank inside a generation argument is an error."""
    rows = []
    for task, c in parse_mapping(text).get("tasks", {}).items():
        kwargs = {k: str(v) for k, v in (c.get("gen_kwargs") or {}).items()}
        if bad := [k for k, v in kwargs.items() if " " in v]:
            raise ValueError(f"blank in gen_kwargs of {task}: {bad}")
        rows.append((task, c.get("num_fewshot"), bool(c.get("unsafe_code")), bool(c.get("fewshot_as_multiturn")), c.get("max_gen_toks"), kwargs))
    return rows


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(task_rows(f.read()), TASK)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, results, error)`` of all result files below a folder but summaries; unreadable ones get an error."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    named = files.select(F.input_file_name().alias("path"), "value").where(~F.endswith("path", F.lit("/summary.json")))
    parsed = named.select("path", F.from_json("value", "results map<string, map<string, string>>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("path", "r.results", F.when(F.col("r._corrupt").isNotNull(), F.lit("unreadable")).alias("error"))


def write_results(df: DataFrame, folder: str) -> None:
    """Rows as JSON in one folder a task."""
    df.write.partitionBy("task").json(folder)


def write_samples(df: DataFrame, folder: str) -> None:
    """The answers and scores of ``df(task, ...)`` as JSON lines, in ``samples_<task>.jsonl`` below ``folder/file=...``."""
    named = df.withColumn("file", F.concat(F.lit("samples_"), "task", F.lit(".jsonl")))
    named.repartition("file").write.partitionBy("file").json(folder)


def read_samples(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The samples of all tasks; ``file`` tells whose they are."""
    return spark.read.schema(f"{schema}, file string").json(folder)


def materialized(template: str, **values: object) -> str:
    """A configuration with its ``__NAME__`` placeholders filled in; a placeholder without a value is an error."""
    for name, value in values.items():
        template = template.replace(f"__{name}__", str(value))
    if left := re.findall(r"__[A-Z][A-Z0-9_]*?__", template):
        raise ValueError(f"no value for {sorted(set(left))}")
    return template


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
