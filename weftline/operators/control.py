"""Task selection, overrides and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(tasks: DataFrame, names: str, column: str = "task") -> DataFrame:
    """Tasks named in a comma list; an empty list selects all."""
    if not names.strip():
        return tasks
    return tasks.where(F.array_contains(F.split(F.lit(names), r"\s*,\s*"), F.col(column)))


def unfinished(tasks: DataFrame, outputs: DataFrame, column: str = "task") -> DataFrame:
    """Tasks without any output yet."""
    return tasks.join(outputs.select(column).distinct(), column, "left_anti")


def presets(configs: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Configurations by name; an unknown name is an error."""
    wanted = configs.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    found = wanted.join(configs.withColumn("__known", F.lit(True)), column, "left")
    known = F.coalesce("__known", F.raise_error(F.concat(F.lit("unknown preset: "), column)).cast("boolean"))
    return found.where(known).drop("__known")


def overridden(general: Column, own: Column) -> Column:
    """Two maps in one; the own value wins."""
    return F.map_zip_with(general, own, lambda k, a, b: F.coalesce(b, a))


def inherited(children: DataFrame, templates: DataFrame, include: str, columns: list[str]) -> DataFrame:
    """Children with the values of the template they include where they have none."""
    base = templates.select(F.col("template").alias(include), *[F.col(c).alias(f"__{c}") for c in columns])
    rest = [c for c in children.columns if c not in columns]
    return children.join(base, include, "left").select(*rest, *[F.coalesce(c, f"__{c}").alias(c) for c in columns])


def combined(wanted: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """The value held for each wanted name; a name without one is an error that tells it."""
    found = wanted.select(key).join(held.select(key, value, F.lit(True).alias("__held")), key, "left")
    ok = F.coalesce("__held", F.raise_error(F.concat(F.lit("nothing is held for "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(ok).drop("__held")


def repeated(df: DataFrame, times: int, attempt: str = "attempt") -> DataFrame:
    """Each row ``times`` times with the number of the attempt."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(attempt))


def knobs(**values: Column) -> Column:
    """Settings as one line."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in values.items()])


def prefetch_plan(catalog: DataFrame, wanted: list[str] | None = None, skip_gated: bool = False) -> DataFrame:
    """``catalog(name, path, config, gated)`` with ``action``: ``fetch``, or ``skip`` for a gated one; names not wanted drop out."""
    named = catalog if wanted is None else catalog.where(F.col("name").isin(wanted))
    return named.withColumn("action", F.when(F.col("gated") & F.lit(skip_gated), "skip").otherwise("fetch"))


def prefetch_outcome(attempts: DataFrame) -> DataFrame:
    """``(failures, exit_code)`` of ``attempts(path, config, gated, ok)``.

    Failures are listed as ``path:config``; failures of gated datasets alone, as of none, give 0.
    """
    failed = ~F.coalesce("ok", F.lit(False))
    label = F.concat_ws(":", "path", F.coalesce("config", F.lit("None")))
    hard = F.count_if(failed & ~F.coalesce("gated", F.lit(False)))
    return attempts.agg(F.sort_array(F.collect_list(F.when(failed, label))).alias("failures"), F.when(hard > 0, 1).otherwise(0).alias("exit_code"))
