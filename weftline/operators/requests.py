"""Normalizing and checking chat requests, Column to Column.  Defaults and limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS, MAX_TOKENS_CAP = 2048, 16384
DEFAULTS = {"top_k": 50, "decode_strategy": "threshold", "conf_threshold": 0.9, "min_per_step": 0, "penalty_decay": 1.0, "penalize_prompt": False, "block_size": 32, "steps": 32}


def generation_length(completion: Column, legacy: Column) -> Column:
    """The newer limit before the older before the default, within 1 and the cap."""
    return F.greatest(F.lit(1), F.least(F.coalesce(completion, legacy, F.lit(MAX_TOKENS)), F.lit(MAX_TOKENS_CAP)))


def sampling(temperature: Column, top_p: Column, presence: Column, frequency: Column, extras: Column) -> dict[str, Column]:
    """Sampling parameters of a request; a missing, empty or unreadable extra gives its default."""

    def pick(name: str) -> Column:
        default = DEFAULTS[name]
        text = F.nullif(F.try_element_at(extras, F.lit(name)), F.lit(""))
        if isinstance(default, bool):
            return F.coalesce(F.lower(text).isin("true", "1"), F.lit(default))
        kind = {int: "int", float: "double", str: "string"}[type(default)]
        return F.coalesce(text.try_cast(kind), F.lit(default))

    direct = {"temperature": temperature, "top_p": top_p, "presence_penalty": presence, "count_penalty": frequency}
    return {k: F.coalesce(c, F.lit({"temperature": 1.0, "top_p": 0.7}.get(k, 0.0))) for k, c in direct.items()} | {k: pick(k) for k in DEFAULTS}


def rejection(stream: Column, n: Column, messages: Column, last_role: Column) -> tuple[Column, Column]:
    """The parameter and text of the first reason to reject a request; nulls for a good one."""
    why = [
        (F.coalesce(stream, F.lit(False)), "stream", "streaming is not supported by this server"),
        (F.coalesce(n, F.lit(1)) != 1, "n", "n > 1 is not supported by this server"),
        (F.coalesce(messages, F.lit(0)) == 0, "messages", "messages must be non-empty"),
        (F.coalesce(last_role, F.lit("")) != "user", "messages", "messages must end with a user message"),
    ]
    param = text = F.lit(None).cast("string")
    for bad, name, message in reversed(why):
        param, text = F.when(bad, name).otherwise(param), F.when(bad, message).otherwise(text)
    return param, text


def usage(prompt_tokens: Column, completion_tokens: Column) -> dict[str, Column]:
    return {"prompt_tokens": prompt_tokens, "completion_tokens": completion_tokens, "total_tokens": prompt_tokens + completion_tokens}


def append_speed(df: DataFrame, path: str) -> None:
    """Append ``df(n_completion, elapsed)`` to the speed log: lines of tokens generated and seconds taken, without a header."""
    df.select("n_completion", "elapsed").write.mode("append").csv(path)


def read_speed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n_completion bigint, elapsed double").csv(path)
