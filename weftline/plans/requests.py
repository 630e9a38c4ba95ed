"""Chat requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import merge_generation
from weftline.operators import requests as R
from weftline.plans.conversation import _CHOICES, choices, prompts
from weftline.plans.registry import SQL, TURNS, query, table, turns

_ONCE = "reqs AS (SELECT DISTINCT ON (request_id) * FROM chat_requests WHERE request_id IS NOT NULL)"
_COLUMNS = ["temperature", "top_p", "presence_penalty", "frequency_penalty", "max_tokens", "max_completion_tokens", "n", "stream", "extras"]


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests once each, however often they were delivered."""
    once = table(spark, d, "chat_requests").where("request_id is not null").groupBy("request_id").agg(F.first(F.struct(*_COLUMNS)).alias("r"))
    return once.select("request_id", "r.*")


@query("prj17_generation_length", f"WITH {_ONCE} SELECT request_id, greatest(1, least(coalesce(max_completion_tokens, max_tokens, 2048), 16384)) AS gen_len FROM reqs")
def generation_length(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("request_id", R.generation_length(F.col("max_completion_tokens"), F.col("max_tokens")).alias("gen_len"))


def _pick(name: str, kind: str, default: str) -> str:
    return f"coalesce(try_cast(nullif(map_extract(extras, '{name}')[1], '') AS {kind}), {default}) AS {name}"


@query(
    "prj18_sampling",
    f"""WITH {_ONCE} SELECT request_id, coalesce(temperature, 1.0) AS temperature, coalesce(top_p, 0.7) AS top_p, coalesce(presence_penalty, 0.0) AS presence_penalty, coalesce(frequency_penalty, 0.0) AS count_penalty,
{_pick("top_k", "INTEGER", "50")}, {_pick("decode_strategy", "VARCHAR", "'threshold'")}, {_pick("conf_threshold", "DOUBLE", "0.9::DOUBLE")}, {_pick("min_per_step", "INTEGER", "0")}, {_pick("penalty_decay", "DOUBLE", "1.0::DOUBLE")},
coalesce(lower(nullif(map_extract(extras, 'penalize_prompt')[1], '')) IN ('true', '1'), false) AS penalize_prompt, {_pick("block_size", "INTEGER", "32")}, {_pick("steps", "INTEGER", "32")} FROM reqs""",
)
def sampling(spark: SparkSession, d: str) -> DataFrame:
    cols = R.sampling(*map(F.col, ("temperature", "top_p", "presence_penalty", "frequency_penalty", "extras")))
    return requests(spark, d).select("request_id", *[c.alias(k) for k, c in cols.items()])


@query(
    "prj19_rejections",
    f"""WITH {TURNS}, {_ONCE}, m AS (SELECT request_id, count(*) AS messages, arg_max(role, (turn, message_id)) AS last_role FROM turns GROUP BY request_id), v AS (SELECT request_id, stream, n, coalesce(messages, 0) AS messages, last_role FROM reqs LEFT JOIN m USING (request_id))
SELECT request_id, CASE WHEN coalesce(stream, false) THEN 'stream' WHEN coalesce(n, 1) <> 1 THEN 'n' WHEN messages = 0 OR last_role <> 'user' THEN 'messages' END AS param,
CASE WHEN coalesce(stream, false) THEN 'streaming is not supported by this server' WHEN coalesce(n, 1) <> 1 THEN 'n > 1 is not supported by this server' WHEN messages = 0 THEN 'messages must be non-empty' WHEN last_role <> 'user' THEN 'messages must end with a user message' END AS message FROM v""",
)
def rejections(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each request, in the order of the checks."""
    held = turns(spark, d).groupBy("request_id").agg(F.count(F.lit(1)).alias("messages"), F.max_by("role", F.struct("turn", "message_id")).alias("last_role"))
    param, text = R.rejection(F.col("stream"), F.col("n"), F.col("messages"), F.col("last_role"))
    return requests(spark, d).join(held, "request_id", "left").select("request_id", param.alias("param"), text.alias("message"))


_MERGED = "CASE WHEN coalesce(reasoning_content, '') <> '' AND coalesce(content, '') <> '' THEN reasoning_content || chr(10) || chr(10) || content ELSE coalesce(reasoning_content, '') || coalesce(content, '') END"


@query(
    "prj20_usage",
    f"""WITH prompts AS ({SQL["prj8_prompt"]}), {_CHOICES}, u AS (SELECT completion_id, choice_index, length(prompt)::BIGINT AS p, length({_MERGED})::BIGINT AS c FROM choices JOIN prompts USING (request_id) WHERE prompt IS NOT NULL)
SELECT completion_id, choice_index, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM u""",
)
def usage(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of prompts and generations; characters stand for tokens."""
    each = choices(spark, d).join(prompts(spark, d).where("prompt is not null"), "request_id")
    sizes = R.usage(F.char_length("prompt").cast("bigint"), F.char_length(merge_generation(F.col("reasoning_content"), F.col("content"))).cast("bigint"))
    return each.select("completion_id", "choice_index", *[c.alias(k) for k, c in sizes.items()])
