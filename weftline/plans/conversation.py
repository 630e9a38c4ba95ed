"""Conversations: cleaning, segments, prompts, generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import segments as S
from weftline.plans.registry import TURNS, query, sql_answer, sql_clean, sql_reasoning, table, turns

_CLEAN = sql_clean("coalesce(content, '')")
_REASON, _ANSWER = sql_clean(sql_reasoning("coalesce(content, '')")), sql_clean(sql_answer("coalesce(content, '')"))
_CHAT_SQL = f"""
WITH {TURNS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY turn, message_id) AS i,
  first_value(role) OVER (PARTITION BY request_id ORDER BY turn, message_id) AS first_role FROM turns),
parts AS (
  SELECT DISTINCT request_id, 0 AS i, 0 AS part, 'System: You are a helpful assistant' AS text, false AS lossable FROM ordered WHERE first_role <> 'system'
  UNION ALL SELECT request_id, i, 1, chr(10) || chr(10), false FROM ordered WHERE i > 1 OR first_role <> 'system'
  UNION ALL SELECT request_id, i, 2, CASE role WHEN 'system' THEN 'System: ' ELSE 'User: ' END || {_CLEAN}, false FROM ordered WHERE role <> 'assistant'
  UNION ALL SELECT request_id, i, 2, 'Assistant: <think></think>' || chr(10), false FROM ordered WHERE role = 'assistant'
  UNION ALL SELECT request_id, i, 3, {_CLEAN}, true FROM ordered WHERE role = 'assistant')
"""
_REASONING_SQL = f"""
WITH {TURNS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY turn, message_id) AS i,
  first_value(role) OVER (PARTITION BY request_id ORDER BY turn, message_id) AS first_role FROM turns),
cut AS (SELECT request_id, role, i, first_role, {_CLEAN} AS cleaned, {_REASON} AS reasoning, {_ANSWER} AS answer,
  CASE WHEN first_role = 'system' THEN i - 1 ELSE i END AS k FROM ordered),
parts AS (
  SELECT request_id, 0 AS i, 0 AS part, 'System: ' || CASE WHEN first_role = 'system' THEN cleaned ELSE 'You are a helpful assistant' END || chr(10) || chr(10) AS text, false AS lossable FROM cut WHERE i = 1
  UNION ALL SELECT request_id, k, 1, chr(10) || chr(10), false FROM cut WHERE k > 1
  UNION ALL SELECT request_id, k, 2, CASE role WHEN 'system' THEN 'System: ' ELSE 'User: ' END || cleaned, false FROM cut WHERE role <> 'assistant' AND k >= 1
  UNION ALL SELECT request_id, k, 2, CASE WHEN reasoning <> '' THEN 'Assistant: <think>' ELSE 'Assistant: <think></think>' || chr(10) END, false FROM cut WHERE role = 'assistant' AND k >= 1
  UNION ALL SELECT request_id, k, 3, CASE WHEN reasoning <> '' THEN chr(10) || reasoning || chr(10) || '</think>' || chr(10) || answer ELSE answer END, true FROM cut WHERE role = 'assistant' AND k >= 1)
"""
_NUMBERED = "SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY i, part) - 1 AS INTEGER) AS seg_idx, text, lossable FROM parts"


@query("prj1_clean_txt", f"WITH {TURNS} SELECT message_id, {sql_clean('content')} AS cleaned FROM turns")
def clean_txt(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("message_id", T.clean_text(F.col("content")).alias("cleaned"))


@query("prj2_parse_think", f"WITH {TURNS} SELECT message_id, {sql_reasoning('content')} AS reasoning, {sql_answer('content')} AS answer FROM turns WHERE role = 'assistant'")
def parse_think(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("role = 'assistant'").select("message_id", T.reasoning_of(F.col("content")).alias("reasoning"), T.answer_of(F.col("content")).alias("answer"))


@query("prj3_segments", f"{_CHAT_SQL} {_NUMBERED}")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return S.exploded(S.conversations(turns(spark, d)), S.chat_segments(F.col("messages")), "request_id")


_PAIRS = f"""{TURNS}, follow AS (SELECT request_id, message_id, role, content, lead(role) OVER w AS next_role, lead(content) OVER w AS output FROM turns WINDOW w AS (PARTITION BY request_id ORDER BY turn, message_id)),
pairs AS (SELECT message_id, content AS input, output FROM follow WHERE role = 'user' AND next_role = 'assistant')"""


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns followed by an assistant turn, as single-turn pairs."""
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy("turn", "message_id")
    follow = turns(spark, d).select("message_id", "role", "content", F.lead("role").over(w).alias("next_role"), F.lead("content").over(w).alias("output"))
    return follow.where("role = 'user' and next_role = 'assistant'").select("message_id", F.col("content").alias("input"), "output")


_IN, _R, _A = sql_clean("coalesce(input, '')"), sql_clean(sql_reasoning("coalesce(output, '')")), sql_clean(sql_answer("coalesce(output, '')"))


@query(
    "prj4_pair_segments",
    f"""WITH {_PAIRS}, cut AS (SELECT message_id, {_IN} AS u, {_R} AS r, {_A} AS a FROM pairs)
SELECT message_id, 0 AS seg_idx, 'System: You are a helpful assistant' || chr(10) || chr(10) AS text, false AS lossable FROM cut
UNION ALL SELECT message_id, 1, 'User: ' || u || chr(10) || chr(10), false FROM cut
UNION ALL SELECT message_id, 2, CASE WHEN r <> '' THEN 'Assistant: <think>' ELSE 'Assistant: <think></think>' || chr(10) END, false FROM cut
UNION ALL SELECT message_id, 3, CASE WHEN r <> '' THEN chr(10) || r || chr(10) || '</think>' || chr(10) || a ELSE a END, true FROM cut""",
)
def pair_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.exploded(turn_pairs(spark, d), S.pair_segments(F.col("input"), F.col("output")), "message_id")


@query("prj5_reasoning_segments", f"{_REASONING_SQL} {_NUMBERED}")
def reasoning_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.exploded(S.conversations(turns(spark, d)), S.reasoning_segments(F.col("messages")), "request_id")


@query("prj7_flat_text", f"{_CHAT_SQL} SELECT request_id, string_agg(text, '' ORDER BY i, part) AS text FROM parts GROUP BY request_id")
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    return S.conversations(turns(spark, d)).select("request_id", S.flat_text(S.chat_segments(F.col("messages"))).alias("text"))


_REQUESTS = "reqs AS (SELECT request_id, any_value(reasoning_effort) AS effort FROM chat_requests WHERE request_id IS NOT NULL GROUP BY request_id)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_requests").where("request_id is not null").groupBy("request_id").agg(F.first("reasoning_effort").alias("effort"))


@query(
    "prj8_prompt",
    f"""WITH {TURNS}, {_REQUESTS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY turn, message_id) AS i FROM turns),
conv AS (SELECT request_id, arg_max(role, i) AS last_role, arg_min({sql_clean("coalesce(content, '')")}, i) FILTER (WHERE role = 'system') AS system,
  string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {_CLEAN} || chr(10) || chr(10), '' ORDER BY i) FILTER (WHERE role IN ('user', 'assistant')) AS body FROM ordered GROUP BY request_id)
SELECT request_id, CASE WHEN last_role = 'user' THEN
  CASE WHEN system IS NOT NULL THEN 'System: ' || system || chr(10) || chr(10) ELSE 'System: You are a helpful assistant. Think briefly and carefully without repeating words.' || chr(10) || chr(10) END
  || coalesce(body, '') || CASE WHEN effort IS NOT NULL AND effort <> 'minimal' THEN 'Assistant: <think>' ELSE 'Assistant: <think></think>' END END AS prompt
FROM conv JOIN reqs USING (request_id)""",
)
def prompts(spark: SparkSession, d: str) -> DataFrame:
    joined = S.conversations(turns(spark, d)).join(_requests(spark, d), "request_id")
    return joined.select("request_id", S.prompt(F.col("messages"), F.col("effort")).alias("prompt"))


_CHOICES = """once AS (SELECT DISTINCT ON (completion_id) completion_id, request_id, choices FROM chat_completions WHERE completion_id IS NOT NULL),
choices AS (SELECT completion_id, request_id, c."index" AS choice_index, c.message.content AS content, c.message.reasoning_content AS reasoning_content, c.finish_reason AS finish_reason FROM (SELECT completion_id, request_id, unnest(choices) AS c FROM once))"""


def choices(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "chat_completions").where("completion_id is not null").groupBy("completion_id").agg(F.first(F.struct("request_id", "choices")).alias("x"))
    flat = once.select("completion_id", F.col("x.request_id").alias("request_id"), F.explode("x.choices").alias("c"))
    return flat.select("completion_id", "request_id", F.col("c.index").alias("choice_index"), F.col("c.message.content").alias("content"), F.col("c.message.reasoning_content").alias("reasoning_content"), F.col("c.finish_reason").alias("finish_reason"))


@query(
    "prj9_split_reasoning",
    f"""WITH {_CHOICES}, raw AS (SELECT completion_id, choice_index, completion_id % 3 <> 0 AS think, coalesce(reasoning_content, '') || CASE WHEN completion_id % 5 <> 0 THEN chr(10) || '</think>' || chr(10) ELSE '' END || coalesce(content, '') AS text FROM choices)
SELECT completion_id, choice_index,
  CASE WHEN NOT think THEN NULL WHEN contains(text, '</think>') THEN trim(text[1:instr(text, '</think>') - 1], chr(10)) ELSE text END AS reasoning,
  CASE WHEN NOT think THEN text WHEN contains(text, '</think>') THEN ltrim(text[instr(text, '</think>') + 8:], chr(10)) ELSE '' END AS answer FROM raw""",
)
def split_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Raw generations as they leave a model: some without think mode, some that never close the span."""
    close = F.when(F.col("completion_id") % 5 != 0, "\n</think>\n").otherwise("")
    text = F.concat(F.coalesce("reasoning_content", F.lit("")), close, F.coalesce("content", F.lit("")))
    reasoning, answer = T.split_reasoning(F.col("text"), F.col("think"))
    raw = choices(spark, d).select("completion_id", "choice_index", (F.col("completion_id") % 3 != 0).alias("think"), text.alias("text"))
    return raw.select("completion_id", "choice_index", reasoning.alias("reasoning"), answer.alias("answer"))


@query(
    "prj10_merge_generation",
    f"""WITH {_CHOICES} SELECT completion_id, choice_index, CASE WHEN coalesce(reasoning_content, '') <> '' AND coalesce(content, '') <> '' THEN reasoning_content || chr(10) || chr(10) || content ELSE coalesce(reasoning_content, '') || coalesce(content, '') END AS merged FROM choices""",
)
def merge_generation(spark: SparkSession, d: str) -> DataFrame:
    return choices(spark, d).select("completion_id", "choice_index", T.merge_generation(F.col("reasoning_content"), F.col("content")).alias("merged"))


@query("seg_stats", f"{_CHAT_SQL} SELECT CASE WHEN lossable THEN 'answer' ELSE 'context' END AS kind, count(*) AS segments, sum(length(text))::BIGINT AS chars FROM parts GROUP BY lossable")
def seg_stats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lossable"), "answer").otherwise("context").alias("kind")
    return segments(spark, d).groupBy(kind).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.char_length("text")).alias("chars"))


@query("flt1_nonempty_conversations", f"WITH {TURNS} SELECT r.request_id, count(t.message_id) AS messages FROM (SELECT DISTINCT request_id FROM chat_requests WHERE request_id IS NOT NULL) r JOIN turns t USING (request_id) GROUP BY r.request_id")
def nonempty(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose message list is neither null nor empty."""
    requests = table(spark, d, "chat_requests").where("request_id is not null").select("request_id").distinct()
    held = requests.join(S.conversations(turns(spark, d)), "request_id", "left").where(F.coalesce(F.size("messages"), F.lit(0)) > 0)
    return held.select("request_id", F.size("messages").cast("bigint").alias("messages"))


@query("flt3_nonempty_segments", f"{_CHAT_SQL}, n AS ({_NUMBERED}) SELECT request_id, seg_idx, length(text) AS chars FROM n WHERE text <> ''")
def nonempty_segments(spark: SparkSession, d: str) -> DataFrame:
    conv = S.conversations(turns(spark, d))
    return S.exploded(conv, S.chat_segments(F.col("messages")), "request_id").where("text <> ''").select("request_id", "seg_idx", F.char_length("text").cast("bigint").alias("chars"))


@query(
    "agg7_think_coverage",
    f"""WITH {TURNS}, a AS (SELECT request_id, role = 'assistant' AS asst, role = 'assistant' AND NOT regexp_matches(coalesce(content, ''), '(?is)<think\\s*>(.*?)</think\\s*>') AS missing FROM turns),
r AS (SELECT request_id, count_if(asst) AS n, count_if(missing) AS m, bool_or(missing) AS any_missing FROM a GROUP BY request_id)
SELECT sum(n)::BIGINT AS assistant_turns, sum(m)::BIGINT AS missing_think, count_if(any_missing) AS rows_missing FROM r""",
)
def think_coverage(spark: SparkSession, d: str) -> DataFrame:
    assistant = F.col("role") == "assistant"
    missing = assistant & ~T.has_think(F.coalesce("content", F.lit("")))
    per = turns(spark, d).groupBy("request_id").agg(F.count_if(assistant).alias("n"), F.count_if(missing).alias("m"), F.bool_or(missing).alias("any"))
    return per.agg(F.sum("n").alias("assistant_turns"), F.sum("m").alias("missing_think"), F.count_if("any").alias("rows_missing"))


@query(
    "agg8_subset_counts",
    f"""WITH {_PAIRS}, s AS (SELECT p.message_id % 4 AS subset, {_R} = '' AS fake FROM pairs p) SELECT subset, count(*) AS rows_written, count_if(fake) AS fake_think FROM s GROUP BY subset""",
)
def subset_counts(spark: SparkSession, d: str) -> DataFrame:
    cut = turn_pairs(spark, d).select((F.col("message_id") % 4).alias("subset"), S.pair_segments(F.col("input"), F.col("output")).alias("segments"))
    fake = F.exists("segments", lambda s: s["text"] == S.NO_THINK_PREFIX)
    return cut.groupBy("subset").agg(F.count(F.lit(1)).alias("rows_written"), F.count_if(fake).alias("fake_think"))


@query("set1_bag_concat", "SELECT 0 AS source_ord, doc_id, text FROM documents WHERE source = 'webtext_01' UNION ALL SELECT 1, doc_id, text FROM documents WHERE lang = 'de'")
def bag_concat(spark: SparkSession, d: str) -> DataFrame:
    """Named subsets in order, rows of both kept twice; the ordinal carries the order."""
    from weftline.sources.subsets import concatenated

    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return concatenated([docs.where("source = 'webtext_01'"), docs.where("lang = 'de'")], "source_ord").select("source_ord", "doc_id", "text")


@query(
    "srt1_limit_written",
    "WITH u AS (SELECT 0 AS source_ord, doc_id FROM documents WHERE lang = 'fr' AND text <> '' UNION ALL SELECT 1, doc_id FROM documents WHERE lang = 'en' AND text <> '') SELECT source_ord, doc_id FROM u ORDER BY source_ord, doc_id LIMIT 100",
)
def limit_written(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 written rows across subsets: blank texts do not count."""
    from weftline.sources.subsets import concatenated

    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "lang")
    return concatenated([docs.where("lang = 'fr'"), docs.where("lang = 'en'")], "source_ord").orderBy("source_ord", "doc_id").limit(100).select("source_ord", "doc_id")


@query("snk1_segment_json", f"{_CHAT_SQL} SELECT request_id, '{{\"segments\":[' || string_agg('{{\"text\":' || to_json(text)::VARCHAR || ',\"lossable\":' || lossable::VARCHAR || '}}', ',' ORDER BY i, part) || ']}}' AS line FROM parts GROUP BY request_id")
def segment_json(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the segment file, non-ASCII text as it is."""
    from weftline.sources.jsonl import segment_lines

    conv = S.conversations(turns(spark, d)).select("request_id", S.chat_segments(F.col("messages")).alias("segments"))
    return segment_lines(conv, "request_id")
