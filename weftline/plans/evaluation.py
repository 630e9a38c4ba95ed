"""Evaluation: prompts, few-shot, aggregates, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scoring as S
from weftline.functions.numbers import sql_uniform
from weftline.operators import evaluation as E
from weftline.operators import prompts as P
from weftline.plans.registry import query, sql_strip, table
from weftline.plans.scoring import _ALONE, _ANSWERED, _GOLD_LETTER, answered

_Q = sql_strip("question")
_C = [f"coalesce(choices[{i}], '')" for i in range(1, 5)]
_NL = "chr(10)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items")


@query("prj11_four_choices", f"SELECT item_id, {_Q} || {' || '.join(f'''{_NL} || '{x}. ' || {c}''' for x, c in zip('ABCD', _C))} || ' (think a bit)' AS prompt FROM eval_items WHERE choices IS NOT NULL")
def four_choices(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where("choices is not null").select("item_id", P.four_choices(F.col("question"), F.col("choices")).alias("prompt"))


@query(
    "prj11_best_of_four",
    f"""SELECT item_id, 'Given the following question and four candidate answers (A, B, C and D), choose the best answer.' || {_NL} || 'Question: ' || {_Q} || {_NL} || 'A. ' || {_C[0]} || {_NL} || 'B. ' || {_C[1]} || {_NL} || 'C. ' || {_C[2]}
|| CASE WHEN len(choices) > 3 THEN {_NL} || 'D. ' || {_C[3]} ELSE '' END || {_NL} || '{P.ASK_FOUR}' AS prompt, substr('ABCD', answer + 1, 1) AS target FROM eval_items WHERE choices IS NOT NULL AND answer BETWEEN 0 AND 3""",
)
def best_of_four(spark: SparkSession, d: str) -> DataFrame:
    """Three or four candidates; numeric keys become letters."""
    rows = items(spark, d).where("choices is not null and answer between 0 and 3")
    return rows.select("item_id", P.best_of_four(F.col("question"), F.col("choices")).alias("prompt"), P.answer_key((F.col("answer") + 1).cast("string")).alias("target"))


@query("prj11_best_of_two", f"SELECT item_id, 'Given a goal and two candidate solutions (A and B), choose the more sensible solution.' || {_NL} || 'Goal: ' || {_Q} || {_NL} || 'A. ' || {_C[0]} || {_NL} || 'B. ' || {_C[1]} || {_NL} || '{P.ASK_TWO}' AS prompt FROM eval_items WHERE choices IS NOT NULL")
def best_of_two(spark: SparkSession, d: str) -> DataFrame:
    two = [F.try_element_at("choices", F.lit(i)) for i in (1, 2)]
    return items(spark, d).where("choices is not null").select("item_id", P.best_of_two(F.col("question"), *two).alias("prompt"))


@query("prj11_code_task", f"SELECT item_id, '{P.CODE_TASK}' || question || ' Your code should pass these tests:' || {_NL} || {_NL} || {_C[0]} || {_NL} || {_C[1]} || {_NL} || {_C[2]} || {_NL} || '[BEGIN]' || {_NL} AS prompt, {_C[0]} || {_NL} || {_C[1]} || {_NL} || {_C[2]} AS target, coalesce(solution, '') || {_NL} || '[DONE]' AS solved, question || {_NL} || 'check(' || task || ')' AS completion_target FROM eval_items")
def code_task(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of code tasks; choices stand for tests."""
    q, c = F.col("question"), F.col("choices")
    return items(spark, d).select("item_id", P.code_task(q, c).alias("prompt"), P.code_tests(c).alias("target"), P.solved_task(F.col("solution")).alias("solved"), P.completion_tests(q, F.col("task")).alias("completion_target"))


@query("prj13_math_problem", f"SELECT item_id, 'Problem:' || {_NL} || question || ' (think a bit)' AS prompt FROM eval_items WHERE choices IS NULL")
def math_problem(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where("choices is null").select("item_id", P.math_problem(F.col("question")).alias("prompt"))


_LAST_OPTIONS = " || ".join(f"CASE WHEN len(choices) >= {i} THEN '{x}. ' || coalesce(choices[{i}], '') || {_NL} ELSE '' END" for i, x in enumerate("ABCD", 1))


@query("prj12_passage_prompt", f"SELECT item_id, 'Given the following passage, question, and four candidate answers (A, B, C and D), choose the best answer.' || {_NL} || 'Passage: ' || {_Q} || {_NL} || {_NL} || 'Question: Which one?' || {_NL} || {_LAST_OPTIONS} || '{P.ASK_PASSAGE}' AS prompt FROM eval_items WHERE choices IS NOT NULL".replace(P.ASK_PASSAGE, P.ASK_PASSAGE.replace("'", "''").replace(chr(10), "' || chr(10) || '")))
def passage_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose problems are a literal of a list, as some datasets store them."""
    quoted = F.transform("choices", lambda c: F.concat(F.lit("'''"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'''")))
    literal = F.concat(F.lit("[{'question': 'Which one?', 'options': ["), F.array_join(quoted, ", "), F.lit("], 'answer': 'A'}]"))
    rows = items(spark, d).where("choices is not null").select("item_id", "question", literal.alias("problems"))
    return rows.select("item_id", P.passage_prompt(F.col("question"), F.col("problems")).alias("prompt"))


_TIDY = "list_transform(choices, lambda c: CASE WHEN c IS NULL THEN ' ' ELSE replace(replace(" + sql_strip("c") + ", ' [title]', '. '), '  ', ' ') END)"


@query("prj14_tidy_choices", f"SELECT item_id, array_to_string({_TIDY}, '|') AS tidy FROM eval_items WHERE choices IS NOT NULL")
def tidy_choices(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where("choices is not null").select("item_id", F.array_join(F.transform("choices", P.tidy_choice), "|").alias("tidy"))


_SHUFFLED = f"""tidy AS (SELECT item_id, answer, choices AS raw, {_TIDY} AS c FROM eval_items WHERE len(choices) = 4 AND answer BETWEEN 0 AND 3),
each AS (SELECT item_id, i - 1 AS i, c[i] AS choice, {sql_uniform("item_id", "0", "i - 1", 21)} AS u FROM tidy, range(1, 5) r(i)),
mixed AS (SELECT item_id, list(choice ORDER BY u, i) AS s FROM each GROUP BY item_id)"""


@query("prj15_shuffled_choices", f"WITH {_SHUFFLED} SELECT item_id, array_to_string(s, '|') AS shuffled, '(' || substr('ABCD', list_position(s, c[answer + 1])::INT, 1) || ')' AS letter FROM mixed JOIN tidy USING (item_id)")
def shuffled_choices(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible order and the letter of the correct choice; among equal texts the first counts."""
    rows = items(spark, d).where("size(choices) = 4 and answer between 0 and 3").select("item_id", "answer", F.transform("choices", P.tidy_choice).alias("c"))
    mixed = rows.select("item_id", P.shuffled(F.col("c"), F.col("item_id")).alias("s"), F.element_at("c", F.col("answer") + 1).alias("correct"))
    return mixed.select("item_id", F.array_join("s", "|").alias("shuffled"), P.choice_letter(F.col("s"), F.col("correct")).alias("letter"))


@query("prj23_shuffle_unless_both", f"WITH {_SHUFFLED} SELECT item_id, array_to_string(CASE WHEN len(list_filter(c, lambda x: contains(x, 'Both'))) > 0 THEN c ELSE s END, '|') AS shuffled, list_position(CASE WHEN len(list_filter(c, lambda x: contains(x, 'Both'))) > 0 THEN c ELSE s END, c[answer + 1])::BIGINT - 1 AS gold FROM mixed JOIN tidy USING (item_id)")
def shuffle_unless_both(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).where("size(choices) = 4 and answer between 0 and 3").select("item_id", "answer", F.transform("choices", P.tidy_choice).alias("c"))
    mixed = rows.select("item_id", P.shuffled_unless_both(F.col("c"), F.col("item_id")).alias("s"), F.element_at("c", F.col("answer") + 1).alias("correct"))
    return mixed.select("item_id", F.array_join("s", "|").alias("shuffled"), (F.array_position("s", F.col("correct")) - 1).alias("gold"))


_TEMPLATE = "The following are questions about <SUBJECT>.\nQ: <Q>\nA: <|A|>\nAnswer:"


@query("prj16_filled_template", f"SELECT item_id, replace(replace(replace('{_TEMPLATE}', '<SUBJECT>', replace(task, '_', ' ')), '<Q>', question), '<|A|>', {_C[0]}) AS prompt FROM eval_items")
def filled_template(spark: SparkSession, d: str) -> DataFrame:
    first = F.try_element_at("choices", F.lit(1))
    return items(spark, d).select("item_id", P.filled(_TEMPLATE, {"SUBJECT": F.col("task"), "Q": F.col("question"), "|A|": first}).alias("prompt"))


@query("jon7_responses_by_item", "SELECT i.item_id, count(r.response_id) AS responses FROM eval_items i JOIN (SELECT DISTINCT response_id, item_id FROM eval_responses) r USING (item_id) GROUP BY i.item_id")
def responses_by_item(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).groupBy("item_id").agg(F.count("response_id").alias("responses"))


@query(
    "jon11_few_shot",
    f"""WITH r AS (SELECT task, item_id, question, row_number() OVER (PARTITION BY task ORDER BY item_id) AS k FROM eval_items), demo AS (SELECT task, string_agg(question, {_NL} || {_NL} ORDER BY item_id) AS head FROM r WHERE k <= 3 GROUP BY task)
SELECT item_id, task, head || {_NL} || {_NL} || question AS prompt FROM eval_items JOIN demo USING (task)""",
)
def few_shot(spark: SparkSession, d: str) -> DataFrame:
    """The first three questions of the task before each question."""
    docs = items(spark, d).select("item_id", "task", "question")
    return E.few_shot(docs, docs, "task", "item_id", "question", 3).select("item_id", "task", "prompt")


@query("srt2_docs_per_task", "SELECT task, item_id FROM (SELECT task, item_id, row_number() OVER (PARTITION BY task ORDER BY item_id) AS k FROM eval_items) WHERE k <= 20")
def docs_per_task(spark: SparkSession, d: str) -> DataFrame:
    return E.first_n(items(spark, d).select("task", "item_id"), "task", "item_id", 20)


@query("srt4_first_n_demos", "SELECT task, lang, item_id FROM (SELECT task, lang, item_id, row_number() OVER (PARTITION BY lang ORDER BY item_id) AS k FROM eval_items) WHERE k <= 8")
def first_n_demos(spark: SparkSession, d: str) -> DataFrame:
    return E.first_n(items(spark, d).select("task", "lang", "item_id"), "lang", "item_id", 8)


@query("agg9_task_means", f"WITH {_ANSWERED}, p AS (SELECT task, CASE WHEN coalesce(({_ALONE})[-1], '') = {_GOLD_LETTER} THEN 1.0 ELSE 0.0 END::DOUBLE AS flexible FROM answered WHERE choices IS NOT NULL) SELECT task, count(*) AS n, round(avg(flexible), 9) AS flexible FROM p GROUP BY task")
def task_means(spark: SparkSession, d: str) -> DataFrame:
    rows = answered(spark, d).where("choices is not null").select("task", S.letter_scores(F.col("response"), F.coalesce(S.letter_gold(F.col("answer")), F.lit("")))["flexible"].alias("flexible"))
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("flexible"), 9).alias("flexible"))


@query("agg12_accuracy", f"WITH {_ANSWERED} SELECT count(*) AS total, count_if(coalesce(({_ALONE})[-1], '') = {_GOLD_LETTER}) AS correct, round(count_if(coalesce(({_ALONE})[-1], '') = {_GOLD_LETTER}) / count(*), 9) AS accuracy FROM answered WHERE choices IS NOT NULL")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = answered(spark, d).where("choices is not null").select((S.letter_scores(F.col("response"), F.coalesce(S.letter_gold(F.col("answer")), F.lit("")))["flexible"] == 1).alias("hit"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct"), F.round(F.count_if("hit") / F.count(F.lit(1)), 9).alias("accuracy"))


_LEAVES = "leaves AS (SELECT DISTINCT grp, coalesce(subgroup, '') AS subgroup, task, n, metric, value FROM task_metrics)"


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_metrics").select("grp", F.coalesce("subgroup", F.lit("")).alias("subgroup"), "task", "n", "metric", "value").distinct()


@query(
    "agg10_rollup",
    f"WITH {_LEAVES} SELECT metric, grp, subgroup, task, grouping(metric, grp, subgroup, task)::BIGINT AS level, sum(n)::BIGINT AS n, round(sum(value * n) / sum(n), 9) AS value FROM leaves WHERE value IS NOT NULL AND n > 0 GROUP BY metric, ROLLUP (grp, subgroup, task)",
)
def rollup(spark: SparkSession, d: str) -> DataFrame:
    """Size-weighted means at all levels of the task tree; a null subgroup is a subgroup of its own."""
    return E.weighted_rollup(_leaves(spark, d), ["grp", "subgroup", "task"]).withColumn("value", F.round("value", 9))


@query("jon8_task_tree", "SELECT DISTINCT e.task, t.grp, t.subgroup FROM (SELECT DISTINCT task FROM task_metrics) e JOIN (SELECT DISTINCT task, grp, subgroup FROM task_metrics) t USING (task)")
def task_tree(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with their place in the tree, a dimension of bounded size."""
    tree = table(spark, d, "task_metrics").select("task", "grp", "subgroup").distinct()
    return table(spark, d, "task_metrics").select("task").distinct().join(tree, "task")


_PASSES = """scored AS (SELECT DISTINCT response_id, item_id, passed FROM eval_responses WHERE passed IS NOT NULL), per AS (SELECT item_id, count(*) AS n, count_if(passed) AS c FROM scored GROUP BY item_id)"""


def _sql_pass(k: int) -> str:
    return f"CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - {k}::DOUBLE / i)) END"


@query("agg11_pass_at_k", f"WITH {_PASSES} SELECT item_id, n, c, " + ", ".join(f"round({_sql_pass(k)}, 9)::DOUBLE AS pass_at_{k}" for k in (1, 2, 5)) + " FROM per")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Unbiased estimates from scored attempts."""
    scored = table(spark, d, "eval_responses").where("passed is not null").select("response_id", "item_id", "passed").distinct()
    per = scored.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    return per.select("item_id", "n", "c", *[F.round(E.pass_at_k(F.col("n"), F.col("c"), k), 9).alias(f"pass_at_{k}") for k in (1, 2, 5)])


@query("agg11_pass_means", f"WITH {_PASSES} SELECT round(avg({_sql_pass(1)}), 8) AS pass_at_1, round(avg({_sql_pass(5)}), 8) AS pass_at_5 FROM per")
def pass_means(spark: SparkSession, d: str) -> DataFrame:
    return pass_at_k(spark, d).agg(F.round(F.avg("pass_at_1"), 8).alias("pass_at_1"), F.round(F.avg("pass_at_5"), 8).alias("pass_at_5"))


@query(
    "agg13_perplexity",
    "WITH t AS (SELECT l_orderkey AS doc, ln((l_quantity + 1) / 52.0) AS logp, l_returnflag <> 'R' AS hit FROM lineitem), p AS (SELECT doc, sum(logp) AS logp, bool_and(hit) AS hit FROM t GROUP BY doc) SELECT count(*) AS docs, round(exp(-avg(logp)) / 1e4, 4) AS ppl_e4, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p",
)
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity per document, not per token, and the share of documents with every token right."""
    tokens = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.log((F.col("l_quantity") + 1) / 52.0).alias("logp"), (F.col("l_returnflag") != "R").alias("hit"))
    per = tokens.groupBy("doc").agg(F.sum("logp").alias("logp"), F.bool_and("hit").alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("docs"), F.round(F.exp(-F.avg("logp")) / 1e4, 4).alias("ppl_e4"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


@query("flt11_numeric_metrics", "SELECT DISTINCT task, metric, value FROM task_metrics WHERE value IS NOT NULL AND NOT starts_with(metric, 'alias')")
def numeric_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_metrics").where("value is not null and not startswith(metric, 'alias')").select("task", "metric", "value").distinct()


@query("snk5_summary", "WITH m AS (SELECT DISTINCT task, metric, value FROM task_metrics WHERE value IS NOT NULL AND NOT starts_with(metric, 'alias')) SELECT task, '{' || string_agg('\"' || metric || '\":' || value::DECIMAL(28,9)::VARCHAR, ',' ORDER BY metric) || '}' AS metrics FROM m GROUP BY task")
def summary(spark: SparkSession, d: str) -> DataFrame:
    """One line a task with sorted names and numbers."""
    return E.summary(table(spark, d, "task_metrics"))


@query("srt7_sorted_tasks", "SELECT DISTINCT task FROM task_metrics ORDER BY task")
def sorted_tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_metrics").select("task").distinct().orderBy("task")


@query("src18_last_word", "SELECT item_id, regexp_extract(question, '(?s)^(.*) ([^ ]*)\\z', 1) AS prefix, ' ' || regexp_extract(question, '(?s)^(.*) ([^ ]*)\\z', 2) AS target FROM eval_items")
def last_word(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"(?s)^(.*) ([^ ]*)\z"
    return items(spark, d).select("item_id", F.regexp_extract("question", pattern, 1).alias("prefix"), F.concat(F.lit(" "), F.regexp_extract("question", pattern, 2)).alias("target"))
