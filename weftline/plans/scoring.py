"""Scoring of responses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scoring as S
from weftline.plans.registry import SQL, query, sql_strip, table

_ANSWERED = """resp AS (SELECT DISTINCT response_id, item_id, response FROM eval_responses),
answered AS (SELECT response_id, i.*, response FROM resp JOIN eval_items i USING (item_id))"""


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Each response once with its item."""
    responses = table(spark, d, "eval_responses").select("response_id", "item_id", "response").distinct()
    return responses.join(table(spark, d, "eval_items"), "item_id")


def _sql_number(x: str) -> str:
    return sql_strip(f"regexp_replace(replace(replace({x}, ',', ''), '$', ''), '\\.+\\z', '')")


_PRED = "replace(coalesce(response, ''), '####', 'The answer is')"
_NUMS = f"regexp_extract_all(replace(replace({_PRED}, ',', ''), '$', ''), '-?\\d+(?:\\.\\d+)?', 0)"


def announced() -> Column:
    """Responses with the mark of the answer written out."""
    return F.replace(F.coalesce("response", F.lit("")), F.lit("####"), F.lit("The answer is"))


@query("scr1_normalize", f"WITH {_ANSWERED} SELECT response_id, {_sql_number('response')} AS plain FROM answered")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("response_id", S.plain_number(F.col("response")).alias("plain"))


@query("scr2_gold", f"SELECT item_id, {_sql_number('''string_split(solution, '####')[-1]''')} AS gold FROM eval_items WHERE solution IS NOT NULL")
def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("solution is not null").select("item_id", S.number_gold(F.col("solution")).alias("gold"))


@query(
    "scr_gsm",
    f"""WITH {_ANSWERED}, p AS (SELECT response_id, {_sql_number("string_split(solution, '####')[-1]")} AS gold, {_sql_number(f"regexp_extract({_PRED}, 'The answer is (-?[0-9.,]+)', 1)")} AS strict, {_NUMS} AS nums FROM answered WHERE solution IS NOT NULL)
SELECT response_id, CASE WHEN strict = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN coalesce(nums[-1], '') = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS flexible, CASE WHEN list_contains(nums, gold) THEN 1.0 ELSE 0.0 END::DOUBLE AS loose FROM p""",
)
def gsm(spark: SparkSession, d: str) -> DataFrame:
    """Number answers: announced, last, anywhere."""
    items = answered(spark, d).where("solution is not null").select("response_id", announced().alias("p"), S.number_gold(F.col("solution")).alias("gold"))
    return items.select("response_id", *[c.alias(k) for k, c in S.number_scores(F.col("p"), F.col("gold")).items()])


_GOLD_LETTER = "CASE WHEN answer BETWEEN 0 AND 3 THEN substr('ABCD', answer + 1, 1) ELSE '' END"
#: RE2's word boundary is ASCII, so boundaries are written out on a text with doubled separators.
_ALONE = r"regexp_extract_all(regexp_replace(coalesce(response, ''), '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])', 1)"
_TAIL = r"regexp_replace(coalesce(response, ''), '[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.):\]]+\z', '')"


@query("scr6_letter_gold", f"SELECT item_id, {_GOLD_LETTER} AS gold FROM eval_items")
def letter_gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.coalesce(S.letter_gold(F.col("answer")), F.lit("")).alias("gold"))


@query(
    "scr_mmlu",
    f"""WITH {_ANSWERED}, p AS (SELECT response_id, {_GOLD_LETTER} AS gold, right({_TAIL}, 1) AS last, {_ALONE} AS alone FROM answered WHERE choices IS NOT NULL)
SELECT response_id, CASE WHEN CASE WHEN last IN ('A', 'B', 'C', 'D') THEN last ELSE '' END = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN coalesce(alone[-1], '') = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS flexible,
CASE WHEN gold <> '' AND list_contains(alone, gold) THEN 1.0 ELSE 0.0 END::DOUBLE AS loose FROM p""",
)
def mmlu(spark: SparkSession, d: str) -> DataFrame:
    """Letter answers: final, last alone, anywhere alone."""
    items = answered(spark, d).where("choices is not null").select("response_id", "response", F.coalesce(S.letter_gold(F.col("answer")), F.lit("")).alias("gold"))
    return items.select("response_id", *[c.alias(k) for k, c in S.letter_scores(F.col("response"), F.col("gold")).items()])


_BEST = "replace(replace(response, '####', 'The best answer is:'), '\\boxed', 'best answer is ')"
_CASCADE = S.CASCADE.replace("'", "''")


def _best() -> Column:
    return F.replace(F.replace("response", F.lit("####"), F.lit("The best answer is:")), F.lit("\\boxed"), F.lit("best answer is "))


@query(
    "scr_letter",
    f"""WITH {_ANSWERED}, p AS (SELECT response_id, {_GOLD_LETTER} AS gold, regexp_extract_all({_BEST}, '{_CASCADE}', 1)[-1] AS a, regexp_extract_all({_BEST}, '{_CASCADE}', 2)[-1] AS b FROM answered WHERE choices IS NOT NULL)
SELECT response_id, CASE WHEN a <> '' THEN a ELSE b END AS letter, CASE WHEN coalesce(lower(CASE WHEN a <> '' THEN a ELSE b END) = lower(gold), false) THEN 1.0 ELSE 0.0 END::DOUBLE AS exact FROM p""",
)
def letters(spark: SparkSession, d: str) -> DataFrame:
    """Announced letter, else a letter standing alone."""
    items = answered(spark, d).where("choices is not null").select("response_id", _best().alias("p"), F.coalesce(S.letter_gold(F.col("answer")), F.lit("")).alias("gold"))
    return items.select("response_id", S.cascade_letter(F.col("p")).alias("letter"), S.cascade_scores(F.col("p"), F.col("gold"))["exact"].alias("exact"))


@query("srt3_last_match", f"WITH {_ANSWERED} SELECT response_id, regexp_extract_all(response, '[0-9]+', 0)[1] AS first_match, regexp_extract_all(response, '[0-9]+', 0)[-1] AS last_match FROM answered")
def last_match(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("response", F.lit("[0-9]+"), F.lit(0))
    return answered(spark, d).select("response_id", F.try_element_at(found, F.lit(1)).alias("first_match"), F.try_element_at(found, F.lit(-1)).alias("last_match"))


@query("scr10_strict_choice", f"WITH {_ANSWERED} SELECT response_id, regexp_extract({_PRED}, 'The answer is (.*).', 1) AS choice FROM answered")
def strict_choice(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("response_id", S.strict_choice(announced()).alias("choice"))


@query("scr11_bracketed_choice", f"WITH {_ANSWERED} SELECT response_id, coalesce(regexp_extract_all(replace(response, 'boxed{{', '('), '(\\([A-Z]\\))', 1)[-1], '') AS choice FROM (SELECT response_id, replace(response, '}}', ')') AS response FROM answered)")
def bracketed_choice(spark: SparkSession, d: str) -> DataFrame:
    bracketed = F.replace(F.replace("response", F.lit("}"), F.lit(")")), F.lit("boxed{"), F.lit("("))
    return answered(spark, d).select("response_id", S.bracketed_choice(bracketed).alias("choice"))


_PUNCT = S.PUNCTUATION.replace("'", "''")


@query("scr12_comparable", f"WITH {_ANSWERED} SELECT response_id, translate(lower(response), '{_PUNCT}', '') AS comparable FROM answered")
def comparable(spark: SparkSession, d: str) -> DataFrame:
    return answered(spark, d).select("response_id", S.comparable(F.col("response")).alias("comparable"))


@query(
    "scr13_boxed",
    f"""WITH {_ANSWERED}, t AS (SELECT response_id, CASE WHEN contains(response, '\\boxed ') THEN NULL WHEN contains(response, '\\boxed') THEN '\\boxed' || string_split(response, '\\boxed')[-1] WHEN contains(response, '\\fbox') THEN '\\fbox' || string_split(response, '\\fbox')[-1] END AS tail FROM answered),
c AS (SELECT response_id, tail, unnest(range(1, length(tail) + 1)) AS i FROM t WHERE tail IS NOT NULL), b AS (SELECT response_id, tail, i, substr(tail, i, 1) AS ch FROM c WHERE substr(tail, i, 1) IN ('{{', '}}')),
e AS (SELECT response_id, tail, i, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY response_id ORDER BY i) AS depth FROM b), s AS (SELECT response_id, substr(any_value(tail), 1, min(i) FILTER (WHERE depth = 0)) AS braced FROM e GROUP BY response_id)
SELECT response_id, CASE WHEN contains(response, '\\boxed ') THEN '\\boxed ' || string_split(string_split(response, '\\boxed ')[-1], '$')[1] ELSE braced END AS boxed FROM answered LEFT JOIN s USING (response_id)""",
)
def boxed(spark: SparkSession, d: str) -> DataFrame:
    """Last boxed expression of each response."""
    return answered(spark, d).select("response_id", S.last_boxed(F.col("response")).alias("boxed"))


@query("scr14_unboxed", f"WITH {_ANSWERED} SELECT response_id, regexp_extract(response, '\\\\boxed\\{{([^{{}}]*)\\}}', 1) AS inside FROM answered WHERE regexp_matches(response, '\\\\boxed\\{{[^{{}}]*\\}}') AND NOT contains(response, '\\boxed ')")
def unboxed(spark: SparkSession, d: str) -> DataFrame:
    found = answered(spark, d).select("response_id", S.last_boxed(F.col("response")).alias("boxed")).where(F.col("boxed").isNotNull())
    return found.select("response_id", S.unboxed(F.col("boxed")).alias("inside"))


_STATED = "'Final Answer: The final answer is ' || coalesce(solution, '')"


@query(
    "scr15_stated_answer",
    f"""WITH f AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN coalesce(solution, '') ELSE {_STATED} || CASE WHEN item_id % 3 = 1 THEN '. I hope it is correct.' ELSE '. ' END END || 'I hope it is correct.' AS t FROM eval_items)
SELECT item_id, CASE WHEN regexp_matches(t, 'Final Answer: The final answer is(.*?). I hope it is correct.') THEN {sql_strip("regexp_extract(t, 'Final Answer: The final answer is(.*?). I hope it is correct.', 1)")} ELSE '[invalidanswer]' END AS stated FROM f""",
)
def stated_answer(spark: SparkSession, d: str) -> DataFrame:
    """Solutions written as closing sentences: whole, cut, and without one."""
    s = F.coalesce("solution", F.lit(""))
    whole = F.concat(F.lit("Final Answer: The final answer is "), s)
    text = F.when(F.col("item_id") % 3 == 0, s).when(F.col("item_id") % 3 == 1, F.concat(whole, F.lit(". I hope it is correct."))).otherwise(F.concat(whole, F.lit(". ")))
    return table(spark, d, "eval_items").select("item_id", S.stated_final_answer(text).alias("stated"))


def _re2(replacement: str) -> str:
    """A replacement as RE2 writes it: groups by a backslash, dollar signs bare."""
    return re.sub(r"\\?\$(\d?)", lambda m: "$" if m.group().startswith("\\") else f"\\{m.group(1)}", replacement)


def _sql_final(x: str) -> str:
    q = lambda s: s.replace("'", "''")
    out = f"string_split({x}, '=')[-1]"
    for old, new in S.REPLACED:
        out = f"replace({out}, '{q(old)}', '{q(new)}')"
    for old in S.REMOVED:
        out = f"replace({out}, '{q(old)}', '')"
    for pattern, keep in S.UNWRAPPED:
        out = f"regexp_replace({out}, '{pattern}', '{_re2(keep)}', 'g')"
    return f"replace({out}, '$', '')"


@query(
    "scr_final_answer",
    f"""WITH a AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'x = $' || item_id || ',000$ dollars' WHEN 1 THEN '\\frac' || item_id || ' + \\sqrt' || item_id WHEN 2 THEN coalesce(solution, '\\text{{an answer}}') ELSE '\\boxed{{\\text{{' || item_id || ' cm}}}}' END AS raw FROM eval_items),
f AS (SELECT item_id, {_sql_final("raw")} AS t FROM a) SELECT item_id, CASE WHEN regexp_matches(replace(t, ',', ''), '^[0-9]+\\z') THEN replace(t, ',', '') ELSE t END AS final FROM f""",
)
def final_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers of several notations in one."""
    i = F.col("item_id").cast("string")
    kind = F.col("item_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("x = $"), i, F.lit(",000$ dollars")))
        .when(kind == 1, F.concat(F.lit("\\frac"), i, F.lit(" + \\sqrt"), i))
        .when(kind == 2, F.coalesce("solution", F.lit("\\text{an answer}")))
        .otherwise(F.concat(F.lit("\\boxed{\\text{"), i, F.lit(" cm}}")))
    )
    return table(spark, d, "eval_items").select("item_id", S.final_answer(raw).alias("final"))


@query(
    "scr17_equivalent",
    f"""WITH {_ANSWERED}, p AS (SELECT response_id, {_sql_number("string_split(solution, '####')[-1]")} AS gold, {_sql_number("regexp_extract(response, '(-?[0-9.,]+)[ \\t\\n\\f\\r\\x0b]*\\z', 1)")} AS given FROM answered WHERE solution IS NOT NULL)
SELECT response_id, coalesce(gold = given OR try_cast(gold AS DECIMAL(38,12)) = try_cast(given AS DECIMAL(38,12)), false) AS same FROM p""",
)
def equivalent(spark: SparkSession, d: str) -> DataFrame:
    """Gold and last number compared as formulas."""
    rows = answered(spark, d).where("solution is not null").select("response_id", S.number_gold(F.col("solution")).alias("gold"), S.plain_number(F.regexp_extract("response", r"(-?[\d.,]+)\s*\z", 1)).alias("given"))
    return rows.select("response_id", S.equivalent(F.col("gold"), F.col("given")).alias("same"))


@query(
    "scr11_named_choice",
    f"""WITH {_ANSWERED}, c AS (SELECT response_id, choices, regexp_extract_all(response, '(\\([A-Z]\\))', 1)[-1] AS letter, reverse(lower(coalesce(response, ''))) AS r FROM answered WHERE choices IS NOT NULL),
e AS (SELECT response_id, letter, r, unnest(choices) AS choice, generate_subscripts(choices, 1) AS i FROM c),
h AS (SELECT response_id, any_value(letter) AS letter, arg_min(i, (strpos(r, reverse(lower(choice))), i)) FILTER (WHERE choice <> '' AND strpos(r, reverse(lower(choice))) > 0) AS i FROM e GROUP BY response_id)
SELECT response_id, coalesce(nullif(letter, ''), '(' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', i::INTEGER, 1) || ')', '') AS choice FROM h""",
)
def named_choice(spark: SparkSession, d: str) -> DataFrame:
    """Bracketed letters, else the choice whose text stands last in the response."""
    return answered(spark, d).where("choices is not null").select("response_id", S.bracketed_or_named_choice(F.col("response"), F.col("choices")).alias("choice"))


@query(
    "scr18_verified",
    f"""WITH {_ANSWERED}, b AS ({SQL["scr13_boxed"]}), p AS (SELECT a.response_id, {_sql_number("string_split(solution, '####')[-1]")} AS gold,
  coalesce(nullif(CASE WHEN starts_with(boxed, '\\boxed ') THEN substr(boxed, 8) ELSE regexp_extract(boxed, '(?s)^\\\\f?box(?:ed)?\\{{(.*)\\}}\\z', 1) END, ''), {_sql_number("coalesce(regexp_extract_all(response, '-?[0-9][0-9,]*(?:\\.[0-9]+)?')[-1], '')")}) AS given
  FROM answered a JOIN b USING (response_id) WHERE solution IS NOT NULL)
SELECT response_id, coalesce(gold = given OR try_cast(gold AS DECIMAL(38,12)) = try_cast(given AS DECIMAL(38,12)), false) AS correct FROM p""",
)
def verified(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose boxed expression or last number has the value of the gold answer."""
    rows = answered(spark, d).where("solution is not null")
    return rows.select("response_id", S.verified(F.col("response"), S.number_gold(F.col("solution"))).alias("correct"))


@query("scr20_code_block", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)```(?:python)?\\n(.*?)```') THEN regexp_extract(text, '(?s)```(?:python)?\\n(.*?)```', 1) ELSE text END AS code FROM documents WHERE contains(text, '```')")
def code_block(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("contains(text, '```')").select("doc_id", S.code_block(F.col("text")).alias("code"))


@query("scr21_likeliest_choice", "SELECT vec_id, list_position(embedding[1:4], list_max(embedding[1:4]))::BIGINT - 1 AS choice, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label % 4 AS correct FROM embeddings")
def likeliest_choice(spark: SparkSession, d: str) -> DataFrame:
    """Argmax over the scores of four choices."""
    four = F.slice("embedding", 1, 4)
    return table(spark, d, "embeddings").select("vec_id", S.likeliest_choice(four).alias("choice"), (S.likeliest_choice(four) == F.col("label") % 4).alias("correct"))
