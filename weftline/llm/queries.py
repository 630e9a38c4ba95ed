"""The pN_ queries and their SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import confusables, contamination, neardup, packing, pairs, subjects
from weftline.session import staged

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _near_duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "chat_messages").where("role in ('user', 'assistant')")
    return neardup.near_duplicates(turns, "message_id", "content", k=3, threshold=0.5, min_words=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.expand_pairs(*_near_duplicates(spark, sf_dir))
    return pairs.select(F.col("id_a").alias("message_id_a"), F.col("id_b").alias("message_id_b"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_counts(*_near_duplicates(spark, sf_dir)).withColumnRenamed("id", "message_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.answer_pairs(table(spark, sf_dir, "chat_messages"), table(spark, sf_dir, "chat_completions"), table(spark, sf_dir, "chat_requests"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = confusables.look_alike_pairs(table(spark, sf_dir, "chat_messages"), "message_id", "content")
    return found.select(F.col("id_a").alias("message_id_a"), F.col("id_b").alias("message_id_b"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in its one consistent form."""
    return confusables.canonical_forms(table(spark, sf_dir, "chat_messages"), "message_id", "content").select(F.col("id").alias("message_id"), "form").distinct()


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stored in several ways by class, in place of pairs."""
    return confusables.look_alike_classes(table(spark, sf_dir, "chat_messages"), "message_id", "content").withColumnRenamed("id", "message_id")


def p4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "pack_specs"))


def p4_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p4_pack(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what must not be in a packing, all zero."""
    sizes, specs = staged(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "pack-sizes"), table(spark, sf_dir, "pack_specs")
    return packing.invariants(packing.pack(sizes, specs), sizes, specs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "question")


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leak_report(p5_found(spark, sf_dir))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p6_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and terms' share by subject: what the corpus is made of."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("share"), 3).alias("document_shares"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_links, p2_found, p3_found, p3_forms, p3_classes, p4_pack, p4_fill, p4_invariants, p5_found, p5_items, p6_found, p6_composition)}


_BLANK = r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}{_BLANK}]', '', 'g'), '[{_BLANK}]+'), lambda x: x <> '')"


#: All pairs by counting shared runs, without any filter.
_PAIRS_SQL = f"""m AS (SELECT DISTINCT message_id, content FROM chat_messages WHERE role IN ('user', 'assistant') AND content IS NOT NULL AND message_id IS NOT NULL),
w AS (SELECT message_id, {_sql_words("content")} AS w FROM m),
s AS (SELECT DISTINCT message_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT message_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT message_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS runs FROM s GROUP BY message_id),
o AS (SELECT a.message_id AS a, b.message_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.message_id < b.message_id GROUP BY ALL),
found AS (SELECT a, b FROM o JOIN n x ON x.message_id = a JOIN n y ON y.message_id = b WHERE o >= 0.5 * (x.n + y.n - o))"""
_LEAKS_SQL = f"""q AS (SELECT item_id, {_sql_words("question")} AS w FROM eval_items),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM q WHERE len(w) >= 12)),
d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM runs JOIN win USING (g))"""


def _sql_form(text: str) -> str:
    """The consistent form by one character at a time, put together by DuckDB; forms of several characters but ligatures are not in it."""
    mapped, dropped, several = [], [], []
    for code in [*range(1, 0xD800), *range(0xE000, sys.maxunicode + 1)]:
        ch = chr(code)
        form = confusables.consistent(ch)
        if form == "":
            dropped.append(ch)
        elif form != ch and len(form) == 1:
            mapped.append((ch, form))
        elif form != ch and form.isascii():
            several.append((ch, form))
    quoted = lambda x: x.replace("'", "''")
    for ch, form in several:
        text = f"replace({text}, '{ch}', '{quoted(form)}')"
    source, target = "".join(a for a, _ in mapped) + "".join(dropped), "".join(b for _, b in mapped)
    return f"replace(nfc_normalize(translate({text}, '{quoted(source)}', '{quoted(target)}')), chr(13) || chr(10), chr(10))"


def _forms_sql() -> str:
    return f"f AS (SELECT message_id, content, {_sql_form('content')} AS form FROM (SELECT DISTINCT message_id, content FROM chat_messages WHERE message_id IS NOT NULL))"


def oracle_sql() -> dict[str, str]:
    forms = _forms_sql()
    return {
        "p3_found": f"WITH {forms} SELECT DISTINCT a.message_id AS message_id_a, b.message_id AS message_id_b FROM f a JOIN f b ON a.form = b.form AND a.content <> b.content AND a.message_id < b.message_id",
        "p3_forms": f"WITH {forms} SELECT DISTINCT message_id, form FROM f",
        "p3_classes": f"""WITH {forms}, o AS (SELECT form, content, min(message_id) AS original_id FROM f WHERE form IS NOT NULL GROUP BY ALL), c AS (SELECT form, min(original_id) AS class_id FROM o GROUP BY form HAVING count(*) > 1)
SELECT DISTINCT message_id, class_id, original_id FROM f JOIN o USING (form, content) JOIN c USING (form)""",
        "p1_found": f"WITH {_PAIRS_SQL} SELECT a AS message_id_a, b AS message_id_b FROM found",
        "p1_links": f"""WITH {_PAIRS_SQL}, c AS (SELECT message_id, min(message_id) OVER (PARTITION BY runs) AS cid, count(*) OVER (PARTITION BY runs) AS copies FROM n),
e AS (SELECT DISTINCT x.cid AS p, y.cid AS q FROM found JOIN c x ON x.message_id = a JOIN c y ON y.message_id = b WHERE x.cid <> y.cid),
l AS (SELECT cid, count(DISTINCT other) AS linked_classes FROM (SELECT p AS cid, q AS other FROM e UNION ALL SELECT q, p FROM e) GROUP BY cid)
SELECT message_id, cid, copies, coalesce(linked_classes, 0) AS linked_classes FROM c LEFT JOIN l USING (cid)""",
        "p4_invariants": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS needless_cuts, 0::BIGINT AS incomplete FROM pack_specs WHERE capacity > 0",
        "p5_found": f"WITH {_LEAKS_SQL} SELECT doc_id, item_id FROM leaks",
        "p5_items": f"WITH {_LEAKS_SQL} SELECT item_id, count(*) AS documents FROM leaks GROUP BY item_id",
    }
