"""Sources, task control and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import control as C
from weftline.operators import hooks as H
from weftline.operators import segments as S
from weftline.operators import tokenize as K
from weftline.plans import scoring as _scoring  # noqa: F401  (its SQL is used below)
from weftline.plans.conversation import _CHAT_SQL
from weftline.plans.registry import SQL, TURNS, query, table, turns
from weftline.plans.tokens import VOCAB
from weftline.session import own_path
from weftline.sources import binidx, config, jsonl


@query("src1_chat_dataset", f"WITH {TURNS} SELECT role, count(*) AS n FROM turns GROUP BY role")
def chat_dataset(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("src4_jsonl_scan", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """Legacy lines with blank ones between, parsed with the fallback; a malformed line would be an error."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array(F.to_json(F.struct("text")), F.lit("  "))).alias("value"))
    kept = docs.where(F.trim("value") != "").select("doc_id", F.from_json("value", jsonl.ROW, {"mode": "FAILFAST"}).alias("r"))
    return kept.select("doc_id", S.flat_text(jsonl.with_fallback(F.col("r.segments"), F.col("r.text"))).alias("text"))


@query("flt2_nonblank_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS lines FROM l WHERE trim(line) <> '' GROUP BY doc_id")
def nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.trim("line") != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query("src5_legacy_fallback", "SELECT item_id, coalesce(solution, question) AS text, solution IS NULL AS lossable FROM eval_items")
def legacy_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows with segments keep them, rows with a text only become one lossable segment."""
    rows = table(spark, d, "eval_items").select("item_id", F.when(F.col("solution").isNotNull(), F.array(F.struct(F.col("solution").alias("text"), F.lit(False).alias("lossable")))).alias("segments"), "question")
    one = rows.select("item_id", F.element_at(jsonl.with_fallback(F.col("segments"), F.col("question")), 1).alias("s"))
    return one.select("item_id", "s.text", "s.lossable")


def _store(spark: SparkSession, d: str) -> str:
    """A store of the tokenized conversations."""
    conv = S.conversations(turns(spark, d)).select(F.col("request_id").alias("doc_order"), S.chat_segments(F.col("messages")).alias("segments"))
    prefix = own_path(spark, "chat")
    binidx.write(K.token_streams(conv, "segments", VOCAB), prefix)
    return prefix


@query(
    "src10_store_slice",
    f"""SELECT doc_id, n_tokens AS size, n_lossable FROM (SELECT *, row_number() OVER (ORDER BY request_id) - 1 AS doc_id, count(*) OVER () AS n FROM ({SQL["tok5_token_streams"]}))
WHERE doc_id >= n // 4 AND doc_id < n - n // 4""",
)
def store_slice(spark: SparkSession, d: str) -> DataFrame:
    """The middle half of a store, a contiguous range of its documents that grows with it."""
    prefix = _store(spark, d)
    n = binidx.header(prefix)[1]
    middle = binidx.contiguous(binidx.read(spark, prefix), n // 4, n - n // 4)
    return middle.select("doc_id", F.size("tokens").alias("size"), F.aggregate("lossable", F.lit(0), lambda a, x: a + x).alias("n_lossable"))


_TASKS = """tasks:
  first_task:
    num_fewshot: 5
    max_gen_toks: 1024
    gen_kwargs:
      temperature: 0.7
      block_size: 32
  second_task:
    unsafe_code: true
    fewshot_as_multiturn: false
"""


@query("src15_task_config", "SELECT * FROM (VALUES ('first_task', 5, false, 1024, '0.7'), ('second_task', NULL, true, NULL, NULL)) t(task, num_fewshot, unsafe_code, max_gen_toks, temperature)")
def task_config(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(config.task_rows(_TASKS), config.TASK)
    return rows.select("task", "num_fewshot", "unsafe_code", "max_gen_toks", F.try_element_at("gen_kwargs", F.lit("temperature")).alias("temperature"))


_DATASETS = "ds AS (SELECT task AS name, 'data/' || task AS path, lang AS config, contains(task, 'code') AS gated, count(solution) * 2 >= count(*) AS ok FROM eval_items GROUP BY ALL)"


def _prefetch(spark: SparkSession, d: str) -> DataFrame:
    """Tasks as datasets, languages as their configurations; those with code are gated, loading works where most items are solved."""
    catalog = table(spark, d, "eval_items").groupBy(F.col("task").alias("name"), F.concat(F.lit("data/"), "task").alias("path"), F.col("lang").alias("config"), F.contains("task", F.lit("code")).alias("gated"))
    return catalog.agg((F.count("solution") * 2 >= F.count(F.lit(1))).alias("ok"))


@query("src19_prefetch_plan", f"WITH {_DATASETS} SELECT name, config, CASE WHEN gated THEN 'skip' ELSE 'fetch' END AS action FROM ds WHERE name IN (SELECT DISTINCT name FROM ds WHERE length(name) % 2 = 0)")
def prefetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Datasets wanted by name, without the gated ones."""
    datasets = _prefetch(spark, d)
    wanted = [r[0] for r in datasets.where("length(name) % 2 = 0").select("name").distinct().collect()]  # names of tasks, as on a command line
    return C.prefetch_plan(datasets, wanted, skip_gated=True).select("name", "config", "action")


@query("src19_prefetch_outcome", f"WITH {_DATASETS}, f AS (SELECT path || ':' || config AS label, gated FROM ds WHERE NOT ok) SELECT coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM f), '') AS failures, CASE WHEN EXISTS (SELECT 1 FROM f WHERE NOT gated) THEN 1 ELSE 0 END AS exit_code")
def prefetch_outcome(spark: SparkSession, d: str) -> DataFrame:
    """What failed, and whether anything failed that is not gated."""
    return C.prefetch_outcome(_prefetch(spark, d)).select(F.array_join("failures", "|").alias("failures"), "exit_code")


@query("src19_gated_failures_pass", f"WITH {_DATASETS} SELECT coalesce(string_agg(path || ':' || config, '|' ORDER BY path || ':' || config) FILTER (WHERE gated AND NOT ok), '') AS failures, 0 AS exit_code FROM ds")
def gated_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of gated datasets alone are none."""
    return C.prefetch_outcome(_prefetch(spark, d).withColumn("ok", F.col("ok") | ~F.col("gated"))).select(F.array_join("failures", "|").alias("failures"), "exit_code")


_NAMES = "choice_stem_0, math_counting_0,no_such_task"


@query("flt6_subset", "SELECT DISTINCT task FROM task_metrics WHERE task IN ('choice_stem_0', 'math_counting_0', 'no_such_task')")
def subset(spark: SparkSession, d: str) -> DataFrame:
    return C.selected(table(spark, d, "task_metrics").select("task").distinct(), _NAMES)


@query("flt7_resume", "SELECT item_id FROM eval_items WHERE item_id NOT IN (SELECT item_id FROM eval_responses WHERE item_id IS NOT NULL)")
def resume(spark: SparkSession, d: str) -> DataFrame:
    """Items without any response yet."""
    return C.unfinished(table(spark, d, "eval_items").select("item_id"), table(spark, d, "eval_responses").select("item_id"), "item_id")


@query("flt8_presets", "SELECT r_name AS name, r_regionkey::INTEGER AS r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def presets(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("r_regionkey"))
    return C.presets(regions, ["ASIA", "EUROPE"])


@query("jon9_inherited", "SELECT n.n_name, coalesce(CASE WHEN n.n_nationkey % 3 = 0 THEN n.n_name END, r.r_name) AS label, coalesce(CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_nationkey END, r.r_regionkey)::BIGINT AS rank FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def inherited(spark: SparkSession, d: str) -> DataFrame:
    """Own values before those of the template included; nations include regions."""
    key = F.col("n_nationkey").cast("bigint")
    children = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("bigint").alias("include"), F.when(key % 3 == 0, F.col("n_name")).alias("label"), F.when(key % 2 == 0, key).alias("rank"))
    templates = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("template"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("bigint").alias("rank"))
    return C.inherited(children, templates, "include", ["label", "rank"]).select("n_name", "label", "rank")


_EXTRAS = "ex AS (SELECT DISTINCT ON (request_id) request_id, extras FROM chat_requests WHERE request_id IS NOT NULL)"


@query(
    "jon10_overrides",
    f"""WITH {_EXTRAS}, own AS (SELECT request_id, unnest(map_keys(extras)) AS key, unnest(map_values(extras)) AS value FROM ex), general(key, value) AS (VALUES ('conf_threshold', '0.8'), ('steps', '32'))
SELECT coalesce(o.request_id, g.request_id) AS request_id, coalesce(o.key, g.key) AS key, coalesce(o.value, g.value) AS value FROM own o FULL JOIN (SELECT request_id, key, value FROM ex, general) g ON o.request_id = g.request_id AND o.key = g.key""",
)
def overrides(spark: SparkSession, d: str) -> DataFrame:
    """General arguments with those of each request over them."""
    once = table(spark, d, "chat_requests").where("request_id is not null").groupBy("request_id").agg(F.first(F.struct("extras")).alias("x"))
    general = F.create_map(F.lit("conf_threshold"), F.lit("0.8"), F.lit("steps"), F.lit("32"))
    own = F.coalesce(F.col("x.extras"), F.create_map().cast("map<string,string>"))
    return once.select("request_id", F.explode(C.overridden(general, own)).alias("key", "value"))


@query("jon12_combined", "SELECT s_suppkey AS key, s_acctbal AS value FROM supplier")
def combined(spark: SparkSession, d: str) -> DataFrame:
    """Values for all names wanted; were one not held, its name would be the error."""
    held = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return C.combined(held.select("key"), held, "key", "value")


@query("udf3_repeats", "SELECT item_id, k::INTEGER AS attempt FROM eval_items, range(0, 4) r(k)")
def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Each item once for each attempt."""
    return C.repeated(table(spark, d, "eval_items").select("item_id"), 4)


_GSM, _MMLU = SQL["scr_gsm"], SQL["scr_mmlu"]


def _long(name: str, sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS task, '{m}' AS metric, response_id, {m} AS value FROM ({sql})" for m in ("exact", "flexible", "loose"))


@query("udf1_hooks", f"SELECT task, metric, count(*) AS n, round(avg(value), 9) AS mean FROM ({_long('number', _GSM)} UNION ALL {_long('letter', _MMLU)}) GROUP BY ALL")
def hooked_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks by their hooks: documents to prompts and targets, responses filtered, scored, averaged."""
    responses = table(spark, d, "eval_responses").select("response_id", "item_id", "response").distinct()
    items = table(spark, d, "eval_items")
    both = [H.scored(name, items, responses, "item_id").select(F.lit(name).alias("task"), "metric", "value") for name in ("number", "letter")]
    return both[0].unionByName(both[1]).groupBy("task", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("udf1_prompts", f"SELECT item_id, 'Q: ' || question || chr(10) || 'A:' AS text, gold AS target FROM eval_items JOIN ({SQL['scr2_gold']}) USING (item_id) WHERE solution IS NOT NULL")
def hooked_prompts(spark: SparkSession, d: str) -> DataFrame:
    return H.prompts("number", table(spark, d, "eval_items"), "item_id")


@query("udf5_pass_k", "SELECT k, 'task: code' || chr(10) || 'repeats: ' || k || chr(10) || 'metric: pass@' || k AS config FROM (SELECT DISTINCT attempt::INTEGER + 1 AS k FROM eval_responses WHERE attempt IS NOT NULL)")
def pass_k(spark: SparkSession, d: str) -> DataFrame:
    """A configuration for each number of attempts, from one template."""
    template = "task: code\nrepeats: __PASS_K__\nmetric: pass@__PASS_K__"
    counts = [r[0] for r in table(spark, d, "eval_responses").where("attempt is not null").select((F.col("attempt") + 1).cast("int")).distinct().collect()]  # as many as there are attempts of an item
    return spark.createDataFrame([(k, config.materialized(template, PASS_K=k)) for k in counts], "k int, config string")


@query("prj22_knobs", "SELECT request_id, 'T=' || temperature::DECIMAL(9,3)::VARCHAR || ' p=' || top_p::DECIMAL(9,3)::VARCHAR || ' n=' || n AS line FROM (SELECT DISTINCT ON (request_id) * FROM chat_requests WHERE request_id IS NOT NULL)")
def knobs(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "chat_requests").where("request_id is not null").groupBy("request_id").agg(F.first(F.struct("temperature", "top_p", "n")).alias("r"))
    return once.select("request_id", C.knobs(T=F.col("r.temperature").cast("decimal(9,3)"), p=F.col("r.top_p").cast("decimal(9,3)"), n=F.col("r.n")).alias("line"))


@query("str4_incremental_ingest", f"{_CHAT_SQL} SELECT count(*)::INTEGER AS n_segments, string_agg(text, '' ORDER BY i, part) AS text FROM parts GROUP BY request_id")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Segment files read as a stream into a table."""
    from weftline.streaming.ingest import ingest

    base = own_path(spark, "ingest")
    conv = S.conversations(turns(spark, d)).select(S.chat_segments(F.col("messages")).alias("segments"))
    jsonl.write(conv, f"{base}/in")
    ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.size("segments").alias("n_segments"), S.flat_text(F.col("segments")).alias("text"))
