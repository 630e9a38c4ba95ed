"""Stores, result files, samples and reports: written, read back and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import requests as R
from weftline.operators.metrics import sweep_report, write_report
from weftline.plans.conversation import _CHOICES, choices
from weftline.plans.registry import query, table
from weftline.session import own_path, spread
from weftline.sources import binidx, config, subsets

#: A store of the texts, a code point a token, small Latin letters lossable; texts without characters are left out.
_FLAT = """docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text, length(text)::INTEGER AS size, length(regexp_replace(text, '[^a-z]', '', 'g'))::INTEGER AS lossable FROM documents WHERE text <> ''),
flat AS (SELECT *, coalesce(sum(size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, count(*) OVER () AS n, (sum(size) OVER ())::BIGINT AS total FROM docs)"""


def _losses() -> Column:
    return F.aggregate("lossable", F.lit(0), lambda a, x: a + x).alias("n_lossable")


def _shards(spark: SparkSession, d: str) -> str:
    docs = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text"))
    codes = docs.select(F.col("doc_id").alias("doc_order"), F.transform(F.regexp_extract_all("text", F.lit("(?s:.)"), F.lit(0)), F.ascii).alias("tokens"))
    path = own_path(spark, "store")
    binidx.write_shards(codes.withColumn("lossable", F.transform("tokens", lambda c: c.between(ord("a"), ord("z")).cast("tinyint"))), path)
    return path


def _single(spark: SparkSession, d: str) -> str:
    path = _shards(spark, d)
    binidx.export(path, f"{path}/all")
    return f"{path}/all"


@query("src6_binidx_roundtrip", f"WITH {_FLAT} SELECT i AS doc_id, size, start * 4 AS pointer, lossable AS n_lossable, i + start AS weighted FROM flat")
def roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as shards, joined into one set of files and read again."""
    read = binidx.read(spark, _single(spark, d))
    return read.select("doc_id", F.size("tokens").alias("size"), "pointer", _losses(), (F.col("doc_id") + F.expr("pointer div 4")).alias("weighted"))


@query("src7_sizes_only", f"WITH {_FLAT} SELECT i AS doc_id, size FROM flat")
def sizes_only(spark: SparkSession, d: str) -> DataFrame:
    """Sizes from the indexes alone."""
    return binidx.read(spark, _shards(spark, d), "sizes")


@query(
    "src8_random_access",
    f"""WITH {_FLAT}, c AS (SELECT i, regexp_extract_all(text, '(?s).') AS ch FROM docs), e AS (SELECT i, unnest(ch) AS ch, generate_subscripts(ch, 1) - 1 AS pos FROM c),
g AS (SELECT start + pos AS place, unicode(ch) AS code FROM e JOIN flat USING (i)),
w AS (SELECT i, start + size // 2 AS lo, least(20, total - start - size // 2)::BIGINT AS length FROM flat), p AS (SELECT i, length, unnest(range(lo, lo + length)) AS place FROM w)
SELECT i AS idx, length, string_agg(code::VARCHAR, ',' ORDER BY place) AS part FROM p JOIN g USING (place) GROUP BY i, length""",
)
def random_access(spark: SparkSession, d: str) -> DataFrame:
    """Twenty tokens from the middle of each document on, which run on into the documents behind a short one."""
    path = _shards(spark, d)
    total = sum(s.tokens for s in binidx.shards(path))
    middle, start = F.expr("size div 2"), F.expr("pointer div 4")
    wanted = binidx.read(spark, path).select(F.col("doc_id").alias("idx"), middle.alias("offset"), F.least(F.lit(20), F.lit(total) - start - middle).alias("length"))
    return binidx.get(wanted, path).select("idx", "length", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("part"))


_JOINED = "array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::VARCHAR), ',')"


@query("src9_by_index", f"WITH {_FLAT} SELECT i AS doc_id, {_JOINED} AS tokens FROM flat WHERE i = n // 3")
def by_index(spark: SparkSession, d: str) -> DataFrame:
    """One document by its number; the condition reaches the reader, which opens its range only."""
    path = _shards(spark, d)
    one = binidx.at(binidx.read(spark, path), sum(s.docs for s in binidx.shards(path)) // 3)
    return one.select("doc_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query("src10_contiguous", f"WITH {_FLAT} SELECT i AS doc_id, size, lossable AS n_lossable FROM flat WHERE i >= n // 4 AND i < n // 2")
def contiguous(spark: SparkSession, d: str) -> DataFrame:
    """The second quarter of a store, a contiguous range that grows with it."""
    path = _shards(spark, d)
    n = sum(s.docs for s in binidx.shards(path))
    return binidx.contiguous(binidx.read(spark, path), n // 4, n // 2).select("doc_id", F.size("tokens").alias("size"), _losses())


@query("src11_exists", "SELECT * FROM (VALUES ('index without tokens', false), ('nothing', false), ('shards', true), ('single', true)) t(store, found)")
def exists(spark: SparkSession, d: str) -> DataFrame:
    path = _shards(spark, d)
    binidx.export(path, f"{path}/all")
    config.put(spark, f"{path}/half.idx", "x")
    found = {"single": f"{path}/all", "shards": path, "index without tokens": f"{path}/half", "nothing": f"{path}/none"}
    return spark.createDataFrame([(k, binidx.exists(v)) for k, v in found.items()], "store string, found boolean")


@query(
    "src12_sidecar",
    f"""WITH {_FLAT} SELECT 'own' AS sidecar, i AS doc_id, lossable AS n_lossable FROM flat UNION ALL SELECT 'longer name', i, 0 FROM flat UNION ALL SELECT 'none', i, size FROM flat""",
)
def sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Loss bits from the file beside the tokens, before that from the one of the longer name, without either all ones."""
    path = _single(spark, d)
    fs, jpath = spark._jvm.org.apache.hadoop.fs, lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsc.hadoopConfiguration()
    system = jpath(path).getFileSystem(conf)
    for name in ("longer", "none"):
        for suffix in (".idx", ".bin"):
            fs.FileUtil.copy(system, jpath(path + suffix), system, jpath(f"{path}-{name}{suffix}"), False, conf)
    fs.FileUtil.copy(system, jpath(path + binidx.SUFFIXES[1]), system, jpath(f"{path}-longer{binidx.SUFFIXES[1]}"), False, conf)
    binidx.fill(f"{path}-longer{binidx.SUFFIXES[0]}", 0, binidx.tokens_by_file(path))
    stores = {"own": path, "longer name": f"{path}-longer", "none": f"{path}-none"}
    parts = [binidx.read(spark, p).select(F.lit(k).alias("sidecar"), "doc_id", _losses()) for k, p in stores.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src14_tokens_by_bytes", f"WITH {_FLAT} SELECT max(total) AS tokens, max(total) * 4 AS bytes FROM flat")
def tokens_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a stream by the length of its file; a length that is no whole number of tokens is an error."""
    path = _single(spark, d)
    length = spark.read.format("binaryFile").load(path + ".bin").select("length")
    return length.select(F.lit(binidx.tokens_by_file(path)).cast("bigint").alias("tokens"), F.col("length").alias("bytes"))


@query("src2_variant", "SELECT item_id, question FROM eval_items WHERE choices IS NULL")
def variant(spark: SparkSession, d: str) -> DataFrame:
    """A dataset under the file name of its variant, read by the variant's name."""
    folder = own_path(spark, "variants")
    items = table(spark, d, "eval_items")
    items.where("choices is null").select("item_id", "question").write.json(f"{folder}/{subsets.VARIANTS['instruct']}")
    items.where("choices is not null").select("item_id", "question").write.json(f"{folder}/{subsets.VARIANTS['full']}")
    return subsets.read_variant(spark, folder, "item_id bigint, question string", "instruct")


@query("src17_columnar_dataset", "SELECT task, lang, count(*) AS n FROM eval_items GROUP BY ALL")
def columnar(spark: SparkSession, d: str) -> DataFrame:
    """A dataset kept on disk in columns."""
    return subsets.read(spark, f"{d}/eval_items.parquet").groupBy("task", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("src22_mirror", "SELECT * FROM (VALUES (1, 'docs', 'copied', 600::BIGINT), (1, 'none', 'missing', 600), (2, 'docs', 'kept', 600), (2, 'none', 'missing', 600)) t(call, name, action, rows)".replace("600::BIGINT", "(SELECT count(*) FROM eval_items)").replace("600", "(SELECT count(*) FROM eval_items)"))
def mirror(spark: SparkSession, d: str) -> DataFrame:
    """A folder copied where it is missing, kept the second time."""
    base = own_path(spark, "mirror")
    table(spark, d, "eval_items").write.parquet(f"{base}/from/docs")
    first, second = (subsets.mirrored(spark, f"{base}/from", f"{base}/to", ["docs", "none"]) for _ in range(2))
    calls = first.withColumn("call", F.lit(1)).unionByName(second.withColumn("call", F.lit(2)))
    return calls.select("call", "name", "action", F.lit(spark.read.parquet(f"{base}/to/docs").count()).cast("bigint").alias("rows"))


_METRICS = "m AS (SELECT task, metric, max(value) AS value FROM task_metrics WHERE value IS NOT NULL AND task IS NOT NULL AND metric IS NOT NULL GROUP BY ALL)"


@query("src16_result_files", f"WITH {_METRICS} SELECT task, metric, value, NULL::VARCHAR AS error FROM m UNION ALL SELECT NULL, NULL, NULL, 'unreadable'")
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Result files in folders below one another: a summary is passed over, a broken file gives a row with an error."""
    folder = own_path(spark, "results")
    best = table(spark, d, "task_metrics").where("value is not null and task is not null and metric is not null").groupBy("task", "metric").agg(F.max("value").alias("value"))
    maps = best.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    config.write_results(maps.select("task", F.create_map("task", "metrics").alias("results")).repartition("task"), folder)
    config.put(spark, f"{folder}/summary.json", "{}")
    config.put(spark, f"{folder}/late/broken.json", "{nothing")
    read = config.read_results(spark, folder)
    tasks = read.select(F.explode_outer("results").alias("task", "metrics"), "error").select("task", F.explode_outer("metrics").alias("metric", "value"), "error")
    return tasks.select("task", "metric", F.col("value").cast("double").alias("value"), "error")


_SAMPLES = "SELECT DISTINCT task, response_id, item_id, response FROM eval_responses JOIN eval_items USING (item_id)"


@query("snk4_samples", f"SELECT 'samples_' || task || '.jsonl' AS file, response_id, item_id, response FROM ({_SAMPLES})")
def samples(spark: SparkSession, d: str) -> DataFrame:
    """The answers of each task in its own file of samples."""
    folder = own_path(spark, "samples")
    answers = table(spark, d, "eval_responses").select("response_id", "item_id", "response").distinct()
    config.write_samples(answers.join(table(spark, d, "eval_items").select("item_id", "task"), "item_id"), folder)
    return config.read_samples(spark, folder, "response_id bigint, item_id bigint, response string").select("file", "response_id", "item_id", "response")


@query("snk6_speed_log", f"WITH {_CHOICES} SELECT length(coalesce(content, ''))::BIGINT AS n_completion, (completion_id % 7 + 1)::DOUBLE AS elapsed FROM choices")
def speed_log(spark: SparkSession, d: str) -> DataFrame:
    """The speed log after two appends."""
    path = own_path(spark, "speed")
    speeds = choices(spark, d).select("choice_index", F.char_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("n_completion"), (F.col("completion_id") % 7 + 1).cast("double").alias("elapsed"))
    for part in (speeds.where("choice_index = 0"), speeds.where("choice_index <> 0")):
        R.append_speed(part, path)
    return R.read_speed(spark, path)


_NL = "chr(10)"
_FENCE = f"'```' || {_NL}"
_RUNS = f"""r AS (SELECT run_id, count(*) AS n, max(response) AS text, coalesce(bool_or(passed), false) AS ok FROM (SELECT DISTINCT response_id, run_id, response, passed FROM eval_responses WHERE run_id IS NOT NULL) GROUP BY run_id),
runs AS (SELECT row_number() OVER (ORDER BY run_id)::INTEGER AS ord, *, (n / 4.0)::DOUBLE AS seconds FROM r)"""


@query(
    "snk8_sweep_report",
    f"""WITH {_RUNS} SELECT 0 AS ord, '# Sweep' || {_NL} || {_NL} || '- **steps** = 32' || {_NL} || '- **prompt**:' || {_NL} || {_NL} || {_FENCE} || 'Why?' || {_NL} || '```' || {_NL} || {_NL} AS block
UNION ALL SELECT ord, '## ' || ord || '. `' || run_id || '`  (' || CASE WHEN ok THEN 'OK [stop, ' || n || ' tok]' ELSE 'FAIL: ValueError' END || ', ' || round(seconds, 1)::DECIMAL(18,1)::VARCHAR || 's)' || {_NL} || {_NL}
|| {_FENCE} || 'n=' || n || {_NL} || '```' || {_NL} || {_NL} || {_FENCE} || CASE WHEN ok THEN coalesce(text, '') ELSE 'ValueError: none passed' END || {_NL} || '```' || {_NL} || {_NL} || '---' || {_NL} || {_NL} FROM runs""",
)
def report(spark: SparkSession, d: str) -> DataFrame:
    """A report over the runs of the evaluation: a head and a section for each."""
    once = table(spark, d, "eval_responses").where("run_id is not null").select("response_id", "run_id", "response", "passed").distinct()
    runs = once.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("response").alias("text"), F.coalesce(F.bool_or("passed"), F.lit(False)).alias("ok"))
    ranks = F.array_position(F.sort_array(runs.agg(F.collect_list("run_id")).scalar()), F.col("run_id"))  # runs of one evaluation are few
    error = F.when(~F.col("ok"), F.lit("ValueError: none passed"))
    rows = runs.select(ranks.alias("ord"), F.col("run_id").alias("name"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("knobs"), "text", F.lit("stop").alias("finish"), F.col("n").alias("n_tokens"), (F.col("n") / 4).alias("seconds"), error.alias("error"))
    return sweep_report(rows, "Sweep", "- **steps** = 32", "Why?")


@query("snk8_report_file", "SELECT 1 AS files, 3 + 9 * count(DISTINCT run_id) >= 12 AS long_enough FROM eval_responses WHERE run_id IS NOT NULL")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """The report written as one file."""
    path = own_path(spark, "report")
    write_report(report(spark, d), path)
    text = spark.read.text(path, wholetext=True)
    return text.agg(F.count(F.lit(1)).cast("int").alias("files"), F.bool_and(F.startswith("value", F.lit("# Sweep\n")) & (F.size(F.split("value", "\n")) >= 12)).alias("long_enough"))
