"""Tokens: cutting, streams, statistics, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import segments as S
from weftline.operators import tokenize as K
from weftline.operators.ranks import ranked
from weftline.plans.conversation import _CHAT_SQL, _NUMBERED
from weftline.plans.registry import query, table, turns
from weftline.session import spread
from weftline.sources.vocab import byte_vocab

#: A small vocabulary of our own with pieces that overlap.
PIECES = ["the", "th", "t", " the ", "ing", "in", "and ", "er", "sch", " and", "ion"]
_PATTERN = K.pieces_pattern(PIECES).replace("'", "''")
#: Characters beyond the pieces count as their bytes, as a byte vocabulary does.
_TOK = f"""cut AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PATTERN}', 0)) AS piece FROM documents WHERE text IS NOT NULL)"""
_IN = "(" + ", ".join("'" + p + "'" for p in PIECES) + ")"
VOCAB = byte_vocab(PIECES)


@query("tok7_encode_counts", f"WITH {_TOK} SELECT doc_id, sum(CASE WHEN piece IN {_IN} THEN 1 ELSE strlen(piece) END)::BIGINT AS n_tokens, count_if(piece IN {_IN}) AS n_pieces FROM cut GROUP BY doc_id")
def encode_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts inside Catalyst: an alternation cuts the text, other characters count their bytes."""
    docs = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", F.explode(K.cut(F.col("text"), PIECES)).alias("piece"))
    known = F.col("piece").isin(PIECES)
    return docs.groupBy("doc_id").agg(F.sum(F.when(known, 1).otherwise(F.octet_length("piece"))).alias("n_tokens"), F.count_if(known).alias("n_pieces"))


@query("tok1_trie_counts", f"WITH {_TOK} SELECT doc_id, sum(CASE WHEN piece IN {_IN} THEN 1 ELSE strlen(piece) END)::BIGINT AS n_tokens FROM cut GROUP BY doc_id")
def trie_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by the byte trie."""
    encode = K.encoder(VOCAB)
    return spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", F.size(encode("text")).cast("bigint").alias("n_tokens"))


@query("tok2_table_counts", f"WITH {_TOK} SELECT doc_id, sum(CASE WHEN piece IN {_IN} THEN 1 ELSE strlen(piece) END)::BIGINT AS n_tokens FROM cut GROUP BY doc_id")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by a plain table of tokens."""
    encode = K.encoder(VOCAB, plain=True)
    return spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", F.size(encode("text")).cast("bigint").alias("n_tokens"))


@query("tok3_round_trip", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Decoding what was encoded gives the text again."""
    encode, decode = K.encoder(VOCAB), K.decoder(VOCAB)
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", decode(encode("text")).alias("text"))


@query("jon6_decode_join", "SELECT doc_id, text FROM documents WHERE text <> ''")
def decode_join(spark: SparkSession, d: str) -> DataFrame:
    """Decoding as a join with the vocabulary, which is of bounded size; an id without token is an error."""
    from weftline.sources.vocab import frame

    encode = K.encoder(VOCAB)
    ids = table(spark, d, "documents").where("text <> ''").select("doc_id", F.posexplode(encode("text")).alias("pos", "token_id"))
    joined = ids.join(F.broadcast(frame(spark, VOCAB)), "token_id", "left")
    checked = F.coalesce(F.hex("token"), F.raise_error(F.lit("id without token")).cast("string"))
    hexed = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", checked.alias("h")))).alias("parts"))
    return hexed.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8").alias("text"))


@query(
    "tok5_token_streams",
    f"""{_CHAT_SQL}, n AS ({_NUMBERED}), c AS (SELECT request_id, lossable, unnest(regexp_extract_all(text, '{_PATTERN}', 0)) AS piece FROM n),
k AS (SELECT request_id, CASE WHEN piece IN {_IN} THEN 1 ELSE strlen(piece) END AS t, lossable FROM c)
SELECT request_id, sum(t)::BIGINT + 1 AS n_tokens, coalesce(sum(t) FILTER (WHERE lossable), 0)::BIGINT AS n_lossable FROM k GROUP BY request_id""",
)
def token_streams(spark: SparkSession, d: str) -> DataFrame:
    """Parallel token and loss arrays of each conversation, the end token included, here as their sizes and sums."""
    return _streams(spark, d).select("request_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.aggregate("lossable", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_lossable"))


def _streams(spark: SparkSession, d: str) -> DataFrame:
    conv = S.conversations(turns(spark, d)).select("request_id", S.chat_segments(F.col("messages")).alias("segments"))
    return K.token_streams(conv, "segments", VOCAB)


#: The text up to its last token and its first three tokens, each as far as whole characters go, and the tokens lost behind.
_SAFE = f"""p AS (SELECT doc_id, regexp_extract_all(text, '{_PATTERN}', 0) AS p FROM documents WHERE text <> ''), n AS (SELECT doc_id, p, list_transform(p, lambda x: CASE WHEN x IN {_IN} THEN 1 ELSE strlen(x) END) AS n FROM p),
c AS (SELECT doc_id, p, n, list_sum(n)::BIGINT AS total, n[1] AS a, n[1] + coalesce(n[2], 0) AS b, n[1] + coalesce(n[2], 0) + coalesce(n[3], 0) AS c FROM n),
m AS (SELECT *, CASE WHEN a > 3 THEN 0 WHEN b > 3 OR len(n) < 2 THEN 1 WHEN c > 3 OR len(n) < 3 THEN 2 ELSE 3 END AS whole FROM c),
h AS (SELECT doc_id, array_to_string(p[1:whole], '') AS head, least(3, total) - CASE whole WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS head_lost,
  array_to_string(CASE WHEN total = 1 THEN p ELSE p[1:len(p) - 1] END, '') AS body, CASE WHEN total = 1 THEN 0 ELSE n[-1] - 1 END AS body_lost FROM m)"""


def _tail(lost: str) -> str:
    return f"CASE WHEN {lost} > 0 THEN '<undecodable tail x' || {lost} || '>' ELSE '' END"


@query("tok4_safe_decode", f"WITH {_SAFE} SELECT doc_id, CASE WHEN head_lost = 0 AND body_lost = 0 THEN body || head ELSE body || {_tail('body_lost')} || '<{K.PAD}>' || head || {_tail('head_lost')} || '<{K.MASK}>' END AS text FROM h")
def safe_decode(spark: SparkSession, d: str) -> DataFrame:
    """Ids with padding, masks and a cut last character."""
    encode, decode = K.encoder(VOCAB), K.decoder(VOCAB, safe=True)
    ids = table(spark, d, "documents").where("text <> ''").select("doc_id", encode("text").alias("ids"))
    broken = F.concat(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(1))), F.array(F.lit(K.PAD)), F.slice("ids", 1, 3), F.array(F.lit(K.MASK)))
    return ids.select("doc_id", decode(broken).alias("text"))


@query("tok8_incremental_emit", f"WITH {_TOK}, n AS (SELECT doc_id, sum(CASE WHEN piece IN {_IN} THEN 1 ELSE strlen(piece) END)::INTEGER AS steps FROM cut GROUP BY doc_id) SELECT doc_id, steps, text FROM n JOIN documents USING (doc_id)")
def incremental_emit(spark: SparkSession, d: str) -> DataFrame:
    """Characters shown token by token, never half of one; together they are the text."""
    encode, emit = K.encoder(VOCAB), K.emitter(VOCAB)
    shown = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", emit(encode("text")).alias("shown"))
    return shown.select("doc_id", F.size("shown").alias("steps"), F.array_join("shown", "").alias("text"))


_VOCAB_SQL = "SELECT token_id, token_bytes FROM (VALUES " + ", ".join(f"({i}, {len(t)})" for i, t in VOCAB.items()) + ") v(token_id, token_bytes)"


@query("tok6_vocabulary", _VOCAB_SQL)
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.vocab import frame

    return frame(spark, VOCAB).select("token_id", F.octet_length("token").alias("token_bytes"))


@query("src13_vocab_file", _VOCAB_SQL)
def vocab_file(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary written as a file's lines and parsed again."""
    from weftline.sources import vocab

    lines = [vocab.format_line(i, t) for i, t in VOCAB.items()]
    return vocab.frame(spark, vocab.parse(lines)).select("token_id", F.octet_length("token").alias("token_bytes"))


_LENGTHS = "sizes AS (SELECT doc_id, length(text)::BIGINT AS size, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS lossable FROM documents WHERE text IS NOT NULL)"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Characters stand for tokens, small Latin letters for lossable ones."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.char_length("text").cast("bigint").alias("size"), F.char_length(F.regexp_replace("text", "[^a-z]", "")).cast("bigint").alias("lossable"))


@query("agg1_store_totals", f"WITH {_LENGTHS} SELECT count(*) AS docs, sum(size)::BIGINT AS tokens, sum(lossable)::BIGINT AS lossable_tokens, round(100.0 * sum(lossable) / greatest(sum(size), 1), 2) AS lossable_pct FROM sizes")
def store_totals(spark: SparkSession, d: str) -> DataFrame:
    t, l = F.sum("size"), F.sum("lossable")
    return sizes(spark, d).agg(F.count(F.lit(1)).alias("docs"), t.alias("tokens"), l.alias("lossable_tokens"), F.round(F.lit(100.0) * l / F.greatest(t, F.lit(1)), 2).alias("lossable_pct"))


@query("agg2_sidecar_ratio", f"WITH {_LENGTHS} SELECT sum(lossable)::BIGINT AS lossable, round(sum(lossable) / greatest(sum(size), 1), 6) AS ratio FROM sizes")
def sidecar_ratio(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d).agg(F.sum("lossable").alias("lossable"), F.round(F.sum("lossable") / F.greatest(F.sum("size"), F.lit(1)), 6).alias("ratio"))


#: Length limit of the queries: what one sample of 6144 tokens in blocks of 32 holds.
RAW_LEN = 6144 // (3 * 32) * 32


@query("flt4_nonzero_docs", f"WITH {_LENGTHS} SELECT doc_id, size FROM sizes WHERE size > 0")
def nonzero_docs(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d).where("size > 0").select("doc_id", "size")


@query("flt5_length_filter", f"WITH {_LENGTHS} SELECT doc_id, size FROM sizes WHERE size BETWEEN 1 AND {RAW_LEN}")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d).where(F.col("size").between(1, RAW_LEN)).select("doc_id", "size")


@query("agg3_valid_share", f"WITH {_LENGTHS} SELECT count_if(size BETWEEN 1 AND {RAW_LEN}) AS valid, count(*) AS total, round(100.0 * count_if(size BETWEEN 1 AND {RAW_LEN}) / greatest(count(*), 1), 4) AS pct, coalesce(sum(size) FILTER (WHERE size BETWEEN 1 AND {RAW_LEN}), 0)::BIGINT AS kept_tokens FROM sizes")
def valid_share(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("size").between(1, RAW_LEN)
    n, all_ = F.count_if(ok), F.count(F.lit(1))
    return sizes(spark, d).agg(n.alias("valid"), all_.alias("total"), F.round(F.lit(100.0) * n / F.greatest(all_, F.lit(1)), 4).alias("pct"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("kept_tokens"))


@query("agg4_mean_median", f"WITH {_LENGTHS} SELECT round(avg(size), 6) AS mean_size, median(size) AS median_size FROM sizes WHERE size BETWEEN 1 AND {RAW_LEN}")
def mean_median(spark: SparkSession, d: str) -> DataFrame:
    """The exact median, interpolated; its state is one count for each distinct size."""
    return length_filter(spark, d).agg(F.round(F.avg("size"), 6).alias("mean_size"), F.median("size").alias("median_size"))


@query(
    "agg5_lossable_per_sample",
    f"WITH {_LENGTHS} SELECT round(avg(lossable) FILTER (WHERE size BETWEEN 1 AND {RAW_LEN}) * 0.55, 6) AS supervised_per_sample, round(100.0 * sum(lossable) / greatest(sum(size), 1), 4) AS lossable_pct_all FROM sizes",
)
def lossable_per_sample(spark: SparkSession, d: str) -> DataFrame:
    """Mean lossable tokens of valid documents times the expected mask ratio; the percentage is over all documents."""
    valid = F.when(F.col("size").between(1, RAW_LEN), F.col("lossable"))
    return sizes(spark, d).agg(F.round(F.avg(valid) * 0.55, 6).alias("supervised_per_sample"), F.round(F.lit(100.0) * F.sum("lossable") / F.greatest(F.sum("size"), F.lit(1)), 4).alias("lossable_pct_all"))


@query(
    "agg6_budget",
    f"""WITH {_LENGTHS}, v AS (SELECT avg(lossable) * 0.55 AS s, avg(size) AS m, count(*) AS n FROM sizes WHERE size BETWEEN 1 AND {RAW_LEN})
SELECT target, round(target / s, 4) AS samples, round(target / s * m, 2) AS real_tokens, round(target / s / n, 6) AS epochs FROM v, (VALUES (1000000), (50000000)) t(target)""",
)
def budget(spark: SparkSession, d: str) -> DataFrame:
    """Samples, tokens and epochs needed for a number of supervised tokens."""
    v = sizes(spark, d).where(F.col("size").between(1, RAW_LEN)).agg((F.avg("lossable") * 0.55).alias("s"), F.avg("size").alias("m"), F.count(F.lit(1)).alias("n"))
    goals = v.select("*", F.explode(F.array(F.lit(1_000_000), F.lit(50_000_000))).alias("target"))
    samples = F.col("target") / F.col("s")
    return goals.select("target", F.round(samples, 4).alias("samples"), F.round(samples * F.col("m"), 2).alias("real_tokens"), F.round(samples / F.col("n"), 6).alias("epochs"))


@query("win1_pointers", f"WITH {_LENGTHS} SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 4 AS pointer FROM sizes")
def pointers(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive prefix sums over the whole table in two passes."""
    return ranked(sizes(spark, d), [], ["doc_id"], total=F.col("size"), total_name="before").select("doc_id", "size", (F.col("before") * 4).alias("pointer"))


@query("win2_split_points", f"WITH {_LENGTHS} SELECT doc_id, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS split_at FROM sizes")
def split_points(spark: SparkSession, d: str) -> DataFrame:
    return ranked(sizes(spark, d), [], ["doc_id"], total=F.col("size"), total_name="before").select("doc_id", (F.col("before") + F.col("size")).alias("split_at"))


@query("win3_ordinal", f"WITH {_LENGTHS} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM sizes WHERE size BETWEEN 1 AND {RAW_LEN}")
def ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Dense ordinals of valid documents."""
    return ranked(length_filter(spark, d), [], ["doc_id"], "ordinal").select("doc_id", F.col("ordinal").cast("bigint"))


@query("jon3_index_lookup", f"WITH {_LENGTHS}, p AS (SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 4 AS pointer FROM sizes) SELECT w.doc_id, p.size, p.pointer FROM (SELECT DISTINCT doc_id FROM subject_labels) w JOIN p USING (doc_id)")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "subject_labels").select("doc_id").distinct()
    return wanted.join(pointers(spark, d), "doc_id").select("doc_id", "size", "pointer")


_CHARS = "cut AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE text <> ''), chars AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) AS pos FROM cut)"


@query("jon1_token_loss_zip", f"WITH {_CHARS} SELECT doc_id, count(*) AS tokens, count_if(ch BETWEEN 'a' AND 'z') AS lossable, coalesce(sum(pos) FILTER (WHERE ch BETWEEN 'a' AND 'z'), 0)::BIGINT AS places FROM chars GROUP BY doc_id")
def token_loss_zip(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and loss bits by position: two arrays of one row need no join."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.regexp_extract_all("text", F.lit("(?s:.)"), F.lit(0)).alias("token"))
    bits = F.transform("token", lambda c: c.between("a", "z"))
    zipped = docs.select("doc_id", "token", bits.alias("lossable")).select("doc_id", F.posexplode(F.arrays_zip("token", "lossable")).alias("pos", "z"))
    return zipped.groupBy("doc_id").agg(F.count("z.token").alias("tokens"), F.count_if("z.lossable").alias("lossable"), F.sum(F.when(F.col("z.lossable"), F.col("pos") + 1).otherwise(0)).alias("places"))


@query(
    "jon4_flat_windows",
    f"""WITH {_LENGTHS}, s AS (SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes WHERE size > 0),
w AS (SELECT i AS win, i * 4096 AS lo, i * 4096 + 4097 AS hi FROM range(0, (SELECT (sum(size) // 4096)::BIGINT FROM s)) r(i))
SELECT win, doc_id, greatest(start, lo) - start AS doc_from, least(start + size, hi) - start AS doc_to FROM w JOIN s ON start < hi AND start + size > lo""",
)
def flat_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents under each window of a flat stream."""
    from weftline.operators.sampling import flat_window_parts

    return flat_window_parts(nonzero_docs(spark, d), 4096)


@query("agg18_token_counts", f"WITH {_TOK} SELECT piece, count(*) AS n FROM cut WHERE piece IN {_IN} GROUP BY piece")
def piece_counts(spark: SparkSession, d: str) -> DataFrame:
    """Dense counts of the tokens of a vocabulary."""
    docs = table(spark, d, "documents").where("text <> ''").select(F.explode(K.cut(F.col("text"), PIECES)).alias("piece"))
    return docs.where(F.col("piece").isin(PIECES)).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@query("win5_next_token", f"WITH {_CHARS}, n AS (SELECT doc_id, pos, ch AS x, lead(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM chars) SELECT doc_id, count(*) AS targets, count_if(x = y) AS repeats, sum(pos * unicode(y))::BIGINT AS weighted FROM n WHERE y IS NOT NULL GROUP BY doc_id")
def next_token(spark: SparkSession, d: str) -> DataFrame:
    """Inputs and targets shifted by one, within the row."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.regexp_extract_all("text", F.lit("(?s:.)"), F.lit(0)).alias("t"))
    n = F.size("t") - 1
    pairs = docs.where(n > 0).select("doc_id", F.posexplode(F.arrays_zip(F.slice("t", F.lit(1), n).alias("x"), F.slice("t", F.lit(2), n).alias("y"))).alias("pos", "z"))
    weighted = (F.col("pos") + 1).cast("bigint") * F.ascii("z.y")
    return pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("z.x") == F.col("z.y")).alias("repeats"), F.sum(weighted).alias("weighted"))
