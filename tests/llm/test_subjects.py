"""Subjects of made-up corpora."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import subjects as S

WORDS = {s: [f"{s[:3]}{x}" for x in "abcdefghijklmno"] for s in ("cooking", "law", "music", "sport")}
COMMON = [f"com{x}" for x in "abcdefghijklmnopqrst"]
AREAS = [(s, s.title(), "all about it") for s in WORDS]
DOCS, LABELS, AREA = "doc_id bigint, text string", "doc_id bigint, subject string, annotator string", "subject string, title string, scope string"


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        sentences = []
        for s in own:
            sentences += [" ".join(rng.choices(WORDS[s], k=4) + rng.choices(COMMON, k=3)) for _ in range(6)]
        if not own:
            sentences = [" ".join(rng.choices(COMMON, k=8)) for _ in range(5)]
        docs.append((i, ". ".join(sentences) + "."))
        truth[i] = set(own)
    labels = []
    for i in range(0, n, 5):
        for rater in range(rng.randint(1, 2)):
            said = truth[i] if rng.random() < 0.9 else {rng.choice(sorted(WORDS))}
            labels += [(i, s, f"r{rater}") for s in said] or [(i, None, f"r{rater}")]
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(700, 3)
    labels += labels[:20]
    args = (spark.createDataFrame(docs + docs[:10], DOCS).select("*", F.lit(1).alias("subject"), F.lit("t").alias("toks")), "doc_id", "text", spark.createDataFrame(labels, LABELS), spark.createDataFrame(AREAS, AREA))
    got: dict[int, set] = {}
    for r in S.subjects_of(*args, leaves=24).collect():
        assert 0.2 <= r["share"] <= 1
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in truth if i % 5]
    hit = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert hit / sum(len(truth[i]) for i in held) > 0.95 and hit / sum(len(got.get(i, ())) for i in held) > 0.95


def test_small_subject_keeps_its_leaf(spark):
    """A subject of less than 1 / 5,000 of all terms is found, however much else there is."""
    rng = random.Random(4)
    docs = [(i, ". ".join(" ".join(rng.choices(WORDS[s], k=10)) for _ in range(70)) + ".") for i, s in enumerate(sorted(WORDS) * 125)]
    small = range(1000, 1012)
    docs += [(i, " ".join(rng.choices([f"che{x}" for x in "abcdef"], k=5)) + ".") for i in small]
    terms = sum(len(t.split()) for _, t in docs)
    assert sum(len(t.split()) for i, t in docs if i in small) < 2e-4 * terms
    labels = [(i, s, "r") for i, s in enumerate(sorted(WORDS) * 5)] + [(i, "chess", "r") for i in small if i % 2]
    areas = [*AREAS, ("chess", "Chess", "all about it")]
    got = S.subjects_of(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(labels, LABELS), spark.createDataFrame(areas, AREA), leaves=24).collect()
    assert {r["doc_id"] for r in got if r["subject"] == "chess"} == set(small)
    assert all(r["subject"] == sorted(WORDS)[r["doc_id"] % 4] for r in got if r["doc_id"] < 1000)


@pytest.mark.parametrize("docs", [[], [(1, None), (2, ""), (3, " \n"), (None, "x")], [(1, "one two three")], [(1, "word " * 40_000), (2, "word " * 40_000)]])
def test_small_tables(spark, docs):
    for labels in ([], [(1, "law", None), (None, "law", "r"), (2, None, "r"), (3, "unknown", "r")]):
        df = S.subjects_of(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(labels, LABELS), spark.createDataFrame(AREAS, AREA))
        assert df.columns == ["doc_id", "subject", "share"]
        assert {r["doc_id"] for r in df.collect()} <= {1, 2}


def test_terms():
    assert S.terms_of("A b. C").tolist() == [*S.terms_of("a b")[:2].tolist(), -1, S.terms_of("c")[0], -1]
    assert len(S.terms_of("你好吗。")) == 4 and S.terms_of("").tolist() == [-1] and S.terms_of("3.5").tolist() == [-1]


def test_tokens_equal_their_pattern():
    """Tokens without a pattern's search at each place: the same as by the pattern, for every kind of character."""
    import re

    rng = random.Random(6)
    pattern = re.compile(r"\w+|[!?。！？\n]|\.(?!\d)")
    some = "aZ_09 .!?\n\t。！？,;-'\"éßİΣ你好٣²½\u0301\u2028\x1c😀"
    codes = [*range(0xD800), *range(0xE000, 0x20000)]
    for i in range(3000):
        text = "".join(rng.choice(some[: 20 + i % 40]) if i % 3 else chr(rng.choice(codes[: 1 << 8 + i % 10])) for _ in range(rng.randrange(40)))
        assert S._tokens(text) == [w if w not in S._ENDS else "!" for w in pattern.findall(text.lower())]


def test_projection_equals_its_sum():
    rng = np.random.default_rng(2)
    d, t, n = np.repeat([0, 2, 3], [5, 1, 30]), rng.integers(0, S.TERMS, 36), rng.integers(1, 9, 36)
    idf = rng.random(S.TERMS).astype(np.float32) * (rng.random(S.TERMS) < 0.8)
    idf[t[5]] = 0
    want = np.zeros((5, S.DIM))
    for i in range(36):
        want[d[i]] += (1 + np.log(n[i])) * idf[t[i]] * S._signs()[t[i]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(S._project(d, t, n, 5, idf), np.divide(want, norm, out=want, where=norm > 0), atol=1e-5) and not want[[1, 2, 4]].any()


def test_tree_splits_clusters(spark):
    rng = np.random.default_rng(1)
    centres = np.linalg.qr(rng.normal(size=(S.DIM, 4)))[0].T
    x = (np.repeat(centres, 50, axis=0) + rng.normal(scale=0.05, size=(200, S.DIM))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(v.tobytes(),) for v in x], "vec binary")
    tree = S.bisect(df, 4)
    assert all(len(set(tree.route(x[i * 50 : i * 50 + 50]))) == 1 for i in range(4)) and len(set(tree.route(x))) == 4


def test_sums_have_bounded_groups(spark):
    """At 10,000 tasks no group holds more than FAN_IN partial sums, where one group would hold all."""
    import pandas as pd

    def total(pdf):
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "n": [pdf["n"].sum()], "most": [max(len(pdf), pdf["most"].max())]})

    partials = spark.range(10_000).selectExpr("cast(id % 2 as int) as row", "id as n", "0L as most", "cast(id as int) as part")
    got = {r["row"]: (r["n"], r["most"]) for r in S._summed(partials, 10_000, "row", total, "row int, n bigint, most bigint").collect()}
    assert {k: n for k, (n, _) in got.items()} == {0: sum(range(0, 10_000, 2)), 1: sum(range(1, 10_000, 2))}
    assert max(most for _, most in got.values()) <= S.FAN_IN
