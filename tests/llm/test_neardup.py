"""Near-duplicates against brute force over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import neardup
from weftline.llm.words import words_of

SCHEMA = "message_id bigint, content string"


def brute(rows, k, t, least):
    sets = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        w = words_of(text)
        if len(w) >= max(k, least):
            sets[i] = frozenset(zip(*(w[j:] for j in range(k))))
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def found(df, k, t, least=0, **more):
    return {tuple(r) for r in neardup.expand_pairs(*neardup.near_duplicates(df, "message_id", "content", k, t, least, **more)).collect()}


def corpus(seed, n=120, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
                w = w or ["w0"]
        else:
            w = rng.choices(words, k=rng.randint(1, 40))
        rows.append((i * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, k, t", [(1, 3, 0.5), (2, 1, 0.8), (3, 2, 0.3), (4, 5, 0.8), (5, 3, 1.0)])
def test_all_pairs(spark, seed, k, t):
    rows = corpus(seed)
    assert found(spark.createDataFrame(rows, SCHEMA), k, t) == brute(rows, k, t, 0)


@pytest.mark.parametrize("block", [2, 7, 40])
def test_hot_cells(spark, block):
    """Cells cut into blocks give the same links."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(30)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(30)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert found(spark.createDataFrame(rows, SCHEMA), 1, 0.6, block=block) == brute(rows, 1, 0.6, 0)


@pytest.mark.parametrize("fanout", [2, 8])
def test_trees(monkeypatch, fanout):
    """The traversal keeps every pair of a cell that the bounds of its rows allow, and prunes inner nodes."""
    monkeypatch.setattr(neardup, "FANOUT", fanout)
    rng, t, rows = random.Random(fanout), 0.5, []
    for run in range(60):
        for i in range(rng.randint(1, 12)):
            held = rng.sample(range(256), rng.randint(4, 30))
            bits = [0] * neardup.WORDS
            for h in held:
                bits[h // 64 % neardup.WORDS] |= 1 << (h % 64)
            ones = sum(b.bit_count() for b in bits)
            rows.append((run, len(held), len(held) - rng.randint(0, 3), len(held) - ones, bits))
    rows.sort(key=lambda r: r[:2])
    cols = {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("run", "n", "rem", "surplus"))}
    zero = np.zeros(len(rows), np.int64)
    pruned: dict[str, int] = {}
    x, y = neardup.tree_pairs(cols | {"salts": zero, "side": zero, "bits": np.array([r[4] for r in rows], np.uint64)}, t, pruned)

    def allowed(a, b):
        least = math.ceil(t / (1 + t) * (a[1] + b[1]) - 1e-9)
        shared = sum((p & q).bit_count() for p, q in zip(a[4], b[4]))
        return a[0] == b[0] and min(a[1], b[1]) >= t * max(a[1], b[1]) - 1e-9 and min(shared + min(a[3], b[3]), a[2], b[2]) >= least

    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if allowed(rows[i], rows[j])}
    assert pruned["nodes by routing"] > 0 and pruned["rows tested"] < len(rows) ** 2 / 8


def test_without_broadcasts(monkeypatch, spark):
    monkeypatch.setattr(neardup, "SMALL", -1)
    monkeypatch.setattr(neardup, "SMALL_RUNS", -1)
    rows = corpus(7) + [(2000 + i, text) for i, (_, text) in enumerate(corpus(7))]
    assert found(spark.createDataFrame(rows, SCHEMA), 2, 0.5) == brute(rows, 2, 0.5, 0)


def test_edge_cases(spark):
    long = " ".join(f"v{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e"), (2, "A, b; c d e!"), (2, "A, b; c d e!"), (3, None), (None, "a b c d e"), (4, ""), (5, " \n"), (6, long), (7, long + " more"), (8, "a b"), (9, "a b c d e")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("id"), F.lit("x").alias("runs"), F.lit(2).alias("key"), F.lit(3).alias("cid"))
    assert found(df, 3, 0.5) == {(1, 2), (1, 9), (2, 9), (6, 7)}
    links, members = neardup.near_duplicates(df, "message_id", "content", 3, 0.5)
    rows = {r["id"]: (r["cid"], r["copies"], r["linked_classes"]) for r in neardup.link_counts(links, members).collect()}
    assert rows == {1: (1, 3, 0), 2: (1, 3, 0), 9: (1, 3, 0), 6: (6, 1, 1), 7: (7, 1, 1)}


def test_minimum_of_words(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c d e"), (4, "a b c d e")], SCHEMA)
    assert found(df, 3, 0.5, 5) == {(3, 4)}


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA), 3, 0.5) == set()
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([], SCHEMA), "message_id", "content", threshold=0)


def test_copies_are_not_expanded(spark):
    """A third of all rows is one text: classes stay one row an id."""
    rows = [(i, "one two three four five six") for i in range(300)] + [(1000 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(600)]
    links, members = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), "message_id", "content", 3, 0.5)
    assert links.count() == 0 and members.count() == 900 and members.select("cid").distinct().count() == 601


def test_counts_of_very_long_texts():
    """Sizes stay exact in their one column, bounds that do not fit bound nothing."""
    n, rem, surplus = np.array([1, 5_000_000, 100_000_000]), np.array([1, 300_000, 262_142]), np.array([0, 4_999_872, 7])
    a, b, c = neardup._parted(neardup._joined(n, rem, surplus))
    assert a.tolist() == n.tolist() and (b >= rem).all() and (c >= surplus).all() and b[2] == 262_142 and c[0] == 0 and b[1] > 10**9


def test_long_texts_with_few_changes(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = list(words)
    for i in range(0, 300_000, 50):
        other[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:140_000])), (4, " ".join(words[:160_000]))]
    assert found(spark.createDataFrame(rows, SCHEMA), 3, 0.5) == {(1, 2), (1, 4), (3, 4)}
