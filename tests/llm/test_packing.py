"""Packing: nothing lost, nothing cut that fits, no overlap, little space left."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import packing as P


def spans_of(counts, capacity):
    slots, n = P.plan(counts, capacity)
    rows = sorted(map(tuple, slots.tolist()))
    spans, placed = defaultdict(list), Counter()
    for row, after in zip(rows, [*rows[1:], None]):
        size, rank, each, first, start = row
        end = after[1] if after and after[0] == size else counts[size]
        for k in range(rank, end):
            spans[first + (k - rank) // each].append((start + (k - rank) % each * size, size))
            placed[size] += 1
    return spans, placed, n


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 120).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 60), max_size=25))))
def test_plan(case):
    capacity, counts = case
    spans, placed, n = spans_of(counts, capacity)
    assert placed == Counter(counts) and set(spans) == set(range(n))
    for items in spans.values():
        items.sort()
        assert all(a + s <= b for (a, s), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
        assert sum(3 * s > capacity for _, s in items) <= 2
    # two containers at most half full would have been one for small items
    least = -(-sum(s * c for s, c in counts.items()) // capacity)
    assert n <= max(least * 1.5 + 1, sum(c for s, c in counts.items() if 2 * s > capacity) + least)


def test_run_lengths_do_not_depend_on_the_number_of_items():
    slots, n = P.plan({s: 10**9 for s in range(1, 257)}, 256)
    assert len(slots) < 5000 and n >= 10**9 * sum(range(1, 257)) // 256


SPECS = "spec_id int, ctx_len int, block_size int, capacity int"


def test_pack(spark):
    sizes = [(1, 10), (2, 25), (3, 7), (3, 7), (4, 0), (5, None), (None, 3), (6, 1), (7, 10)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").select("*", F.lit(1).alias("spec_id"), F.lit(2).alias("capacity"), F.lit(3).alias("size"))
    specs = spark.createDataFrame([(1, 1, 1, 10), (2, 1, 1, 100), (2, 1, 1, 100), (3, 1, 1, 0), (None, 1, 1, 5)], SPECS)
    rows = P.pack(df, specs).collect()
    for spec, capacity in ((1, 10), (2, 100)):
        mine = [r for r in rows if r["spec_id"] == spec]
        by_doc = defaultdict(list)
        for r in mine:
            by_doc[r["doc_id"]].append((r["piece"], r["doc_start"], r["n_tokens"]))
        want = {1: 10, 2: 25, 3: 7, 4: 0, 6: 1, 7: 10}
        assert {d: sum(p[2] for p in v) for d, v in by_doc.items()} == want
        for d, v in by_doc.items():
            v.sort()
            assert len(v) == max(1, -(-want[d] // capacity)) and [p[1] for p in v] == [i * capacity for i in range(len(v))]
        load = Counter()
        for r in mine:
            if r["container_id"] is None:
                assert r["n_tokens"] == 0 and r["start"] is None
            else:
                load[r["container_id"]] += r["n_tokens"]
        assert max(load.values()) <= capacity
    assert {r["spec_id"] for r in rows} == {1, 2}
    report = {r["spec_id"]: r["containers"] for r in P.fill_report(P.pack(df, specs), specs).collect()}
    assert report == {1: 6, 2: 1}


def test_many_ties(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(3).alias("n_tokens"))
    rows = P.pack(df, spark.createDataFrame([(1, 1, 1, 10)], SPECS))
    assert rows.select("container_id").distinct().count() == 1667 and rows.count() == 5000


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert P.pack(empty, spark.createDataFrame([(1, 1, 1, 10)], SPECS)).count() == 0
    assert P.pack(spark.createDataFrame([(1, 1)], empty.schema), spark.createDataFrame([], SPECS)).count() == 0


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    del tiktoken
    text = "Some text, <|endoftext|> привет 你好"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "word " * 100_000), (None, "x")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df, "doc_id", "text").collect()}
    with open(P.TOKENIZER, "rb") as f:
        encoder = P._encoder(f.read(), P.PATTERN)
    assert encoder.decode(encoder.encode_ordinary(text)) == text
    assert got == {1: len(encoder.encode_ordinary(text)), 2: 0, 3: 0, 4: len(encoder.encode_ordinary("word " * 100_000))}


def test_invariants_find_what_is_broken(spark):
    kind = "spec_id int, container_id bigint, doc_id bigint, piece int, start bigint, doc_start bigint, n_tokens bigint"
    specs = spark.createDataFrame([(1, 10)], "spec_id int, capacity int")
    sizes = spark.createDataFrame([(1, 6), (2, 4), (3, 13), (4, 0)], "doc_id bigint, n_tokens bigint")
    sound = [(1, 0, 1, 0, 0, 0, 6), (1, 0, 2, 0, 6, 0, 4), (1, 1, 3, 0, 0, 0, 10), (1, 2, 3, 1, 0, 10, 3), (1, None, 4, 0, None, 0, 0)]
    check = lambda rows: tuple(P.invariants(spark.createDataFrame(rows, kind), sizes, specs).where("spec_id is not null").first())
    assert check(sound) == (1, 4, 0, 0, 0, 0)
    assert check([*sound[:1], (1, 0, 2, 0, 5, 0, 4), *sound[2:]]) == (1, 4, 0, 1, 0, 0)
    assert check([*sound[:1], (1, 0, 2, 0, 7, 0, 4), *sound[2:]]) == (1, 4, 1, 0, 0, 0)
    assert check([*sound[:1], (1, 0, 2, 0, 6, 0, 2), (1, 2, 2, 1, 3, 2, 2), *sound[2:]]) == (1, 4, 0, 0, 1, 1)
    assert check([*sound[:3], (1, 2, 3, 0, 0, 10, 3), *sound[4:]]) == (1, 4, 0, 0, 0, 1)
    assert check([*sound[:2], (1, 1, 3, 0, 0, 0, 9), *sound[3:]]) == (1, 4, 0, 0, 0, 1)
