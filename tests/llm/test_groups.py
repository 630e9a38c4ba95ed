"""Pairs within groups against all pairs."""

from __future__ import annotations

import itertools

import pytest

from weftline.llm import groups


@pytest.mark.parametrize("meeting", [1, 3, 1024])
def test_pairs_within(monkeypatch, spark, meeting):
    monkeypatch.setattr(groups, "MEETING", meeting)
    sizes = {1: 1, 2: 2, 3: 17, None: 4}
    rows = [(k, 100 * (k or 9) + i, n) for k, n in sizes.items() for i in range(n)]
    got = [tuple(r) for r in groups.pairs_within(spark.createDataFrame(rows, "k int, item int, n int"), "k", "item", "n").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, 100 * k + a, 100 * k + b) for k, n in sizes.items() if k for a, b in itertools.combinations(range(n), 2)}
    assert groups.pairs_within(spark.createDataFrame([], "k int, item int, n int"), "k", "item", "n").count() == 0
