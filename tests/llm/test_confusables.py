"""Look-alike texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.llm import confusables as C

SAME = [
    ("The note", "Ｔｈｅ　ｎｏｔｅ"), ("café", "café"), ("word", "w​o⁠r﻿d"), ("a b", "a b"), ("a b", "a b"), ("scope", "ѕсоре"), ("Kappa", "Κappa"),
    ("hello", "һeӏӏo"), ("sṩ", "sṩ"), ("bold", "\U0001d41b\U0001d428\U0001d425\U0001d41d"), ("fine", "ﬁne"), ("a\r\nb", "a\nb"), ("가", "가"), ("co-op", "co‐op"), ("й", "й"), ("5", "５"),
]
DIFFERENT = [("The", "the"), ("e", "é"), ("2", "²"), ("2", "②"), ("a.", "a!"), ("a b", "a\nb"), ("a", "aa"), ("е", "ё"), ("u", "ü"), ("a,b", "a;b"), ("a b", "a  b"), ("1/2", "½"), ("0", "O"), ("l", "1"), ("", " ")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert C.skeleton(a) == C.skeleton(b) and C.consistent(a) == C.consistent(b)
    assert C.skeleton(C.skeleton(a)) == C.skeleton(a)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert C.skeleton(a) != C.skeleton(b)


def test_pairs(spark):
    rows = [(1, "same text"), (2, "sаme text"), (3, "same text"), (3, "same text"), (4, None), (None, "same text"), (5, ""), (6, "​"), (7, "Same text"), (8, "x" * 200_000), (9, "ｘ" + "x" * 199_999)]
    df = spark.createDataFrame(rows, "message_id bigint, content string").select("*", F.lit(1).alias("id"), F.lit("f").alias("form"), F.lit(0).alias("stored"))
    assert {tuple(r) for r in C.look_alike_pairs(df, "message_id", "content").collect()} == {(1, 2), (2, 3), (5, 6), (8, 9)}
    forms = {(r["id"], r["form"]) for r in C.canonical_forms(df, "message_id", "content").where("id < 8").collect()}
    assert forms == {(1, "same text"), (2, "same text"), (3, "same text"), (4, None), (5, ""), (6, ""), (7, "Same text")}


def test_hot_original(spark):
    """Many copies of one original meet only ids of the other."""
    rows = [(i, "thanks a lot") for i in range(2000)] + [(5000, "thankѕ a lot")]
    assert C.look_alike_pairs(spark.createDataFrame(rows, "message_id bigint, content string"), "message_id", "content").count() == 2000


def test_empty(spark):
    df = spark.createDataFrame([], "message_id bigint, content string")
    assert C.look_alike_pairs(df, "message_id", "content").count() == 0 and C.canonical_forms(df, "message_id", "content").count() == 0


def test_classes_say_what_the_pairs_say(spark):
    rows = [(1, "same text"), (2, "sаme text"), (3, "same text"), (3, "same text"), (4, None), (None, "same text"), (5, ""), (6, "​"), (7, "Same text"), (10, "ｓame text")]
    df = spark.createDataFrame(rows, "message_id bigint, content string")
    got = [tuple(r) for r in C.look_alike_classes(df, "message_id", "content").collect()]
    assert sorted(got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (5, 5, 5), (6, 5, 6), (10, 1, 10)]
    pairs = {(a, b) for a, x, p in got for b, y, q in got if a < b and x == y and p != q}
    assert pairs == {tuple(r) for r in C.look_alike_pairs(df, "message_id", "content").collect()}
    assert C.look_alike_classes(df.where("false"), "message_id", "content").count() == 0


def test_every_look_alike_is_one_letter():
    """Prototypes are final, one character each, and no letter of two prototypes."""
    for a, b in C.LOOK_ALIKES.items():
        assert len(a) == len(b) == 1 and C.skeleton(a) == b == C.skeleton(b)
    assert C.skeleton("ꓡꓲꓢꓴ ᏔᎬᎢ ⲤⲞⲢⲦ") != "" and C.skeleton("ꓡꓲꓢꓴ") == "LISU" and C.skeleton("ⲤⲞⲢ") == "COP" and C.skeleton("Ӏӏ") == "ll"
