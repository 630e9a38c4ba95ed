"""Broken pairs: votes, label model, cutoffs on planted defects."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from planted import FRESH, SOUND, planted  # noqa: E402

from weftline.llm import pairs as P

EN, DE = "Which metal melts first when the furnace is heated slowly by hand?", "Warum schmelzen die Metalle in dem Ofen nicht bei der Hitze?"
GOOD = "The tin melts first because it has the lowest melting point of the metals in the furnace."


def flags(prompt, content, finish="stop"):
    """Defects by the model as it begins, fitted on this pair alone."""
    codes = {d: P._code(v) for d, v in P.votes(prompt, content, finish).items()}
    return {d for d, f in P.FUNCTIONS.items() if P.fit_label_model({codes[d]: 1}, f)[codes[d]] > P.CUTOFFS[d]}


@pytest.mark.parametrize(
    "prompt, content, want",
    [
        (EN, GOOD, set()), (EN, "422", set()), (EN, "(C)", set()), (EN, "B", set()), (EN, None, {"empty"}), (EN, " \n", {"empty"}), (EN, "...", {"empty"}), (EN, "<think>all of it</think>", {"empty"}), (EN, "​", {"empty"}),
        (EN, GOOD + " The tin then", {"truncated"}), (EN, GOOD + "\n```python\ndef f(x):\n    return", {"truncated"}), (EN, GOOD + "\n```python\nx = 1\n```", set()), (EN, GOOD + " \U0001f642", set()), (EN, "1. The tin melts first.\n2. The lead is second.\n3.", {"truncated"}),
        (EN, "I'm sorry, but I can't help with that. Please try another topic.", {"refusal"}), (EN, "I can't stress this enough: the tin melts first in the furnace.", set()), (EN, "I'm sorry to hear that. The tin melts first.", set()), (DE, "Es tut mir leid, aber darauf darf ich nicht antworten.", {"refusal"}),
        (EN, EN, {"copied_question"}), (EN, "Of course. " + EN, {"copied_question"}), (EN, f"> {EN}\n\n{GOOD}", set()), (EN, EN.upper(), {"copied_question"}),
        (EN, "Das Zinn schmilzt zuerst, weil es von den Metallen in dem Ofen die kleinste Hitze braucht.", {"other_language"}), (EN, "Gerne. " + GOOD, set()), ("Please translate into German: " + EN, DE, set()), (EN, GOOD + ' "Die Metalle schmelzen in dem Ofen."', set()),
        (EN, "Олово плавится первым в печи.", {"other_language"}), (None, GOOD, set()), (None, None, {"empty"}), ("", "", {"empty"}),
    ],
)
def test_votes(prompt, content, want):
    assert flags(prompt, content) == want


def test_votes_have_their_number():
    for args in ((None, None, None), (EN, GOOD, "length"), ("x" * 100_000, "y " * 100_000, None), (EN, "```", ""), ("你好", "好", "stop")):
        assert {d: len(v) for d, v in P.votes(*args).items()} == {d: len(f) for d, f in P.FUNCTIONS.items()}


def test_patterns_round_trip():
    for code in range(3**5):
        assert P._code(P._decode(code, 5)) == code


def test_label_model_finds_noisy_classes():
    """Functions of unlike accuracy on a known truth: held-out labels are recovered."""
    rng = random.Random(1)
    accuracy, rows = (0.95, 0.9, 0.8, 0.75), []
    for _ in range(20_000):
        y = rng.random() < 0.08
        rows.append((y, tuple((1 if y else -1) * (1 if rng.random() < a else -1) if rng.random() < 0.9 else 0 for a in accuracy)))
    post = P.fit_label_model(Counter(P._code(v) for _, v in rows), 4)
    right = sum((post[P._code(v)] > 0.5) == y for y, v in rows) / len(rows)
    best_single = sum((v[0] > 0) == y for y, v in rows) / len(rows)
    assert right > 0.97 and right > best_single
    assert P.fit_label_model({}, 4) == {}


@pytest.fixture(scope="module")
def background(spark):
    """Votes of the pairs of the data, on which the model is fitted; they bear no labels."""
    from weftline.llm.queries import _pairs

    return [P.votes(r["prompt"], r["content"], r["finish_reason"]) for r in _pairs(spark, "/root/testdata/sf0.1").collect()]


def scored(background, rows):
    """``defect -> [(posterior, planted)]`` of planted pairs among the pairs of the data."""
    own, out = [P.votes(prompt, answer, "stop") for prompt, answer, _, _ in rows], {}
    for d, functions in P.FUNCTIONS.items():
        post = P.fit_label_model(Counter(P._code(v[d]) for v in background + own), functions)
        out[d] = [(post[P._code(v[d])], d in want) for v, (_, _, want, _) in zip(own, rows)]
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_cutoffs_on_planted_defects(background, seed):
    """The cutoffs were chosen on seed 1; two of the languages have no lists of words."""
    rows = planted(seed)
    got = scored(background, rows)
    for d, pairs in got.items():
        hits = sum(p > P.CUTOFFS[d] and y for p, y in pairs)
        assert hits / sum(y for _, y in pairs) >= 0.9 and hits / max(1, sum(p > P.CUTOFFS[d] for p, _ in pairs)) >= 0.9, d
    for lang in ("pt", "it", "fi", "hu"):
        pairs = [got["other_language"][i][0] for i, r in enumerate(rows) if r[3] == lang]
        assert sum(p > P.CUTOFFS["other_language"] for p in pairs) >= 5


def test_fresh_refusals(background):
    """Wordings that no pattern was written for, each after a prompt of its language where there is one."""
    prompts = {"en": SOUND[0][0], "de": SOUND[12][0], "fr": SOUND[15][0], "es": SOUND[18][0], "ru": SOUND[21][0], "zh": "蜜蜂怎样找到回家的路？"}
    pairs = scored(background, [(prompts[lang], text, {"refusal"}, "fresh") for lang, text in FRESH])["refusal"]
    assert sum(p > P.CUTOFFS["refusal"] for p, _ in pairs) / len(pairs) >= 0.85


def test_no_function_decides_alone(background):
    for d, functions in P.FUNCTIONS.items():
        post = P.fit_label_model(Counter(P._code(v[d]) for v in background), functions)
        flagged = {i for i, v in enumerate(background) if post[P._code(v[d])] > P.CUTOFFS[d]}
        alone = [f for k, f in enumerate(functions) if {i for i, v in enumerate(background) if v[d][k] == 1} == flagged]
        assert flagged and not alone, (d, alone)


def test_best_cutoff():
    assert P.best_cutoff([(0.9, True), (0.8, True), (0.2, False)]) == pytest.approx(0.5)
    assert P.best_cutoff([(0.9, False), (0.4, True), (0.1, False)]) == pytest.approx(0.25)
    assert P.best_cutoff([]) == 0.5


def test_tables(spark):
    messages = spark.createDataFrame([(1, 1, 0, "user", "old"), (2, 1, 2, "user", EN), (2, 1, 2, "user", EN), (3, None, 0, "user", "x"), (4, 2, 0, "system", "s")], "message_id bigint, request_id bigint, turn int, role string, content string")
    kind = "completion_id bigint, request_id bigint, choices array<struct<index:int,message:struct<role:string,content:string,reasoning_content:string>,finish_reason:string>>"
    made = [(9, 1, [(0, ("assistant", GOOD, None), "stop"), (1, ("assistant", None, "why"), None)]), (9, 1, [(0, ("assistant", GOOD, None), "stop"), (1, ("assistant", None, "why"), None)]), (8, None, [(0, ("assistant", "", None), None)]), (7, 5, [(0, ("assistant", "", None), None)]), (6, 2, [(0, None, None)]), (5, 2, None)]
    requests = spark.createDataFrame([(1,), (1,), (2,), (None,)], "request_id bigint")
    pairs = P.answer_pairs(messages, spark.createDataFrame(made, kind), requests)
    assert {(r["completion_id"], r["choice_index"], r["prompt"]) for r in pairs.collect()} == {(9, 0, EN), (9, 1, EN), (6, 0, None)}
    assert {tuple(r) for r in P.broken_pairs(pairs).collect()} == {(9, 1, "empty"), (6, 0, "empty")}
    assert P.broken_pairs(pairs.where("false")).count() == 0
