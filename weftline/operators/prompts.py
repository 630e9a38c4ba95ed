"""Prompts of evaluation tasks, Column to Column.  The texts are fixed values; ``newline`` is what stands between lines."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.numbers import uniform
from weftline.functions.text import strip

LETTERS = "ABCD"
ASK_FOUR = 'Your response should end with "The best answer is [the_answer_letter]" where the_answer_letter is one of A, B, C, or D.'
ASK_TWO = 'Your response should end with "The best answer is [the_answer_letter]" where the_answer_letter is A or B.'
ASK_PASSAGE = 'Your response should end with "The best answer is [the_answer_letter]" where the [the_answer_letter] is one of A, B, C or D.'
CODE_TASK = "You are an expert Python programmer, and here is your task: "


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _choice(choices: Column, i: int) -> Column:
    return F.try_element_at(choices, F.lit(i + 1))


def four_choices(question: Column, choices: Column) -> Column:
    lines = [p for i, letter in enumerate(LETTERS) for p in (f"\n{letter}. ", _choice(choices, i))]
    return _text(strip(question), *lines, " (think a bit)")


def best_of_four(question: Column, choices: Column, newline: str = "\n") -> Column:
    """Three or four candidates."""
    fourth = F.when(F.size(choices) > 3, _text(f"{newline}D. ", _choice(choices, 3))).otherwise("")
    return _text(f"Given the following question and four candidate answers (A, B, C and D), choose the best answer.{newline}Question: ", strip(question), f"{newline}A. ", _choice(choices, 0), f"{newline}B. ", _choice(choices, 1), f"{newline}C. ", _choice(choices, 2), fourth, newline + ASK_FOUR)


def best_of_two(goal: Column, first: Column, second: Column, newline: str = "\n") -> Column:
    return _text(f"Given a goal and two candidate solutions (A and B), choose the more sensible solution.{newline}Goal: ", strip(goal), f"{newline}A. ", first, f"{newline}B. ", second, newline + ASK_TWO)


def answer_key(key: Column) -> Column:
    """Digits 1 to 4 as letters, letters as they are."""
    return F.translate(key, "1234", LETTERS)


def bracketed_choices(question: Column, choices: Column) -> Column:
    lines = [p for i, letter in enumerate(LETTERS) for p in (f"\n({letter}) ", _choice(choices, i))]
    return _text("Question: ", question, "\nChoices:", *lines, " (think a bit)")


def math_problem(problem: Column) -> Column:
    return _text("Problem:\n", problem, " (think a bit)")


def code_task(text: Column, tests: Column) -> Column:
    return _text(CODE_TASK, text, " Your code should pass these tests:\n\n", _choice(tests, 0), "\n", _choice(tests, 1), "\n", _choice(tests, 2), "\n[BEGIN]\n")


def code_tests(tests: Column) -> Column:
    return _text(_choice(tests, 0), "\n", _choice(tests, 1), "\n", _choice(tests, 2))


def solved_task(code: Column) -> Column:
    return _text(code, "\n[DONE]")


def completion_tests(test: Column, entry_point: Column) -> Column:
    return _text(test, "\ncheck(", entry_point, ")")


def passage_prompt(article: Column, problems: Column) -> Column:
    """Prompt of the last problem of a passage; problems are a literal of a list of mappings."""

    def render(articles: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for a, p in zip(articles, lists):
            last = ast.literal_eval(p)[-1]
            options = "".join(f"{letter}. {o}\n" for letter, o in zip(LETTERS, last["options"]))
            out.append(f"Given the following passage, question, and four candidate answers (A, B, C and D), choose the best answer.\nPassage: {a.strip()}\n\nQuestion: {last['question'].strip()}\n{options}{ASK_PASSAGE}")
        return pd.Series(out)

    return F.pandas_udf(render, "string")(article, problems)


def tidy_choice(text: Column) -> Column:
    """A choice without outer blanks, title marks and double blanks; null is one blank."""
    tidy = F.replace(F.replace(strip(text), F.lit(" [title]"), F.lit(". ")), F.lit("  "), F.lit(" "))
    return F.when(text.isNull(), " ").otherwise(tidy)


def shuffled(choices: Column, item: Column, seed: int = 0) -> Column:
    """Choices in an order that depends on item and seed only."""
    keyed = F.transform(choices, lambda c, i: F.struct(uniform(item, seed, i, 21).alias("u"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def choice_letter(choices: Column, correct: Column) -> Column:
    """Bracketed letter of the first choice equal to the correct one."""
    at = F.array_position(choices, correct)
    return F.when(at > 0, F.concat(F.lit("("), F.substr(F.lit(LETTERS), at.cast("int"), F.lit(1)), F.lit(")")))


def shuffled_unless_both(choices: Column, item: Column, seed: int = 0) -> Column:
    """Shuffled, but left alone when a choice speaks of both."""
    return F.when(F.exists(choices, lambda c: F.coalesce(F.contains(c, F.lit("Both")), F.lit(False))), choices).otherwise(shuffled(choices, item, seed))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with marks in angle brackets replaced; the subject's underscores become blanks."""
    out = F.lit(template)
    for mark, value in values.items():
        text = F.replace(value, F.lit("_"), F.lit(" ")) if mark == "SUBJECT" else value
        out = F.replace(out, F.lit(f"<{mark}>"), F.coalesce(text, F.lit("")))
    return out
