"""Answer extraction and scoring, Column to Column, and the registry of scoring functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.expressions import same_value
from weftline.functions.text import strip

#: Letter after an announcement, else a letter standing alone (fixed pattern; ``{}`` takes the letters).
CASCADE = r"best\s+answer\s+is[\s:]*\(?([A-D])|(?:^|[^A-Za-z])([A-D])(?:\)|\.|\s|$)"
#: Characters dropped when punctuation is ignored.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Rewriting of final answers: fixed ordered values, as published in appendix D of Lewkowycz et al. (2022).
REPLACED = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    (r"\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]
#: Unwrapping patterns and what stays of them, in order.
UNWRAPPED = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
]
INVALID = "[invalidanswer]"
Score = Callable[[Column, Column], dict[str, Column]]
SCORES: dict[str, Score] = {}


def score(name: str) -> Callable[[Score], Score]:
    """Register a scoring function ``(prediction, gold) -> {metric: column}`` under a name."""

    def add(f: Score) -> Score:
        SCORES[name] = f
        return f

    return add


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _last(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))


def plain_number(text: Column) -> Column:
    """Without commas, dollar signs, final stops and outer blanks."""
    return strip(F.regexp_replace(F.translate(text, ",$", ""), r"\.+\z", ""))


def number_gold(answer: Column) -> Column:
    """What follows the last mark of four number signs."""
    return plain_number(F.element_at(F.split(answer, "####"), -1))


@score("number")
def number_scores(prediction: Column, gold: Column) -> dict[str, Column]:
    """Announced number, last number, any number; two empty sides are equal."""
    text = F.coalesce(prediction, F.lit(""))
    announced = plain_number(F.regexp_extract(text, r"The answer is (-?[\d.,]+)", 1))
    numbers = F.regexp_extract_all(F.translate(text, ",$", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return {"exact": _flag(announced == gold), "flexible": _flag(plain_number(_last(numbers)) == gold), "loose": _flag(F.array_contains(F.transform(numbers, plain_number), gold))}


def letter_gold(index: Column) -> Column:
    """``A`` to ``D`` for 0 to 3, else empty."""
    return F.when(index.between(0, 3), F.substring(F.lit("ABCD"), index.cast("int") + 1, F.lit(1))).otherwise("")


@score("letter")
def letter_scores(prediction: Column, gold: Column) -> dict[str, Column]:
    """Final letter, last letter standing alone, any letter standing alone."""
    text = F.coalesce(prediction, F.lit(""))
    end = F.right(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f.):\]]+\z", ""), F.lit(1))
    final = F.when(end.isin("A", "B", "C", "D"), end).otherwise("")
    alone = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-D])\b"), F.lit(1))
    return {"exact": _flag(final == gold), "flexible": _flag(_last(alone) == gold), "loose": _flag((gold != "") & F.array_contains(alone, gold))}


def cascade_letter(prediction: Column) -> Column:
    """Last match of the cascade, its first group that is not empty; null without a match."""
    a, b = (F.regexp_extract_all(prediction, F.lit(CASCADE), F.lit(g)) for g in (1, 2))
    return F.try_element_at(F.zip_with(a, b, lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)), F.lit(-1))


def comparable(text: Column) -> Column:
    """Lower case without punctuation."""
    return F.translate(F.lower(text), PUNCTUATION, "")


@score("cascade")
def cascade_scores(prediction: Column, gold: Column) -> dict[str, Column]:
    return {"exact": _flag(F.coalesce(comparable(cascade_letter(prediction)) == comparable(gold), F.lit(False)))}


def strict_choice(prediction: Column) -> Column:
    """Rest of the line after the announcement without its last character."""
    return F.regexp_extract(prediction, r"(?<=The answer is )(.*)(?=.)", 1)


def bracketed_choice(prediction: Column) -> Column:
    """Last bracketed capital, empty without one."""
    return _last(F.regexp_extract_all(prediction, F.lit(r"(\([A-Z]\))"), F.lit(1)))


def bracketed_or_named_choice(prediction: Column, choices: Column) -> Column:
    """Last bracketed capital, else the letter of the choice whose text occurs last, whatever its case; empty without either."""
    backwards = F.reverse(F.lower(F.coalesce(prediction, F.lit(""))))
    behind = F.transform(choices, lambda c, i: F.struct(F.position(F.reverse(F.lower(c)), backwards).alias("at"), i.alias("i"), F.char_length(c).alias("n")))
    last = F.array_min(F.filter(behind, lambda s: (s["at"] > 0) & (s["n"] > 0)))
    letter = F.concat(F.lit("("), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), last["i"] + 1, F.lit(1)), F.lit(")"))
    return F.coalesce(F.nullif(bracketed_choice(prediction), F.lit("")), letter, F.lit(""))


def stated_final_answer(text: Column) -> Column:
    """The answer of the closing sentence; a cut one counts as whole."""
    found = F.concat(text, F.lit("I hope it is correct."))
    pattern = r"Final Answer: The final answer is(.*?). I hope it is correct."
    return F.when(found.rlike(pattern), strip(F.regexp_extract(found, pattern, 1))).otherwise(INVALID)


def final_answer(answer: Column) -> Column:
    """A final answer in one notation."""
    out = F.element_at(F.split(answer, "="), -1)
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    for old in REMOVED:
        out = F.replace(out, F.lit(old), F.lit(""))
    for pattern, keep in UNWRAPPED:
        out = F.regexp_replace(out, pattern, keep)
    out = F.replace(out, F.lit("$"), F.lit(""))
    bare = F.replace(out, F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^\d+\z"), bare).otherwise(out)


def boxed_span(text: str | None) -> str | None:
    """Last boxed expression with balanced braces; the form with a blank goes up to the next dollar sign."""
    if text is None:
        return None
    spaced = "\\boxed "
    if spaced in text:
        return spaced + text.rsplit(spaced, 1)[1].partition("$")[0]
    start = text.rfind("\\boxed")
    if start < 0:
        start = text.rfind("\\fbox")
    if start < 0:
        return None
    depth = 0
    for m in re.finditer(r"[{}]", text[start:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return text[start : start + m.end()]
    return None


def last_boxed(text: Column) -> Column:
    def spans(s: pd.Series) -> pd.Series:
        return s.map(boxed_span)

    return F.pandas_udf(spans, "string")(text)


def unboxed(boxed: Column) -> Column:
    """Inside of a boxed expression; another text is an error, null stays null."""
    spaced = F.startswith(boxed, F.lit("\\boxed "))
    braced = F.startswith(boxed, F.lit("\\boxed{")) & F.endswith(boxed, F.lit("}"))
    inside = F.substr(boxed, F.lit(8), F.greatest(F.char_length(boxed) - 8, F.lit(0)))
    return F.when(boxed.isNull(), F.lit(None).cast("string")).when(spaced, F.substr(boxed, F.lit(8))).when(braced, inside).otherwise(F.raise_error(F.lit("not boxed")).cast("string"))


def equivalent(a: Column, b: Column) -> Column:
    """Formulas equal as written or in value; a null is equal to nothing."""

    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_value(p, q) for p, q in zip(x, y)], dtype=bool)

    return F.pandas_udf(compare, "boolean")(a, b)


def verified(prediction: Column, gold: Column) -> Column:
    """Whether the answer that a text comes to, its last boxed expression or else its last number, has the value of ``gold``."""
    boxed = last_boxed(prediction)
    spaced = F.startswith(boxed, F.lit("\\boxed "))
    inside = F.when(spaced, F.substr(boxed, F.lit(8))).otherwise(F.regexp_extract(boxed, r"(?s)^\\f?box(?:ed)?\{(.*)\}\z", 1))
    number = plain_number(_last(F.regexp_extract_all(prediction, F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))))
    return equivalent(F.coalesce(F.nullif(inside, F.lit("")), number), gold)


def code_block(text: Column) -> Column:
    """First fenced block; text without one as it is."""
    pattern = r"(?s)```(?:python)?\n(.*?)```"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def likeliest_choice(scores: Column) -> Column:
    """Index of the first largest of the scores."""
    return F.array_position(scores, F.array_max(scores)) - 1
