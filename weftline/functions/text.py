"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode ``\s`` and the four separators that Python's ``str.strip`` takes as blanks too.
_BLANK = r"[\s\x1c-\x1f]"
_THINK = r"(?is)<think\s*>(.*?)</think\s*>"
_AFTER_THINK = r"(?is)^.*?<think\s*>.*?</think\s*>(.*)\z"


def strip(text: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def clean_text(text: Column) -> Column:
    """Line ends made one kind, runs of line ends collapsed, blanks at both ends dropped, in that order."""
    return strip(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{2,}", "\n"))


def has_think(text: Column) -> Column:
    return F.coalesce(text.rlike(_THINK), F.lit(False))


def reasoning_of(text: Column) -> Column:
    """Inside of the first think span; empty without one."""
    return F.coalesce(F.regexp_extract(text, _THINK, 1), F.lit(""))


def answer_of(text: Column) -> Column:
    """Text after the first think span; what stands before it is dropped.  All of the text without one."""
    return F.when(text.isNull(), "").when(has_think(text), F.regexp_extract(text, _AFTER_THINK, 1)).otherwise(text)


def split_reasoning(text: Column, think: Column) -> tuple[Column, Column]:
    """Reasoning and answer around the first closing tag of a generation that began inside a think span."""
    at = F.instr(text, "</think>")
    end = F.char_length(text)
    before = F.regexp_replace(F.substr(text, F.lit(1), at - 1), r"^\n+|\n+\z", "")
    after = F.regexp_replace(F.substr(text, at + 8, F.greatest(end - at - 7, F.lit(0))), r"^\n+", "")
    reasoning = F.when(~think, F.lit(None).cast("string")).when(at > 0, before).otherwise(text)
    return reasoning, F.when(~think, text).when(at > 0, after).otherwise("")


def merge_generation(reasoning: Column, content: Column) -> Column:
    """Both parts with an empty line between them, or the one that is there."""
    empty = F.lit("")
    a, b = F.coalesce(reasoning, empty), F.coalesce(content, empty)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("\n\n"), b)).otherwise(F.concat(a, b))
