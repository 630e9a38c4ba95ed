"""Conversations as role-aware segments with a loss bit.

Three layouts are in use; where separators stand matters, as each segment is tokenized on its own.  All of them
are row-local array expressions over the messages of a conversation, so the only shuffle is the one that gathers a
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import answer_of, clean_text, reasoning_of

#: Fixed values of the layouts.
TURN_SEPARATOR = "\n\n"
DEFAULT_SYSTEM = "You are a helpful assistant"
NO_THINK_PREFIX = "Assistant: <think></think>\n"
THINK_PREFIX = "Assistant: <think>"
DEFAULT_PROMPT_SYSTEM = "System: You are a helpful assistant. Think briefly and carefully without repeating words.\n\n"


def conversations(messages: DataFrame, key: str = "request_id") -> DataFrame:
    """``(key, messages)`` with the messages of a conversation in order of turn."""
    row = F.struct("turn", "message_id", "role", "content")
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("messages"))


def segment(text: Column | str, lossable: bool) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(lossable).alias("lossable"))


def _unknown(role: Column) -> Column:
    return F.array(F.struct(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("string").alias("text"), F.lit(False).alias("lossable")))


def _labelled(label: str, text: Column) -> Column:
    return segment(F.concat(F.lit(label), text), False)


def chat_segments(messages: Column) -> Column:
    """Separators as segments of their own; every assistant turn gets the empty think prefix.  Null content counts as empty."""
    starts = F.coalesce(F.element_at(F.transform(messages, lambda m: m["role"]), 1) == "system", F.lit(False))

    def of(m: Column, i: Column) -> Column:
        text = clean_text(F.coalesce(m["content"], F.lit("")))
        own = (
            F.when(m["role"] == "system", F.array(_labelled("System: ", text)))
            .when(m["role"] == "user", F.array(_labelled("User: ", text)))
            .when(m["role"] == "assistant", F.array(segment(NO_THINK_PREFIX, False), segment(text, True)))
            .otherwise(_unknown(m["role"]))
        )
        return F.when((i > 0) | ~starts, F.concat(F.array(segment(TURN_SEPARATOR, False)), own)).otherwise(own)

    body = F.flatten(F.transform(messages, of))
    return F.when(starts, body).otherwise(F.concat(F.array(segment(f"System: {DEFAULT_SYSTEM}", False)), body))


def _answer_segments(content: Column) -> Column:
    reasoning, answer = clean_text(reasoning_of(content)), clean_text(answer_of(content))
    thought = F.array(segment(THINK_PREFIX, False), segment(F.concat(F.lit("\n"), reasoning, F.lit("\n</think>\n"), answer), True))
    return F.when(reasoning != "", thought).otherwise(F.array(segment(NO_THINK_PREFIX, False), segment(answer, True)))


def pair_segments(user: Column, output: Column) -> Column:
    """One prompt and one answer; the separator ends the user segment; nulls count as empty."""
    head = F.array(segment(f"System: {DEFAULT_SYSTEM}\n\n", False), segment(F.concat(F.lit("User: "), clean_text(F.coalesce(user, F.lit(""))), F.lit("\n\n")), False))
    return F.concat(head, _answer_segments(F.coalesce(output, F.lit(""))))


def reasoning_segments(messages: Column) -> Column:
    """The separator ends the system segment, then stands between turns; later system turns stay in place."""
    first = F.element_at(messages, 1)
    starts = F.coalesce(first["role"] == "system", F.lit(False))
    system = F.when(starts, clean_text(F.coalesce(first["content"], F.lit("")))).otherwise(F.lit(DEFAULT_SYSTEM))
    head = F.array(segment(F.concat(F.lit("System: "), system, F.lit("\n\n")), False))
    rest = F.when(starts, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)

    def of(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        own = (
            F.when(m["role"] == "user", F.array(_labelled("User: ", clean_text(content))))
            .when(m["role"] == "assistant", _answer_segments(content))
            .when(m["role"] == "system", F.array(_labelled("System: ", clean_text(content))))
            .otherwise(_unknown(m["role"]))
        )
        return F.when(i > 0, F.concat(F.array(segment(TURN_SEPARATOR, False)), own)).otherwise(own)

    return F.concat(head, F.flatten(F.transform(rest, of)))


def flat_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def exploded(df: DataFrame, segments: Column, *keys: str) -> DataFrame:
    """``(keys, seg_idx, text, lossable)``."""
    return df.select(*keys, F.posexplode(segments).alias("seg_idx", "s")).select(*keys, "seg_idx", "s.text", "s.lossable")


def prompt(messages: Column, effort: Column) -> Column:
    """The prompt of a request; null when there are no messages or the last is not the user's.

    The first system turn anywhere counts, others and unknown roles are skipped.
    """
    systems = F.filter(messages, lambda m: m["role"] == "system")
    head = F.when(F.size(systems) > 0, F.concat(F.lit("System: "), clean_text(F.coalesce(F.try_element_at(systems, F.lit(1))["content"], F.lit(""))), F.lit("\n\n"))).otherwise(F.lit(DEFAULT_PROMPT_SYSTEM))
    spoken = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    body = F.array_join(F.transform(spoken, lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), clean_text(F.coalesce(m["content"], F.lit(""))), F.lit("\n\n"))), "")
    think = effort.isNotNull() & (effort != "minimal")
    tail = F.when(think, F.lit("Assistant: <think>")).otherwise(F.lit("Assistant: <think></think>"))
    usable = F.try_element_at(messages, F.lit(-1))["role"] == "user"
    return F.when(usable, F.concat(head, body, tail))
