"""Tasks as sets of hooks: how documents become prompts and targets, and responses scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scoring as S


@dataclass(frozen=True)
class Task:
    """The hooks of a task; each is a function over Columns, ``process_docs`` one over the table of documents.

    ``filters`` are applied to a response one after the other, ``process_results`` gives the metrics of a filtered response
    and a target.
    """

    doc_to_text: Callable[[], Column]
    doc_to_target: Callable[[], Column]
    process_results: Callable[[Column, Column], dict[str, Column]]
    process_docs: Callable[[DataFrame], DataFrame] = lambda docs: docs
    filters: tuple[Callable[[Column], Column], ...] = field(default=())


TASKS: dict[str, Task] = {}


def register(name: str, task: Task) -> Task:
    if name in TASKS:
        raise ValueError(f"the task {name!r} is there already")
    TASKS[name] = task
    return task


def task(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task: {name!r}")
    return TASKS[name]


def prompts(name: str, docs: DataFrame, key: str) -> DataFrame:
    """``(key, text, target)`` of the documents of a task."""
    own = task(name)
    return own.process_docs(docs).select(key, own.doc_to_text().alias("text"), own.doc_to_target().alias("target"))


def scored(name: str, docs: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """``(response_id, metric, value)`` of ``responses(response_id, key, response)`` by the hooks of a task."""
    own = task(name)
    joined = responses.join(prompts(name, docs, key).select(key, "target"), key)
    filtered = reduce(lambda c, f: f(c), own.filters, F.col("response"))
    metrics = own.process_results(filtered, F.col("target"))
    pairs = F.create_map(*[x for k, c in metrics.items() for x in (F.lit(k), c.cast("double"))])
    return joined.select("response_id", F.explode(pairs).alias("metric", "value"))


register(
    "number",
    Task(
        process_docs=lambda docs: docs.where("solution is not null"),
        doc_to_text=lambda: F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA:")),
        doc_to_target=lambda: S.number_gold(F.col("solution")),
        filters=(lambda r: F.coalesce(r, F.lit("")), lambda r: F.replace(r, F.lit("####"), F.lit("The answer is"))),
        process_results=S.number_scores,
    ),
)
register(
    "letter",
    Task(
        process_docs=lambda docs: docs.where("choices is not null"),
        doc_to_text=lambda: F.concat(F.col("question"), F.lit("\nAnswer:")),
        doc_to_target=lambda: F.coalesce(S.letter_gold(F.col("answer")), F.lit("")),
        process_results=S.letter_scores,
    ),
)
