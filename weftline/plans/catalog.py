"""All core queries and their oracle SQL."""

from __future__ import annotations

from weftline.plans import control, conversation, decoding, evaluation, metrics, requests, sampling, scoring, store, tokens  # noqa: F401
from weftline.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
