"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _plain_counts(sql)
        return f

    return add


def _plain_counts(sql: str) -> str:
    """``count_if(x)`` as a filtered count, which is a BIGINT where ``count_if`` is a HUGEINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 0, at + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages once each, however often they were delivered."""
    return table(spark, sf_dir, "chat_messages").where("request_id is not null").select("message_id", "request_id", "turn", "role", "content").distinct()


#: The same in SQL.
TURNS = "turns AS (SELECT DISTINCT message_id, request_id, turn, role, content FROM chat_messages WHERE request_id IS NOT NULL)"
#: Blanks as Python's ``str.strip`` knows them, as an RE2 class.
BLANK = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+\\z', '', 'g')"


def sql_clean(x: str) -> str:
    return sql_strip(f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\\n{{2,}}', chr(10), 'g')")


THINK = r"(?is)<think\s*>(.*?)</think\s*>"


def sql_reasoning(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE regexp_extract({x}, '{THINK}', 1) END"


def sql_answer(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '{THINK}') THEN regexp_extract({x}, '(?is)^.*?<think\\s*>.*?</think\\s*>(.*)\\z', 1) ELSE {x} END"
