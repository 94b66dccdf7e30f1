"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.cluster import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query under ``name``, optionally with equivalent SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# Tables whose rows cost far more work than reading them.
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def sql_lines(text: str) -> str:
    """SQL list of the lines of a text; a final newline does not start another line."""
    pieces = f"string_split({text}, chr(10))"
    return (
        f"list_slice({pieces}, 1, len({pieces}) - "
        f"(CASE WHEN {text} = '' OR {text} LIKE '%' || chr(10) THEN 1 ELSE 0 END))"
    )


def sql_quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"
