"""Registry of queries: name, Spark callable, SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB spellings of the text functions.
W = r"[^ \t\n\r\f]+"
SP = r"[ \t\n\r\f]"


def n_words(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{W}')), 0)"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+\z', '', 'g')"


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep
