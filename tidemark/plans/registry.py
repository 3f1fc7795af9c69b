"""All queries over the reference operators, by name, with DuckDB SQL.

A query is a function of (spark, sf_dir).  Doubles that depend on an order of
summation are rounded in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import banks, corpus, frames, selection, speech, stars  # noqa: E402, F401  (they register their queries)
