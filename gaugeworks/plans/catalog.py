"""The table of queries: a name, a function of (spark, sf_dir), and the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a unique name."""

    def add(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns to six digits."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})
