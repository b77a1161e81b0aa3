"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import codec, columns, relational, ssb
from .workers import shipped

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (relational, codec, columns)


def queries() -> dict[str, Query]:
    out = {name: q.run for name, q in ssb.QUERIES.items()}
    for part in _PARTS:
        out |= part.QUERIES
    return {name: shipped(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: q.duck() for name, q in ssb.QUERIES.items()}
    for part in _PARTS:
        out |= part.SQL
    return out
