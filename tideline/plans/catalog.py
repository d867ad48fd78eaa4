"""Registry of queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL it must agree with."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round the double columns; ``other`` gives the digits of single columns."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[
        F.round(F.col(f"`{c}`"), other.get(c, digits)).alias(c) if c in doubles else F.col(f"`{c}`")
        for c in df.columns
    ])


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL of a rounded, named column (adding zero turns -0.0 into 0.0)."""
    return f'round({expr}, {digits}) + 0.0::DOUBLE AS "{name}"'


def rs(names: str, digits: int = 6) -> str:
    """SQL of several rounded columns that keep their names."""
    return ", ".join(r(f'"{n}"', n, digits) for n in names.split())
