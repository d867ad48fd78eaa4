"""Rules for missing values, rounding and float keys, decided once.

Missing is SQL NULL only. NaN and numeric sentinels are turned into NULL when a
table is loaded, because Spark aggregates skip NULL but not NaN and sort NaN as
the largest value.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

MISSING_SENTINEL = -1000.0  # fixed value: "no data" mark of the gridded series
KEY_DIGITS = 5  # coordinates agree to this many decimals or they are different points


def named(column: str) -> Column:
    """Column by its whole name; names such as ``x_std.error`` hold a dot."""
    return F.col(f"`{column}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def missing_to_null(df: DataFrame, cols: Iterable[str] | None = None, sentinel: float | None = None) -> DataFrame:
    """NaN (and, if given, a sentinel) becomes NULL in the float columns."""
    names = list(cols) if cols is not None else numeric_columns(df)
    fixed = {}
    for name in names:
        bad = F.isnan(named(name))
        if sentinel is not None:
            bad = bad | (named(name) == F.lit(sentinel))
        fixed[name] = F.when(~bad, named(name))
    return df.withColumns(fixed) if fixed else df


def strict_mean(value: str, scope: str = "true") -> Column:
    """Mean over the rows in scope, NULL as soon as one of them is missing (SQL expressions)."""
    inside = f"if({scope}, {value}, NULL)"
    return F.expr(f"if(count_if({scope}) = count({inside}), avg({inside}), NULL)")


def coord_key(coord: Column, digits: int = KEY_DIGITS) -> Column:
    """Integer join key of a coordinate; doubles are never compared directly."""
    return F.bround(coord * F.lit(float(10**digits)), 0).cast("long")



def number(text: Column) -> Column:
    """Text to double; anything unreadable is NULL."""
    return text.try_cast("double")
