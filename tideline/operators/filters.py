"""Row filters and column choices."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.semantics import named

# First survey year and last year of the wave record.
STUDY_WINDOW = (1952, 2008)
TINY_ERROR = 1e-20
ABSURD_VALUE = 100.0


def within_years(df: DataFrame, date: str, lo: int, hi: int) -> DataFrame:
    """Rows whose date lies in an inclusive range of years, as a range of dates, which scans can skip files and row groups by."""
    return df.where((named(date) >= F.lit(f"{lo:04d}-01-01").cast("date")) & (named(date) < F.lit(f"{hi + 1:04d}-01-01").cast("date")))


def study_window(
    df: DataFrame, lo: int = STUDY_WINDOW[0], hi: int = STUDY_WINDOW[1], year: str = "Year", date: str | None = None
) -> DataFrame:
    """Rows of an inclusive range of years; by their ``date``, where there is one, whose range reaches the scan."""
    return df.where(F.col(year).between(lo, hi)) if date is None else within_years(df, date, lo, hi)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows that miss any of the named columns."""
    return reduce(lambda d, c: d.where(named(c).isNotNull()), cols, df)


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Chain of equality filters."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), values.items(), df)


def members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def nonzero_error(df: DataFrame, cols: Sequence[str], floor: bool = False) -> DataFrame:
    """Drop rows with a standard error of zero, or raise it to a tiny number."""
    if floor:
        return df.withColumns({c: F.when(named(c) == 0, TINY_ERROR).otherwise(named(c)) for c in cols})
    return reduce(lambda d, c: d.where(named(c) != 0), cols, df)


def rename_suffix(df: DataFrame, contains: str, suffix: str) -> DataFrame:
    """Append a suffix to every column whose name contains the text."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if contains.lower() in c.lower()})


def column_span(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from one column to another in table order."""
    cols = df.columns
    return cols[cols.index(first): cols.index(last) + 1]


def select_matching(
    df: DataFrame, contains: str | None = None, matches: str | None = None,
    without: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Columns by name: containing, matching a pattern (any case), or not containing a text."""
    def wanted(c: str) -> bool:
        if c in keep:
            return True
        name = c.lower()
        return (
            (contains is None or contains.lower() in name)
            and (matches is None or re.search(matches, c, re.IGNORECASE) is not None)
            and (without is None or without.lower() not in name)
        )

    return df.select(*[named(c) for c in df.columns if wanted(c)])


def pick_measure(df: DataFrame, wavecol: str, tempcol: str) -> DataFrame:
    """Copy the chosen measures and their paired errors to fixed names."""
    def error_of(c: str) -> str:
        return c.replace("estimate", "std.error")

    return df.withColumns({
        "waves": named(wavecol),
        "se_waves": named(error_of(wavecol)),
        "temp": named(tempcol),
        "se_temp": named(error_of(tempcol)),
    })


def relabel(df: DataFrame, renames: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(renames))


def suspect_rows(df: DataFrame, value: str, limit: float = ABSURD_VALUE) -> DataFrame:
    """Rows whose value is missing or absurdly high."""
    return df.where(F.col(value).isNull() | (F.col(value) > limit))


def quality_report(df: DataFrame, value: str, keys: Sequence[str] = (), limit: float = ABSURD_VALUE) -> DataFrame:
    """Rows, missing values and absurdly high values, per group or overall."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.count_if(F.col(value) > limit).alias("n_high"),
    )
