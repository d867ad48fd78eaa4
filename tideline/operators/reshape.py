"""Wide to long and back, and axes of prediction points."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.semantics import named, number
from .joins import with_one_row
from .quantiles import grouped_quantiles


def to_long(
    df: DataFrame, ids: Sequence[str], key: str, value: str,
    columns: Sequence[str] | None = None, drop_nulls: bool = False,
) -> DataFrame:
    """Wide to long; missing cells stay as rows unless dropped."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in set(ids)]
    # Names may hold dots (coordinates written into column names), hence the quotes.
    long = df.unpivot([named(c) for c in ids], [named(c) for c in columns], key, value)
    return long.where(F.col(value).isNotNull()) if drop_nulls else long


def split_coord_key(df: DataFrame, key: str, lon: str = "GOWLon", lat: str = "GOWLat") -> DataFrame:
    """``X_<lon>_<lat>`` to two numbers; unreadable parts are NULL."""
    parts = F.split(F.regexp_replace(key, "X_", ""), "_")
    return df.withColumns({
        lon: number(F.try_element_at(parts, F.lit(1))),
        lat: number(F.try_element_at(parts, F.lit(2))),
    }).drop(key)


def positional_long(df: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """Wide to long keyed by the column's 0-based position ``pos``."""
    cells = ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in df.columns if c not in set(ids))
    return df.selectExpr(*[f"`{c}`" for c in ids], f"posexplode(array({cells})) AS (pos, `{value}`)")


def spread_stats(
    df: DataFrame, keys: Sequence[str], variable: str, variables: Sequence[str], stats: Sequence[str]
) -> DataFrame:
    """One column ``<variable>_<statistic>`` per pair; the variables are listed, not discovered.

    A conditional aggregate rather than a pivot: several statistics at once, one exchange.
    """
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(variable) == v, F.col(s))).alias(f"{v}_{s}") for v in variables for s in stats
    ])


def spread(df: DataFrame, keys: Sequence[str], key: str, value: str, values: Sequence) -> DataFrame:
    """Long to wide with an explicit list of columns."""
    return df.groupBy(*keys).pivot(key, list(values)).agg(F.max(value))


def spaced(low: Column, high: Column, n: int) -> Column:
    """Array of n equally spaced values, both ends included."""
    step = (high - low) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + step * i)


def literal_axis(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def data_axes(
    df: DataFrame,
    spaced_over: Mapping[str, int] | None = None,
    quantiles: Mapping[str, Sequence[float]] | None = None,
    literals: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """One row holding one array per axis.

    Axes are equal-spaced over a column's range, at a column's quantiles, or literal.
    """
    spaced_over, quantiles, literals = spaced_over or {}, quantiles or {}, literals or {}
    ranges = [
        a for c in spaced_over for a in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))
    ] or [F.count(F.lit(1)).alias("_any")]
    row = df.agg(*ranges).withColumns({
        f"axis_{c}": spaced(F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), n) for c, n in spaced_over.items()
    })
    for c, probs in quantiles.items():
        names = {f"_q{i}": p for i, p in enumerate(probs)}
        one = grouped_quantiles(df.select(F.lit(0).alias("_all"), c), ["_all"], c, names)
        row = with_one_row(row, one.select(F.array(*names).alias(f"axis_{c}")))
    row = row.withColumns({f"axis_{c}": literal_axis(v) for c, v in literals.items()})
    return row.select(*[c for c in row.columns if c.startswith("axis_")])


def expand_axes(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Each row once per point of the grid its axis arrays span, exploded axis by axis."""
    for name in axes:
        rest = [f"`{c}`" for c in df.columns if c != f"axis_{name}"]
        df = df.selectExpr(*rest, f"explode(`axis_{name}`) AS `{name}`")
    return df


def grid(
    df: DataFrame,
    spaced_over: Mapping[str, int] | None = None,
    quantiles: Mapping[str, Sequence[float]] | None = None,
    literals: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """All combinations of the axes of :func:`data_axes`, without repeats.

    The combinations are numbers of a range, which is dealt out over the tasks from the start; each number's
    digits, in the mixed radix of the axes' lengths, are its places on the axes. Only the axes (one row) are sent.
    """
    row = data_axes(df, spaced_over, quantiles, literals)
    names = [c.removeprefix("axis_") for c in row.columns]
    row = row.select(*[F.array_distinct(c).alias(c) for c in row.columns])
    # repeats make an axis shorter than it was asked for, never longer
    most = math.prod([*(spaced_over or {}).values(), *(len(x) for x in (quantiles or {}).values()), *(len(x) for x in (literals or {}).values())])
    numbered = with_one_row(df.sparkSession.range(most).withColumnRenamed("id", "_at"), row)
    place, picked = "_at", []
    for name in reversed(names):
        length = f"size(`axis_{name}`)"
        picked.append(f"element_at(`axis_{name}`, CAST(({place}) % {length} AS INT) + 1) AS `{name}`")
        place = f"({place}) DIV {length}"
    full = " * ".join(f"CAST(size(`axis_{n}`) AS BIGINT)" for n in names)
    return numbered.where(f"_at < {full}").selectExpr(*reversed(picked))
