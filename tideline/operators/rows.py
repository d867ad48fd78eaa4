"""Per-group facts on each row, standardization and category indices.

A fact about a group is an aggregate joined back, not a window: a window would
send a whole group to one task. First rows per group are ``min_by`` aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.semantics import named
from .joins import natural_join, with_one_row
from .materialize import number_rows, written


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach grouped aggregates to each row."""
    return natural_join(df, df.groupBy(*keys).agg(*aggs), list(keys), "left")


def year_range(df: DataFrame, keys: Sequence[str] = ("SiteName",), year: str = "Year") -> DataFrame:
    """``first-last`` year of the group on each row."""
    return with_group_stats(
        df, keys, F.concat_ws("-", F.min(year).cast("string"), F.max(year).cast("string")).alias("YearRange")
    )


def min_obs(
    df: DataFrame, keys: Sequence[str], more_than: int = 2, name: str = "n_per_site", weight: str | None = None,
) -> DataFrame:
    """Rows of groups with more than the given number of rows, and that number; with ``weight`` a row counts as so many."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(*keys).agg(size.alias(name)).where(F.col(name) > more_than)
    return natural_join(df, sizes, list(keys), "inner")


def min_members(
    df: DataFrame, group: str, member: str, more_than: int = 5, name: str = "sites_per_ecoregion"
) -> DataFrame:
    """Rows of groups with more than the given number of distinct members."""
    sizes = df.groupBy(group).agg(F.count_distinct(member).alias(name)).where(F.col(name) > more_than)
    return natural_join(df, sizes, [group], "inner")


def missing_flag(df: DataFrame, keys: Sequence[str], value: str, need: int = 3, name: str = "isBad") -> DataFrame:
    """True where fewer than the needed number of values is present in the group."""
    n, missing = F.count(F.lit(1)), F.count_if(F.col(value).isNull())
    return with_group_stats(df, keys, (missing > n - need).alias(name))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in an explicit order; missing order values come last."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_{c}_null"), F.col(c))])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(
        *keys, *[f"_row.{c}" for c in rest]
    ).select(*df.columns)


def scale_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample sd of each column: one row, or one per group."""
    return df.groupBy(*by).agg(*[
        a for c in cols for a in (F.avg(named(c)).alias(f"_mean_{c}"), F.stddev_samp(named(c)).alias(f"_sd_{c}"))
    ])


def _with_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return natural_join(df, stats, list(by), "left") if by else with_one_row(df, stats)


def zscore(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), errors: Mapping[str, str] | None = None,
    suffix: str = "_scale",
) -> DataFrame:
    """Center and scale by the sample sd; ``errors`` maps a column to its error, divided by the same sd."""
    joined = _with_stats(df, scale_stats(df, cols, by), by)
    out = {f"{c}{suffix}": F.try_divide(named(c) - named(f"_mean_{c}"), named(f"_sd_{c}")) for c in cols}
    out |= {f"{e}{suffix}": F.try_divide(named(e), named(f"_sd_{c}")) for c, e in (errors or {}).items()}
    return joined.withColumns(out).drop(*[f"_{s}_{c}" for s in ("mean", "sd") for c in cols])


def center(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "_c") -> DataFrame:
    """Subtract the mean."""
    joined = _with_stats(df, scale_stats(df, cols, by), by)
    return joined.withColumns({f"{c}{suffix}": named(c) - named(f"_mean_{c}") for c in cols}).drop(
        *[f"_{s}_{c}" for s in ("mean", "sd") for c in cols]
    )


def unscale(df: DataFrame, cols: Sequence[str], stats: DataFrame, suffix: str = "_scale") -> DataFrame:
    """Back from standardized to natural units, with the one-row table of :func:`scale_stats`."""
    joined = with_one_row(df, stats)
    return joined.withColumns({
        c: named(f"{c}{suffix}") * named(f"_sd_{c}") + named(f"_mean_{c}") for c in cols
    }).drop(*stats.columns)


def factor_levels(df: DataFrame, factors: Mapping[str, str]) -> dict[str, DataFrame]:
    """For each column of ``factors`` (column: index name) its levels with 1-based indices in their order.

    The levels of all columns are stacked and numbered by one sort. A missing level has no index.
    """
    columns = list(factors)
    kinds = {c: df.schema[c].dataType for c in columns}
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_of"), *[(F.col(f"`{c}`") if c == own else F.lit(None).cast(kinds[c])).alias(f"_l{j}")
                                          for j, c in enumerate(columns)])
        for i, own in enumerate(columns)])).alias("_x")).select("_x.*")
    present = stacked.where(" OR ".join(f"_l{j} IS NOT NULL" for j in range(len(columns))))
    numbered = written(number_rows(present.distinct(), [F.col("_of"), *[F.col(f"_l{j}") for j in range(len(columns))]], "_n"))
    out = {}
    for j, (column, name) in enumerate(factors.items()):
        own = numbered.where(F.col("_of") == j).select(F.col(f"_l{j}").alias(column), F.col("_n").alias(name))
        out[column] = with_one_row(own, own.agg((F.min(name) - 1).alias("_before"))).select(
            column, (F.col(name) - F.col("_before")).alias(name))
    return out


def factor_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """1-based index of the sorted levels of a column; a missing level has no index."""
    return natural_join(df, factor_levels(df, {column: name})[column], [column], "left")


def point_groups(df: DataFrame, keys: Sequence[str], name: str = "pointgroup") -> DataFrame:
    """Consecutive id of each distinct key tuple."""
    return number_rows(df.select(*keys).distinct(), [F.col(c).asc_nulls_last() for c in keys], name)


def delta_to_best(df: DataFrame, column: str = "waic", name: str = "delta") -> DataFrame:
    """Distance of each row to the smallest value of the table."""
    best = df.agg(F.min(column).alias("_best"))
    return with_one_row(df, best).withColumn(name, F.col(column) - F.col("_best")).drop("_best")


def sorted_by(df: DataFrame, *cols: str) -> DataFrame:
    """Ascending sort with missing values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])
