"""Annual and seasonal summaries, baselines and anomalies.

Every summary is a single grouped aggregate, so rows are combined before the
exchange however unevenly they fall on the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import CANOPY_SPECIES
from ..functions.scalars import equal_width_bin, zero_if_missing
from ..functions.semantics import named, strict_mean
from .filters import STUDY_WINDOW, study_window
from .joins import natural_join, with_one_row
from .quantiles import grouped_quantiles

# Heat-stress threshold in degrees C, and the two seasons (first, last month).
STRESS_THRESHOLD = 17.0
SPRING = (3, 5)
SUMMER = (6, 8)
MONTHS_PER_YEAR = 12


def _season(date: str, months: tuple[int, int]) -> str:
    """SQL condition of a date lying in a season."""
    return f"month(`{date}`) BETWEEN {months[0]} AND {months[1]}"


def annual_summary(df: DataFrame, keys: Sequence[str], value: str = "tempC") -> DataFrame:
    """Mean, maximum and sample sd per location and year."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"mean_{value}"),
        F.max(value).alias(f"max_{value}"),
        F.stddev_samp(value).alias(f"sd_{value}"),
    )


def annual_p90(df: DataFrame, keys: Sequence[str], value: str = "tempC") -> DataFrame:
    """Mean and 90th percentile (as the maximum) per location and year."""
    return grouped_quantiles(
        df, keys, value, {f"max_{value}": 0.9}, [F.avg(value).alias(f"mean_{value}")]
    )


def cell_month_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and 90th percentile over the time steps of a cell and month."""
    return grouped_quantiles(df, keys, value, {"p90": 0.9}, [F.avg(value).alias("mean")])


def seasonal_means(
    df: DataFrame, keys: Sequence[str], suffix: str, value: str = "tempC", date: str = "DateName",
    window: tuple[int, int] | None = None,
) -> DataFrame:
    """Overall mean, and spring and summer means that are missing if any month is."""
    rows = study_window(df, *(window or STUDY_WINDOW), date=date)
    return rows.groupBy(*keys).agg(
        F.avg(value).alias(f"mean_temp_{suffix}"),
        strict_mean(f"`{value}`", _season(date, SPRING)).alias(f"march_may_temp_{suffix}"),
        strict_mean(f"`{value}`", _season(date, SUMMER)).alias(f"june_aug_temp_{suffix}"),
    )


def stress_counts(
    df: DataFrame, keys: Sequence[str], value: str = "tempC", date: str = "DateName",
    threshold: float = STRESS_THRESHOLD,
) -> DataFrame:
    """Mean and number of values at or above the threshold, by year and by season."""
    def pair(scope: str, suffix: str) -> list[Column]:
        return [
            F.expr(f"avg(`{value}`) FILTER (WHERE {scope}) AS mean_temp{suffix}"),
            F.expr(f"count_if({scope} AND `{value}` >= {threshold!r}D) AS stress_count{suffix}"),
        ]

    return df.groupBy(*keys).agg(
        *pair("true", ""),
        *pair(_season(date, SPRING), "_march_may"),
        *pair(_season(date, SUMMER), "_june_august"),
    )


def ice_summary(df: DataFrame, keys: Sequence[str], value: str = "ice_conc") -> DataFrame:
    """Mean ice and ice-free months of the year; missing ice is no ice."""
    ice = zero_if_missing(F.col(value))
    return df.groupBy(*keys).agg(
        F.avg(ice).alias("mean_ice_conc"),
        (F.lit(MONTHS_PER_YEAR) - F.count_if(ice > 0)).alias("ice_free_months"),
    )


def site_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "_site") -> DataFrame:
    """Mean of many columns per site."""
    return df.groupBy(*keys).agg(*[F.avg(named(c)).alias(f"{c}{suffix}") for c in cols])


def mean_within_year_sd(df: DataFrame, keys: Sequence[str], sd: str = "sd_tempC") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(sd).alias(f"avg_{sd}"))


def region_climatology(df: DataFrame, region: str, value: str = "tempC", year: str = "Year") -> DataFrame:
    """Annual mean and 90th percentile, then their mean over the years."""
    annual = annual_p90(df, [region, year], value)
    return annual.groupBy(region).agg(
        F.avg(f"mean_{value}").alias(f"mean_{value}_region"),
        F.avg(f"max_{value}").alias(f"max_{value}_region"),
    )


def anomaly(df: DataFrame, cols: Sequence[str], baseline: str = "_site", suffix: str = "_dev") -> DataFrame:
    """Value minus the baseline column of the same name and suffix."""
    return df.withColumns({f"{c}{suffix}": named(c) - named(f"{c}{baseline}") for c in cols})


def climatology_anomaly(df: DataFrame, baseline: DataFrame, region: str, cols: Sequence[str]) -> DataFrame:
    """Join the region's baseline, subtract it, and drop it."""
    joined = natural_join(df, baseline, [region], "left")
    return anomaly(joined, cols, "_region", "_anomaly").drop(*[f"{c}_region" for c in cols])


def site_profile(df: DataFrame, keys: Sequence[str], order: str, first: Sequence[str], year: str = "Year") -> DataFrame:
    """Duration, first and last year, row count, and the first row's other columns."""
    return df.groupBy(*keys).agg(
        (F.max(year) - F.min(year)).alias("Duration"),
        F.max(year).alias("max_year"),
        F.min(year).alias("min_year"),
        F.min_by(F.struct(*first), order).alias("_first"),
        F.count(F.lit(1)).alias("n"),
    ).select(*keys, "Duration", "max_year", "min_year", *[f"_first.{c}" for c in first], "n")


def unique_points(df: DataFrame, member: str = "trajectory_ID") -> DataFrame:
    """Distinct coordinates with the number of distinct members at each."""
    return df.groupBy("Latitude", "Longitude").agg(F.count_distinct(member).alias("len"))


def group_any(
    df: DataFrame, group: str, member: str, listed: Iterable[str] = CANOPY_SPECIES,
    yes: str = "canopy", no: str = "no canopy", name: str = "has_canopy",
) -> DataFrame:
    """Label a group by whether any of its members is in the list."""
    return df.groupBy(group).agg(
        F.when(F.max(F.coalesce(F.col(member).isin(list(listed)), F.lit(False))), yes).otherwise(no).alias(name)
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts of equal-width bins over the column's range; empty bins are left out."""
    limits = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    binned = with_one_row(df.select(column).where(F.col(column).isNotNull()), limits).withColumn(
        "bin", equal_width_bin(F.col(column), F.col("_lo"), F.col("_hi"), bins)
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return binned.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("_lo") + width * (F.col("bin") - 1)).alias("bin_low"), "n"
    )


def totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum over the rows and its standard error, one row per column."""
    one = df.agg(*[
        F.struct(F.sum(c).alias("total"), F.sqrt(F.count(c) * F.var_samp(c)).alias("se")).alias(c) for c in cols
    ])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("quantity"), F.col(c)["total"].alias("total"), F.col(c)["se"].alias("se")) for c in cols
    ])))
