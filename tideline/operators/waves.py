"""Wave measures: monthly to yearly, and the joined table of all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .joins import rounded_coord_join

POINT_YEAR = ["Year", "GOWLon", "GOWLat"]
# The measures kept by the deviation analysis, in table order.
WAVE_MEASURES = [
    "mean_wave_energy",
    "mean_wave_height",
    "max_mean_wave_energy",
    "max_sum_wave_energy",
    "total_wave_energy",
    "max_wave_height",
    "q95_wave_height",
]


def annual_extremes(monthly: DataFrame, name: str, total: str | None = None, max_name: str | None = None) -> DataFrame:
    """Yearly maximum and sd, and if asked the yearly total, of a monthly series.

    A year without values has a total of zero and no maximum.
    """
    aggs = [
        F.max("measurement").alias(max_name or f"max_{name}"),
        F.stddev_samp("measurement").alias(f"sd_{name}"),
    ]
    if total:
        aggs.insert(1, F.coalesce(F.sum("measurement"), F.lit(0.0)).alias(total))
    return monthly.groupBy(*POINT_YEAR).agg(*aggs)


def wave_frame(
    mean_energy: DataFrame,
    mean_height: DataFrame,
    q95_height: DataFrame,
    monthly_mean_energy: DataFrame,
    monthly_sum_energy: DataFrame,
    monthly_max_height: DataFrame,
    points: DataFrame,
) -> DataFrame:
    """All yearly measures per grid point and year of the mean energy sheet, expanded to the original points.

    The six tables are stacked and one aggregate by (Year, GOWLon, GOWLat) takes every measure from its own
    rows, so they share one shuffle, after a map-side combine, and no table is joined with another. A point
    that a sheet names twice counts once, with its larger yearly value. What a table lacks is missing.
    """
    tables = {
        "mean_wave_energy": mean_energy, "mean_wave_height": mean_height, "q95_wave_height": q95_height,
        "monthly_mean_energy": monthly_mean_energy, "monthly_sum_energy": monthly_sum_energy, "monthly_max_height": monthly_max_height,
    }
    stacked = reduce(DataFrame.unionByName, [
        df.select(*POINT_YEAR, F.col("measurement").cast("double").alias("measurement"), F.lit(name).alias("_of")) for name, df in tables.items()])

    def of(name: str) -> Column:
        return F.when(F.col("_of") == name, F.col("measurement"))

    def extremes(table: str, name: str, max_name: str | None = None) -> list[Column]:
        return [F.max(of(table)).alias(max_name or f"max_{name}"), F.stddev_samp(of(table)).alias(f"sd_{name}")]

    has = lambda name: F.max(F.when(F.col("_of") == name, True))
    total = F.when(has("monthly_sum_energy"), F.coalesce(F.sum(of("monthly_sum_energy")), F.lit(0.0)))
    by_point = stacked.groupBy(*POINT_YEAR).agg(
        has("mean_wave_energy").alias("_has"),
        F.max(of("mean_wave_energy")).alias("mean_wave_energy"), F.max(of("mean_wave_height")).alias("mean_wave_height"),
        *extremes("monthly_mean_energy", "mean_wave_energy"),
        F.max(of("monthly_sum_energy")).alias("max_sum_wave_energy"), total.alias("total_wave_energy"),
        F.stddev_samp(of("monthly_sum_energy")).alias("sd_sum_wave_energy"),
        *extremes("monthly_max_height", "max_wave_height", "max_wave_height"),
        F.max(of("q95_wave_height")).alias("q95_wave_height"),
    ).where("_has").drop("_has").withColumnsRenamed({"GOWLon": "LonGOW", "GOWLat": "LatGOW"})
    # Point list and sheet come from different files: their coordinates meet on rounded keys.
    return rounded_coord_join(points, by_point, ["LonGOW", "LatGOW"]).withColumnsRenamed({"orig Lat": "Latitude", "orig Lon": "Longitude"})
