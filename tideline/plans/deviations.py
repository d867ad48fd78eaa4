"""Path 2: one row per observation, each measure as deviation from its site mean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import override_in_boxes
from ..operators.climate import anomaly, seasonal_means, site_means, stress_counts
from ..operators.filters import complete_cases, study_window
from ..operators.joins import natural_join, reduce_left_join, rounded_coord_join
from ..operators.materialize import written
from ..operators.rows import min_members, min_obs

SITE = "site"


def with_temperature(
    survey: DataFrame, series: DataFrame, regions: Mapping[str, DataFrame], location: Sequence[str],
    window: tuple[int, int],
) -> DataFrame:
    """Survey rows with annual values, site and region baselines, and the deviation.

    ``regions`` maps a region column to that region's long series.
    """
    inside = study_window(series, *window, date="DateName")
    annual = stress_counts(inside, [*location, "Year"])
    sites = seasonal_means(series, location, SITE, window=window)
    baselines = [seasonal_means(df, [name], name.lower(), window=window) for name, df in regions.items()]
    merged = reduce_left_join([study_window(survey, *window), annual, sites, *baselines])
    return anomaly(merged, ["mean_temp"])


def with_waves(
    survey: DataFrame, waves: DataFrame, measures: Sequence[str], window: tuple[int, int]
) -> DataFrame:
    """Add the year's wave measures, their site means and the deviations.

    Coordinates are joined on rounded integer keys. The means, one row per site, come first: the measures may be
    several rows a site and year, so what their join gives is neither shuffled nor joined again.
    """
    inside = study_window(waves, *window).select("Year", "Latitude", "Longitude", *measures)
    means = site_means(inside, ["Latitude", "Longitude"], measures)
    merged = rounded_coord_join(rounded_coord_join(survey, means), inside, also=["Year"])
    site = [f"{m}_site" for m in measures]
    return anomaly(merged.select(*survey.columns, *measures, *site), measures)


def with_canopy(df: DataFrame, canopy: DataFrame) -> DataFrame:
    """Study label from the taxa table, then the regional overrides."""
    labelled = natural_join(df, canopy, ["Study"], "left")
    return labelled.withColumn(
        "has_canopy", override_in_boxes(F.col("has_canopy"), F.col("Longitude"), F.col("Latitude"))
    )


def analysis_rows(
    df: DataFrame, needed: str = "mean_wave_energy_dev", min_rows: int = 2, min_sites: int = 5, weight: str | None = None,
) -> DataFrame:
    """Rows of sites with enough rows, then of ecoregions with enough such sites.

    With ``weight`` a row stands for so many; those that stand for none are left out. The table is read three
    times, so it is written out once first.
    """
    present = written(complete_cases(df, [needed]) if weight is None else df.where(F.col(weight) > 0))
    return min_members(min_obs(present, ["Study", "Site"], min_rows, weight=weight), "ECOREGION", "Site", min_sites)


def wave_analysis_rows(
    survey: DataFrame, waves: DataFrame, measures: Sequence[str], window: tuple[int, int],
    needed: str = "mean_wave_energy", min_rows: int = 2, min_sites: int = 5,
) -> DataFrame:
    """:func:`analysis_rows` of :func:`with_waves`, by the deviation of the measure ``needed``.

    A survey row meets several wave rows where a site and year have several. How many of them have the deviation is
    counted first and survey rows stand for so many, so sites are chosen on survey rows;
    only kept ones meet their waves, last.
    """
    place = ["Year", "Latitude", "Longitude"]
    counts = with_waves(survey.select(*place).distinct(), waves, [needed], window).groupBy(*place).agg(F.count(f"{needed}_dev").alias("_met"))
    met = natural_join(survey, counts, place, "inner")
    kept = analysis_rows(met, min_rows=min_rows, min_sites=min_sites, weight="_met").drop("_met")
    return complete_cases(with_waves(kept, waves, measures, window), [f"{needed}_dev"])
