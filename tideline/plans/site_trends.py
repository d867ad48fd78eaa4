"""Path 1: one row per site, the trend of each environmental variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.climate import annual_summary
from ..operators.filters import complete_cases, nonzero_error, pick_measure, where_equal
from ..operators.joins import natural_join, natural_left_join
from ..operators.materialize import written
from ..operators.rows import factor_levels, zscore
from ..operators.trend import merge_trends, multi_trend, paired_trends

# Which rows of the prior result table are the sites' own slopes.
PRIOR_SLOPES = {"parameter": "site_slope", "grouping": "Ecoregion", "Period": "1900-2015"}
TEMPERATURE_TRENDS = {"max_temp_slope": "max_tempC", "mean_temp_slope": "mean_tempC"}


def site_temperatures(survey: DataFrame, series: DataFrame, location: Sequence[str]) -> DataFrame:
    """Annual temperature of each survey row's location and year.

    The annual value repeats for every survey row of a year, so a year with more
    rows weighs more in the site's trend.
    """
    annual = annual_summary(series, [*location, "Year"])
    return natural_left_join(survey, annual)


def temperature_trends(survey: DataFrame, series: DataFrame, location: Sequence[str]) -> DataFrame:
    """Per site: trends of the annual maximum and mean, and the mean within-year sd."""
    merged = site_temperatures(survey.select("SiteName", "Year", *location), series, location)
    return paired_trends(merged, ["SiteName"], "Year", TEMPERATURE_TRENDS, {"avg_sd_tempC": F.avg("sd_tempC")})


def wave_trends(survey_waves: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Per site and place: trend of each wave measure over the surveyed years."""
    return multi_trend(survey_waves, ["SiteName", "Latitude", "Longitude"], "Year", measures)


def merged_site_trends(prior: DataFrame, temperature: DataFrame, waves: DataFrame | None = None) -> DataFrame:
    """The sites' prior slopes with the environmental trends beside them."""
    base = where_equal(prior, **PRIOR_SLOPES)
    out = merge_trends(base, temperature)
    return merge_trends(out, waves) if waves is not None else out


#: What a site needs to enter the standardized frame, and what the models read of it.
NEEDED = ["max_wave_height_estimate", "max_wave_height_std.error", "max_temp_slope_estimate"]
MODEL_COLUMNS = ["slope", "temp_scale", "waves_scale", "nocanopy", "abs_lat", "slope_se", "se_temp_scale", "se_waves_scale", "studyIDX"]


def standardized_frame(trends: DataFrame, waves: str, temperature: str, needed: Sequence[str] = NEEDED) -> DataFrame:
    """The sites' slopes beside the standardized measures that a model reads.

    ``trends`` has one row per site: mean, se, Study, Latitude, Duration, has_canopy and, for each measure,
    an estimate and a std.error; ``waves`` and ``temperature`` name the estimates to use. Measures, absolute latitude and
    Duration are centered and scaled over the sites that have all of ``needed``, errors are divided by their
    measure's deviation; nocanopy and studyIDX number the labels, from 0 and from 1.
    """
    complete = complete_cases(trends.withColumnsRenamed({"mean": "slope", "se": "slope_se"}), needed)
    frame = written(pick_measure(complete, waves, temperature).withColumns({
        "abs_lat": F.abs("Latitude"), "Duration": F.col("Duration").cast("double")}))
    levels = factor_levels(frame, {"has_canopy": "nocanopy", "Study": "studyIDX"})
    scaled = zscore(frame, ["abs_lat", "Duration", "waves", "temp"], errors={"waves": "se_waves", "temp": "se_temp"})
    for column, table in levels.items():
        scaled = natural_join(scaled, table, [column], "left")
    return scaled.withColumn("nocanopy", F.col("nocanopy") - 1)


def model_rows(frame: DataFrame, keep: Sequence[str] = ("SiteName",)) -> DataFrame:
    """What a model with errors in the measures can take: no error of zero."""
    return nonzero_error(frame, ["se_waves_scale", "se_temp_scale"]).select(*keep, *MODEL_COLUMNS)
