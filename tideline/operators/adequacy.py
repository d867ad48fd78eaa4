"""Which sites and groups have enough data, and the frame a hierarchical model reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import text_key
from .joins import keep_matching, natural_join, with_one_row
from .materialize import written
from .rows import center, factor_levels

# Default window of years, the upper end excluded.
YEAR_LOW, YEAR_HIGH = 1900, 2015


def years_subset(
    df: DataFrame, min_obs: int, min_years: int, x_min: int = YEAR_LOW, x_max: int = YEAR_HIGH,
    study: str = "StudyName", site: str = "SiteName", year: str = "Year", y: str = "y",
) -> DataFrame:
    """All rows of the site names that qualify in at least one study.

    A (study, site) qualifies on rows and distinct years inside [x_min, x_max);
    the rows kept also lie outside it.
    """
    inside = df.where((F.col(year) >= x_min) & (F.col(year) < x_max))
    good = inside.groupBy(study, site).agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_distinct(year).alias("n_years")
    ).where((F.col("n_obs") >= min_obs) & (F.col("n_years") >= min_years))
    return keep_matching(df, good.select(site).distinct(), [site])


def min_sites_subset(df: DataFrame, group: str, min_sites: int, site: str = "SiteName") -> DataFrame:
    """All rows of the groups with enough distinct sites."""
    good = df.groupBy(group).agg(F.count_distinct(site).alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return keep_matching(df, good.select(group), [group])


def regroup(df: DataFrame, level: str) -> DataFrame:
    """Use one level of the region hierarchy, or the whole world, as the group."""
    return df.withColumn("group_name", F.lit("World") if level == "World" else F.col(level))


def model_frame(
    df: DataFrame, site: str = "SiteName", study: str = "StudyName", year: str = "Year"
) -> DataFrame:
    """Site-by-study key, indices of group, site and study, centered year, group sizes.

    The rows are written once. One sort numbers the levels of all three factors, and the sizes of groups and studies
    stand beside their levels, so the rows meet each table of levels once.
    """
    keyed = written(df.withColumn("site_key", text_key(site, study)))
    levels = factor_levels(keyed, {"group_name": "group_num", study: "study_num", "site_key": "site_num"})
    sizes = {"group_name": (study, "N_studies"), study: ("site_key", "N_sites")}
    for column, table in levels.items():
        if column in sizes:
            counted, name = sizes[column]
            sized = keyed.groupBy(column).agg(F.count_distinct(counted).alias(name))
            table = natural_join(sized, table, [column], "left")
        keyed = natural_join(keyed, table, [column], "left")
    return center(keyed, [year], suffix="_centered")


def frame_counts(frame: DataFrame, method: str, group: str = "group_num", site: str = "site_num",
                 study: str = "study_num") -> DataFrame:
    """Numbers of groups, sites, study-method pairs, methods and rows: one row."""
    one = None
    for name, cols in (("NG", [group]), ("NSI", [site]), ("NST", [method, study]), ("NM", [method])):
        part = frame.select(*cols).distinct().agg(F.count(F.lit(1)).alias(name))
        one = part if one is None else with_one_row(one, part)
    return with_one_row(one, frame.agg(F.count(F.lit(1)).alias("N")))

