"""Queries of annual and seasonal summaries, baselines, waves and per-group facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import equal_width_bin, offset
from ..operators import adequacy, climate, reshape, rows, waves
from ..operators.joins import natural_join, with_one_row
from ..sources.tables import read_wave_sheet
from . import deviations, standins as s
from .catalog import query, r, rounded, rs
from .standins import table, with_ctes

LO, HI = s.WINDOW
_SPRING = 'month("DateName") BETWEEN 3 AND 5'
_SUMMER = 'month("DateName") BETWEEN 6 AND 8'


@query("annual_summary", with_ctes("series", f"""
SELECT cell, "Year", {r('avg("tempC")', "mean_tempC")}, max("tempC") AS "max_tempC", {r('stddev_samp("tempC")', "sd_tempC")}
FROM series GROUP BY 1, 2"""))
def annual_summary(spark, folder):
    return rounded(climate.annual_summary(s.series(spark, folder), ["cell", "Year"]))


@query("annual_p90", with_ctes("series", f"""
SELECT cell, "Year", {r('quantile_cont("tempC", 0.9)', "max_tempC")}, {r('avg("tempC")', "mean_tempC")}
FROM series GROUP BY 1, 2"""))
def annual_p90(spark, folder):
    return rounded(climate.annual_p90(s.series(spark, folder), ["cell", "Year"]))


def _season(level: str) -> str:
    return f"""{r('avg("tempC")', f"mean_temp_{level}")},
  {r(f'avg("tempC") FILTER ({_SPRING})', f"march_may_temp_{level}")},
  {r(f'avg("tempC") FILTER ({_SUMMER})', f"june_aug_temp_{level}")}"""


def _season_query(name: str, cte: str, key: str, frame, suffix: str):
    sql = f"""SELECT {key}, {_season(suffix)} FROM {cte} WHERE "Year" BETWEEN {LO} AND {HI} GROUP BY {key}"""

    @query(name, with_ctes(cte, sql))
    def run(spark, folder):
        return rounded(climate.seasonal_means(frame(spark, folder), [key.strip('"')], suffix, window=s.WINDOW))


_season_query("seasonal_means_site", "series", "cell", s.series, "site")
_season_query("seasonal_means_ecoregion", "ecoregion_series", '"ECOREGION"',
              lambda sp, f: s.region_series(sp, f, "ECOREGION"), "ecoregion")
_season_query("seasonal_means_province", "province_series", '"PROVINCE"',
              lambda sp, f: s.region_series(sp, f, "PROVINCE"), "province")
_season_query("seasonal_means_realm", "province_series", '"REALM"',
              lambda sp, f: s.region_series(sp, f, "REALM"), "realm")

_STRESS = f"""{r('avg("tempC")', "mean_temp")}, count(*) FILTER ("tempC" >= 17) AS stress_count,
  {r(f'avg("tempC") FILTER ({_SPRING})', "mean_temp_march_may")},
  count(*) FILTER ("tempC" >= 17 AND {_SPRING}) AS stress_count_march_may,
  {r(f'avg("tempC") FILTER ({_SUMMER})', "mean_temp_june_august")},
  count(*) FILTER ("tempC" >= 17 AND {_SUMMER}) AS stress_count_june_august"""


@query("stress_counts", with_ctes("series", f'SELECT cell, "Year", {_STRESS} FROM series GROUP BY 1, 2'))
def stress_counts(spark, folder):
    return rounded(climate.stress_counts(s.series(spark, folder), ["cell", "Year"]))


@query("ice_summary", with_ctes("series", f"""
SELECT cell, "Year", {r("avg(ice)", "mean_ice_conc")}, 12 - count(*) FILTER (ice > 0) AS ice_free_months
FROM (SELECT cell, "Year", coalesce(CASE WHEN "tempC" > 40 THEN "tempC" END, 0) AS ice FROM series) GROUP BY 1, 2"""))
def ice_summary(spark, folder):
    ice = s.series(spark, folder).withColumn("ice_conc", F.when(F.col("tempC") > 40, F.col("tempC")))
    return rounded(climate.ice_summary(ice, ["cell", "Year"]))


_TAX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("site_means", f"""
SELECT l_suppkey, {", ".join(r(f"avg({c})", f"{c}_site", 3 if c == "l_extendedprice" else 6) for c in _TAX)}
FROM lineitem GROUP BY 1""")
def site_means(spark, folder):
    return rounded(climate.site_means(table(spark, folder, "lineitem"), ["l_suppkey"], _TAX), l_extendedprice_site=3)


@query("site_profile", with_ctes("survey", """
, f AS (SELECT *, row_number() OVER (PARTITION BY "SiteName" ORDER BY obs_id) AS rn FROM survey)
SELECT "SiteName", max("Year") - min("Year") AS "Duration", max("Year") AS max_year, min("Year") AS min_year,
  max("mean_Depth") FILTER (rn = 1) AS "mean_Depth", max("Study") FILTER (rn = 1) AS "Study",
  max("Latitude") FILTER (rn = 1) AS "Latitude", max("Longitude") FILTER (rn = 1) AS "Longitude",
  max("focalUnit") FILTER (rn = 1) AS "focalUnit", max("ECOREGION") FILTER (rn = 1) AS "ECOREGION", count(*) AS n
FROM f GROUP BY 1"""))
def site_profile(spark, folder):
    first = ["mean_Depth", "Study", "Latitude", "Longitude", "focalUnit", "ECOREGION"]
    return climate.site_profile(s.survey(spark, folder), ["SiteName"], "obs_id", first)


@query("unique_points", with_ctes("survey", """
SELECT "Latitude", "Longitude", count(DISTINCT "trajectory_ID") AS len FROM survey GROUP BY 1, 2"""))
def unique_points(spark, folder):
    return climate.unique_points(s.survey(spark, folder))


@query("region_climatology", with_ctes("province_series", f"""
, annual AS (SELECT "PROVINCE", "Year", avg("tempC") AS a, quantile_cont("tempC", 0.9) AS b FROM province_series GROUP BY 1, 2)
SELECT "PROVINCE", {r("avg(a)", "mean_tempC_region")}, {r("avg(b)", "max_tempC_region")} FROM annual GROUP BY 1"""))
def region_climatology(spark, folder):
    return rounded(climate.region_climatology(s.region_series(spark, folder, "PROVINCE"), "PROVINCE"))


@query("climatology_anomaly", with_ctes("survey series province_series", f"""
, annual AS (SELECT cell, "Year", avg("tempC") AS m, quantile_cont("tempC", 0.9) AS x FROM series GROUP BY 1, 2)
, ra AS (SELECT "PROVINCE", "Year", avg("tempC") AS a, quantile_cont("tempC", 0.9) AS b FROM province_series GROUP BY 1, 2)
, rg AS (SELECT "PROVINCE", avg(a) AS a, avg(b) AS b FROM ra GROUP BY 1)
SELECT obs_id, {r("m - a", "mean_tempC_anomaly")}, {r("x - b", "max_tempC_anomaly")}
FROM survey s LEFT JOIN annual n ON s.cell = n.cell AND s."Year" = n."Year" LEFT JOIN rg ON s."PROVINCE" = rg."PROVINCE" """))
def climatology_anomaly(spark, folder):
    annual = climate.annual_p90(s.series(spark, folder), ["cell", "Year"])
    survey = s.survey(spark, folder).select("obs_id", "cell", "Year", "PROVINCE")
    base = climate.region_climatology(s.region_series(spark, folder, "PROVINCE"), "PROVINCE")
    merged = natural_join(survey, annual, ["cell", "Year"], "left")
    out = climate.climatology_anomaly(merged, base, "PROVINCE", ["mean_tempC", "max_tempC"])
    return rounded(out.select("obs_id", "mean_tempC_anomaly", "max_tempC_anomaly"))


@query("canopy_by_study", with_ctes("taxa", """
SELECT "Study", CASE WHEN bool_or("Species" IN ('small ring', 'red widget', 'blue bolt')) THEN 'canopy' ELSE 'no canopy' END
  AS has_canopy FROM taxa GROUP BY 1"""))
def canopy_by_study(spark, folder):
    return climate.group_any(s.taxa(spark, folder), "Study", "Species", ["small ring", "red widget", "blue bolt"])


@query("mean_within_year_sd", with_ctes("series", f"""
, annual AS (SELECT cell, "Year", stddev_samp("tempC") AS sd FROM series GROUP BY 1, 2)
SELECT cell, {r("avg(sd)", "avg_sd_tempC")} FROM annual GROUP BY 1"""))
def mean_within_year_sd(spark, folder):
    annual = climate.annual_summary(s.series(spark, folder), ["cell", "Year"])
    return rounded(climate.mean_within_year_sd(annual, ["cell"]))


@query("cell_month_stats", f"""
SELECT user_id AS cell, CAST(month(ts) AS INTEGER) AS month, {r("quantile_cont(value, 0.9)", "p90")}, {r("avg(value)", "mean")}
FROM events GROUP BY 1, 2""")
def cell_month_stats(spark, folder):
    steps = table(spark, folder, "events").select(F.col("user_id").alias("cell"), F.month("ts").alias("month"), "value")
    return rounded(climate.cell_month_stats(steps, ["cell", "month"]))


@query("group_counts", with_ctes("survey", """
SELECT "REALM", count(*) AS n, count(DISTINCT "SiteName") AS n_sites, count(DISTINCT "Study") AS n_studies FROM survey GROUP BY 1"""))
def group_counts(spark, folder):
    return s.survey(spark, folder).groupBy("REALM").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("SiteName").alias("n_sites"),
        F.count_distinct("Study").alias("n_studies"))


_BIN = "CAST(greatest(least(ceil((value - lo) * {n} / (hi - lo)), {n}), 1) AS INTEGER)"


@query("histogram", f"""
WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT {_BIN.format(n=50)} AS bin, {r("any_value(lo + (hi - lo) / 50 * (" + _BIN.format(n=50) + " - 1))", "bin_low")}, count(*) AS n
FROM events CROSS JOIN l GROUP BY 1""")
def histogram(spark, folder):
    return rounded(climate.histogram(table(spark, folder, "events"), "value", 50))


@query("equal_width_bins", f"""
WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, {_BIN.format(n=4)} AS bin FROM events CROSS JOIN l""")
def equal_width_bins(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    limits = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return with_one_row(events, limits).select(
        "event_id", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), 4).alias("bin"))


@query("totals_with_error", f"""
SELECT 'l_quantity' AS quantity, {r("sum(l_quantity)", "total", 3)}, {r("sqrt(count(l_quantity) * var_samp(l_quantity))", "se")} FROM lineitem
UNION ALL SELECT 'l_tax', {r("sum(l_tax)", "total", 3)}, {r("sqrt(count(l_tax) * var_samp(l_tax))", "se")} FROM lineitem""")
def totals_with_error(spark, folder):
    return rounded(climate.totals(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"]), total=3)


# ---------------------------------------------------------------- waves

@query("annual_extremes", with_ctes("wave_annual wave_coords", f"""
SELECT "Year", {rs("GOWLon GOWLat")}, {r("max_sum_wave_energy", "max_sum_wave_energy", 2)},
  {r("total_wave_energy", "total_wave_energy", 2)}, {r("sd_sum_wave_energy", "sd_sum_wave_energy", 2)}
FROM wave_annual w JOIN wave_coords c ON w.nk = c.nk"""))
def annual_extremes(spark, folder):
    facts = s.wave_facts(s.wave_lines(spark, folder), month=True)
    monthly = read_wave_sheet(s.wave_sheet(facts, "sum_energy", True), s.wave_coords(spark, folder), True)
    return rounded(waves.annual_extremes(monthly, "sum_wave_energy", total="total_wave_energy"), 2, GOWLon=6, GOWLat=6)


def wave_table(spark, folder):
    """All wave measures at the original points."""
    lines, coords = s.wave_lines(spark, folder), s.wave_coords(spark, folder)
    years, months = s.wave_facts(lines), s.wave_facts(lines, month=True)
    sheets = [read_wave_sheet(s.wave_sheet(years, m), coords) for m in ("mean_energy", "mean_height", "q95_height")]
    sheets += [read_wave_sheet(s.wave_sheet(months, m, True), coords, True) for m in ("mean_energy", "sum_energy", "max_height")]
    return waves.wave_frame(*sheets, s.wave_points(spark, folder))


_WAVE_COLS = ["mean_wave_energy", "mean_wave_height", "max_mean_wave_energy", "sd_mean_wave_energy",
              "max_sum_wave_energy", "total_wave_energy", "sd_sum_wave_energy", "max_wave_height",
              "sd_max_wave_height", "q95_wave_height"]


@query("wave_frame", with_ctes("wave_frame", f"""
SELECT "Year", {rs("Latitude Longitude LonGOW LatGOW " + " ".join(_WAVE_COLS), 2)} FROM wave_frame"""))
def wave_frame(spark, folder):
    return rounded(wave_table(spark, folder).select("Latitude", "Longitude", "LonGOW", "LatGOW", "Year", *_WAVE_COLS), 2)


# ---------------------------------------------------------------- observation deviations

@query("temperature_deviation", with_ctes("survey series province_series ecoregion_series", f"""
, a AS (SELECT cell, "Year", {_STRESS} FROM series WHERE "Year" BETWEEN {LO} AND {HI} GROUP BY 1, 2)
, b AS (SELECT cell, {_season("site")}, avg("tempC") AS raw_site FROM series WHERE "Year" BETWEEN {LO} AND {HI} GROUP BY 1)
, raw AS (SELECT cell, "Year", avg("tempC") AS raw_mean FROM series GROUP BY 1, 2)
, e AS (SELECT "ECOREGION", {_season("ecoregion")} FROM ecoregion_series WHERE "Year" BETWEEN {LO} AND {HI} GROUP BY 1)
, p AS (SELECT "PROVINCE", {_season("province")} FROM province_series WHERE "Year" BETWEEN {LO} AND {HI} GROUP BY 1)
, m AS (SELECT "REALM", {_season("realm")} FROM province_series WHERE "Year" BETWEEN {LO} AND {HI} GROUP BY 1)
SELECT obs_id, mean_temp, stress_count, stress_count_march_may, stress_count_june_august, mean_temp_site,
  march_may_temp_site, mean_temp_ecoregion, mean_temp_province, mean_temp_realm, june_aug_temp_realm,
  {r("raw_mean - raw_site", "mean_temp_dev")}
FROM survey s LEFT JOIN a ON s.cell = a.cell AND s."Year" = a."Year" LEFT JOIN raw ON s.cell = raw.cell AND s."Year" = raw."Year"
LEFT JOIN b ON s.cell = b.cell LEFT JOIN e ON s."ECOREGION" = e."ECOREGION" LEFT JOIN p ON s."PROVINCE" = p."PROVINCE"
LEFT JOIN m ON s."REALM" = m."REALM" WHERE s."Year" BETWEEN {LO} AND {HI}"""))
def temperature_deviation(spark, folder):
    out = _with_temperature(spark, folder)
    return rounded(out.select(
        "obs_id", "mean_temp", "stress_count", "stress_count_march_may", "stress_count_june_august", "mean_temp_site",
        "march_may_temp_site", "mean_temp_ecoregion", "mean_temp_province", "mean_temp_realm", "june_aug_temp_realm",
        "mean_temp_dev"))


def _with_temperature(spark, folder):
    regions = {level: s.region_series(spark, folder, level) for level in ("ECOREGION", "PROVINCE", "REALM")}
    return deviations.with_temperature(s.survey(spark, folder), s.series(spark, folder), regions, ["cell"], s.WINDOW)


_DEV_SQL = f"""
, w AS (SELECT * FROM wave_frame WHERE "Year" BETWEEN {LO} AND {HI})
, ws AS (SELECT "Latitude", "Longitude", avg(mean_wave_energy) AS me, avg(max_wave_height) AS mh FROM w GROUP BY 1, 2)
, dev AS (SELECT s.*, w.mean_wave_energy - ws.me AS mean_wave_energy_dev, w.max_wave_height - ws.mh AS max_wave_height_dev,
   ws.me AS mean_wave_energy_site
  FROM survey s LEFT JOIN w ON s."Latitude" = w."Latitude" AND s."Longitude" = w."Longitude" AND s."Year" = w."Year"
  LEFT JOIN ws ON s."Latitude" = ws."Latitude" AND s."Longitude" = ws."Longitude" WHERE s."Year" BETWEEN {LO} AND {HI})"""


def _with_waves(spark, folder):
    from ..operators.filters import study_window

    survey = study_window(s.survey(spark, folder), *s.WINDOW)
    return deviations.with_waves(survey, wave_table(spark, folder), waves.WAVE_MEASURES, s.WINDOW)


@query("wave_deviation", with_ctes("survey wave_frame", f"""{_DEV_SQL}
SELECT obs_id, {rs("mean_wave_energy_site mean_wave_energy_dev max_wave_height_dev", 3)} FROM dev"""))
def wave_deviation(spark, folder):
    return rounded(_with_waves(spark, folder).select(
        "obs_id", "mean_wave_energy_site", "mean_wave_energy_dev", "max_wave_height_dev"), 3)


@query("analysis_rows", with_ctes("survey wave_frame", f"""{_DEV_SQL}
, c AS (SELECT * FROM dev WHERE mean_wave_energy_dev IS NOT NULL)
, n AS (SELECT *, count(*) OVER (PARTITION BY "Study", "Site") AS n_per_site FROM c)
, k AS (SELECT * FROM n WHERE n_per_site > 1)
, g AS (SELECT "ECOREGION", count(DISTINCT "Site") AS sites_per_ecoregion FROM k GROUP BY 1)
SELECT obs_id, n_per_site, sites_per_ecoregion, {r("mean_wave_energy_dev", "mean_wave_energy_dev", 3)}
FROM k JOIN g ON k."ECOREGION" = g."ECOREGION" WHERE sites_per_ecoregion > 5"""))
def analysis_rows(spark, folder):
    from ..operators.filters import study_window

    survey = study_window(s.survey(spark, folder), *s.WINDOW).select(
        "obs_id", "Study", "Site", "ECOREGION", "Year", "Latitude", "Longitude")
    kept = deviations.wave_analysis_rows(survey, wave_table(spark, folder), waves.WAVE_MEASURES, s.WINDOW, min_rows=1)
    return rounded(kept.select("obs_id", "n_per_site", "sites_per_ecoregion", "mean_wave_energy_dev"), 3)


@query("deviation_columns", f"""
WITH m AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, {r("l_quantity - q", "l_quantity_dev", 8)}, {r("l_discount - d", "l_discount_dev", 8)}
FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey""")
def deviation_columns(spark, folder):
    cols = ["l_quantity", "l_discount"]
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *cols)
    joined = natural_join(lineitem, climate.site_means(lineitem, ["l_suppkey"], cols), ["l_suppkey"], "left")
    return rounded(climate.anomaly(joined, cols).select("l_orderkey", "l_linenumber", "l_quantity_dev", "l_discount_dev"), 8)


# ---------------------------------------------------------------- per-group facts on rows

@query("year_range", with_ctes("survey", """
SELECT obs_id, concat_ws('-', min("Year") OVER w, max("Year") OVER w) AS "YearRange" FROM survey
WINDOW w AS (PARTITION BY "SiteName")"""))
def year_range(spark, folder):
    return rows.year_range(s.survey(spark, folder).select("obs_id", "SiteName", "Year")).select("obs_id", "YearRange")


@query("min_obs", with_ctes("survey", """
SELECT obs_id, n_per_site FROM (SELECT obs_id, count(*) OVER (PARTITION BY "Study", "Site") AS n_per_site FROM survey)
WHERE n_per_site > 2"""))
def min_obs(spark, folder):
    return rows.min_obs(s.survey(spark, folder), ["Study", "Site"]).select("obs_id", "n_per_site")


@query("min_members", with_ctes("survey", """
SELECT obs_id, sites_per_ecoregion FROM survey s JOIN
 (SELECT "ECOREGION", count(DISTINCT "Site") AS sites_per_ecoregion FROM survey GROUP BY 1) g ON s."ECOREGION" = g."ECOREGION"
WHERE sites_per_ecoregion > 11"""))
def min_members(spark, folder):
    kept = rows.min_members(s.survey(spark, folder), "ECOREGION", "Site", more_than=11)
    return kept.select("obs_id", "sites_per_ecoregion")


@query("missing_flag", """
SELECT d.doc_id, count(*) FILTER (quality IS NULL) OVER (PARTITION BY lang, source)
   > count(*) OVER (PARTITION BY lang, source) - 30 AS "isBad"
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def missing_flag(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labelled = natural_join(docs, table(spark, folder, "labels"), ["doc_id"], "left")
    return rows.missing_flag(labelled, ["lang", "source"], "quality", need=30).select("doc_id", "isBad")


@query("zscore", f"""
SELECT c_custkey, {r("(c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ()", "c_acctbal_scale")},
  {r("c_nationkey::DOUBLE / stddev_samp(c_acctbal) OVER ()", "c_nationkey_scale")} FROM customer""")
def zscore(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double"))
    out = rows.zscore(customer, ["c_acctbal"], errors={"c_acctbal": "c_nationkey"})
    return rounded(out.select("c_custkey", "c_acctbal_scale", "c_nationkey_scale"))


@query("zscore_by_group", f"""
SELECT l_orderkey, l_linenumber, {r("(l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w", "l_quantity_scale")}
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def zscore_by_group(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    out = rows.zscore(lineitem, ["l_quantity"], by=["l_returnflag"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity_scale"))


@query("center_and_unscale", f"""
SELECT c_custkey, {r("c_acctbal - avg(c_acctbal) OVER ()", "c_acctbal_c", 4)}, {r("c_acctbal", "c_acctbal", 4)} FROM customer""")
def center_and_unscale(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    stats = rows.scale_stats(customer, ["c_acctbal"])
    scaled = rows.zscore(rows.center(customer, ["c_acctbal"]), ["c_acctbal"]).drop("c_acctbal")
    return rounded(rows.unscale(scaled, ["c_acctbal"], stats).select("c_custkey", "c_acctbal_c", "c_acctbal"), 4)


@query("factor_index", with_ctes("survey", """
SELECT obs_id, dense_rank() OVER (ORDER BY "Site") AS site_num, dense_rank() OVER (ORDER BY "Study") - 1 AS study_code
FROM survey"""))
def factor_index(spark, folder):
    survey = s.survey(spark, folder).select("obs_id", "Site", "Study")
    out = rows.factor_index(rows.factor_index(survey, "Site", "site_num"), "Study", "study_num")
    return out.select("obs_id", "site_num", (F.col("study_num") - 1).alias("study_code"))


@query("point_groups", with_ctes("points", """
SELECT "Latitude", "Longitude", row_number() OVER (ORDER BY "Latitude", "Longitude") AS pointgroup
FROM (SELECT DISTINCT "Latitude", "Longitude" FROM points)"""))
def point_groups(spark, folder):
    return rows.point_groups(s.points(spark, folder), ["Latitude", "Longitude"])


@query("offset_log", f"""
SELECT l_orderkey, l_linenumber, {r("ln(l_tax + 0.001)", "log_y")} FROM lineitem""")
def offset_log(spark, folder):
    return rounded(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.log(offset(F.col("l_tax"))).alias("log_y")))


# ---------------------------------------------------------------- adequacy and the model frame

@query("years_subset", with_ctes("survey", """
, good AS (SELECT "Study", "Site" FROM survey WHERE "Year" >= 1996 AND "Year" < 2000 GROUP BY 1, 2
  HAVING count(*) >= 3 AND count(DISTINCT "Year") >= 2)
SELECT obs_id FROM survey WHERE "Site" IN (SELECT "Site" FROM good)"""))
def years_subset(spark, folder):
    kept = adequacy.years_subset(s.survey(spark, folder), 3, 2, 1996, 2000, study="Study", site="Site")
    return kept.select("obs_id")


@query("min_sites_subset", with_ctes("survey", """
SELECT obs_id FROM survey WHERE "ECOREGION" IN (SELECT "ECOREGION" FROM survey GROUP BY 1 HAVING count(DISTINCT "SiteName") >= 60)"""))
def min_sites_subset(spark, folder):
    return adequacy.min_sites_subset(s.survey(spark, folder), "ECOREGION", 60).select("obs_id")


def _frame(spark, folder):
    survey = adequacy.regroup(s.survey(spark, folder), "PROVINCE")
    return adequacy.model_frame(survey.select("obs_id", "group_name", "Site", "Study", "Year", "focalUnit"), "Site", "Study")


_FRAME_SQL = """
, f AS (SELECT obs_id, dense_rank() OVER (ORDER BY "PROVINCE") AS group_num, dense_rank() OVER (ORDER BY "Study") AS study_num,
  dense_rank() OVER (ORDER BY concat_ws(':', "Site", "Study")) AS site_num, "Year" - avg("Year") OVER () AS yc, "focalUnit" FROM survey)"""


@query("model_frame", with_ctes("survey", f"""{_FRAME_SQL}
, a AS (SELECT group_num, count(DISTINCT study_num) AS "N_studies" FROM f GROUP BY 1)
, b AS (SELECT study_num, count(DISTINCT site_num) AS "N_sites" FROM f GROUP BY 1)
SELECT obs_id, f.group_num, f.study_num, site_num, {r("yc", "Year_centered")}, "N_studies", "N_sites"
FROM f JOIN a ON f.group_num = a.group_num JOIN b ON f.study_num = b.study_num"""))
def model_frame(spark, folder):
    return rounded(_frame(spark, folder).select(
        "obs_id", "group_num", "study_num", "site_num", "Year_centered", "N_studies", "N_sites"))


@query("model_frame_counts", with_ctes("survey", f"""{_FRAME_SQL}
SELECT count(DISTINCT group_num) AS "NG", count(DISTINCT site_num) AS "NSI",
  (SELECT count(*) FROM (SELECT DISTINCT "focalUnit", study_num FROM f)) AS "NST",
  count(DISTINCT "focalUnit") AS "NM", count(*) AS "N" FROM f"""))
def model_frame_counts(spark, folder):
    return adequacy.frame_counts(_frame(spark, folder), "focalUnit")


@query("regroup_levels", with_ctes("survey", """
SELECT group_name, count(DISTINCT "SiteName") AS n_sites FROM (
  SELECT "REALM" AS group_name, "SiteName" FROM survey UNION ALL SELECT "PROVINCE", "SiteName" FROM survey
  UNION ALL SELECT "ECOREGION", "SiteName" FROM survey UNION ALL SELECT 'World', "SiteName" FROM survey) GROUP BY 1"""))
def regroup_levels(spark, folder):
    survey = s.survey(spark, folder)
    out = None
    for level in ("REALM", "PROVINCE", "ECOREGION", "World"):
        part = adequacy.regroup(survey, level).groupBy("group_name").agg(F.count_distinct("SiteName").alias("n_sites"))
        out = part if out is None else out.unionByName(part)
    return out
