"""Whole paths as plans, and reads of what this library has written."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import labels, scalars
from ..operators import climate, regression
from ..operators.materialize import shared_folder
from ..operators.waves import WAVE_MEASURES
from ..sources import tables
from . import deviations, site_trends, standins as s
from .catalog import query, r, rounded, rs
from .queries_trend import _ANNUAL, _TEMP, _paired_sql, _signed_log, _slots, _sql_rewrite, _survey_by_site, _survey_waves
from .standins import table, with_ctes

_SHOWN = ["max_wave_height", "mean_wave_energy"]


@query("site_trends_with_waves", with_ctes("survey series wave_frame prior_slopes", _ANNUAL + f"""
, merged AS (SELECT s."Site" AS "SiteName", s."Year", mean_tempC, max_tempC FROM survey s
  LEFT JOIN annual a ON s.cell = a.cell AND s."Year" = a."Year")
, tr AS ({_paired_sql(_TEMP, "merged", '"SiteName"')})
, sw AS (SELECT s."Site" AS "SiteName", s."Latitude", s."Longitude", s."Year", {", ".join(WAVE_MEASURES)} FROM survey s
  JOIN wave_frame w ON s."Latitude" = w."Latitude" AND s."Longitude" = w."Longitude" AND s."Year" = w."Year"
  WHERE total_wave_energy IS NOT NULL)
, wv AS (SELECT "SiteName", {_slots(_SHOWN)} FROM sw GROUP BY "SiteName", "Latitude", "Longitude")
SELECT p."SiteName", {rs("mean se", 7)}, tr.* EXCLUDE ("SiteName"), wv.* EXCLUDE ("SiteName") FROM prior_slopes p
LEFT JOIN tr ON p."SiteName" = tr."SiteName" LEFT JOIN wv ON p."SiteName" = wv."SiteName" WHERE parameter = 'site_slope'"""))
def site_trends_with_waves(spark, folder):
    """Path 1 to its end: prior slopes, temperature trends and wave trends of each site."""
    temperature = site_trends.temperature_trends(_survey_by_site(spark, folder), s.series(spark, folder), ["cell"])
    waves = site_trends.wave_trends(_survey_waves(spark, folder), WAVE_MEASURES)
    out = site_trends.merged_site_trends(s.prior_slopes(spark, folder), temperature, waves)
    ends = ("estimate", "std.error")
    return rounded(out.select(
        "SiteName", "mean", "se", *[F.col(f"`{p}_{c}`") for p in _TEMP for c in ends],
        *[_signed_log(f"{v}_{c}") for v in _SHOWN for c in ends]
    ), 7, **{f"{v}_std.error": 5 for v in _SHOWN})


_RAW_STUDY = """'KelpAbundance_Brand et al. ' || (1 + cell % 7)"""


@query("canopy_analysis_rows", with_ctes("survey taxa", f"""
, canopy AS (SELECT {_sql_rewrite('"Study"', labels.TAXA_STUDY_RULES)} AS "Study",
  CASE WHEN bool_or("Species" LIKE 'small%') THEN 'canopy' ELSE 'no canopy' END AS has_canopy FROM taxa GROUP BY 1)
, named AS (SELECT obs_id, "Site", "ECOREGION", "Longitude", "Latitude", y, {_sql_rewrite(_RAW_STUDY, labels.TAXA_STUDY_RULES)} AS "Study" FROM survey)
, boxed AS (SELECT n.*, CASE WHEN "Longitude" > 100 AND "Longitude" < 160 AND "Latitude" > -39.3 AND "Latitude" < 50 THEN 'no canopy'
  WHEN "Latitude" < 0 AND "Longitude" > 0 AND "Longitude" < 40 THEN 'canopy'
  WHEN "Longitude" > -10 AND "Longitude" < 0 AND "Latitude" > 40 AND "Latitude" < 50 THEN 'no canopy'
  ELSE has_canopy END AS label FROM named n LEFT JOIN canopy c ON n."Study" = c."Study")
, enough AS (SELECT *, count(*) OVER (PARTITION BY "Study", "Site") AS n_per_site FROM boxed QUALIFY n_per_site > 2)
, sites AS (SELECT "ECOREGION", count(DISTINCT "Site") AS k FROM enough GROUP BY 1)
SELECT obs_id, e."Study", e."ECOREGION", label AS has_canopy, n_per_site, k AS sites_per_ecoregion
FROM enough e JOIN sites t ON e."ECOREGION" = t."ECOREGION" WHERE k > 5"""))
def canopy_analysis_rows(spark, folder):
    """Path 2's labels: study names cleaned, canopy joined, boxes applied, thin sites and regions left out.

    The stand-in's studies are made from the survey's cells, so that most but not all have a
    canopy entry.
    """
    taxa = s.taxa(spark, folder)
    cleaned = taxa.withColumn("Study", labels.rewrite(F.col("Study"), labels.TAXA_STUDY_RULES)).withColumn(
        "_small", F.when(F.col("Species").startswith("small"), "small").otherwise("other"))
    canopy = climate.group_any(cleaned, "Study", "_small", ["small"])
    raw = F.concat(F.lit("KelpAbundance_Brand et al. "), (1 + F.col("cell") % 7).cast("string"))
    named = s.survey(spark, folder).withColumn("Study", labels.rewrite(raw, labels.TAXA_STUDY_RULES))
    labelled = deviations.with_canopy(named, canopy)
    rows = deviations.analysis_rows(labelled, needed="y", min_rows=2, min_sites=5)
    return rows.select("obs_id", "Study", "ECOREGION", "has_canopy", "n_per_site", "sites_per_ecoregion")


@query("bins_of_the_data", """
WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal > lo AND c_acctbal <= 0 THEN printf('%.3g', lo) || ' - 0'
  WHEN c_acctbal > 0 AND c_acctbal <= hi THEN '0 - ' || printf('%.3g', hi) END AS bin FROM customer, e""")
def bins_of_the_data(spark, folder):
    """Bins between the least value, zero and the greatest value."""
    return scalars.data_cut(table(spark, folder, "customer"), "c_acctbal", [0.0], "bin").select("c_custkey", "bin")


@query("ols_with_factor", f"""
WITH g AS (SELECT l_returnflag, avg(l_discount) AS mx, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem GROUP BY 1)
, d AS (SELECT l_discount - mx AS dx, l_extendedprice - my AS dy FROM lineitem JOIN g USING (l_returnflag))
, b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx,
    (sum(dy * dy) - sum(dx * dy) * sum(dx * dy) / sum(dx * dx)) / (count(*) - 1 - (SELECT count(*) FROM g)) AS s2 FROM d)
, c AS (SELECT 'l_discount' AS term, b AS est, sqrt(s2 / sxx) AS se FROM b
  UNION ALL SELECT 'l_returnflag_' || l_returnflag, my - b * mx, sqrt(s2 * (1.0::DOUBLE / n + mx * mx / sxx)) FROM g, b)
SELECT term, {r("est", "estimate", 3)}, {r("se", "std.error", 3)}, {r("est / se", "statistic", 5)},
  {r("CASE WHEN abs(est / se) > 6 THEN 0 ELSE greatest(0, 1 - 2 * exp(-pow(est / se, 2) / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(abs(est / se)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) for k in range(0, 160)])) END", "p", 1)} FROM c""")
def ols_with_factor(spark, folder):
    """A factor beside a number, without intercept: every level has its own term, error and p.

    p is shown to one digit: with thousands of degrees of freedom the SQL takes the normal tail.
    """
    lineitem = table(spark, folder, "lineitem").select("l_extendedprice", "l_discount", "l_returnflag")
    model = regression.multi_ols(lineitem, "l_extendedprice ~ l_discount + l_returnflag - 1")
    terms = regression.coefficients(model, lineitem).withColumnRenamed("p.value", "p")
    return rounded(terms.select("term", "estimate", "`std.error`", "statistic", "p"), 3, statistic=5, p=1)


@query("wave_sheet_from_file", with_ctes("wave_lines wave_coords", f"""
SELECT m."Year", m."Month", {rs("GOWLon GOWLat", 4)}, {r("max(height)", "measurement", 4)}
FROM (SELECT DISTINCT "Year", "Month" FROM wave_lines) m CROSS JOIN wave_coords c
LEFT JOIN wave_lines w ON w."Year" = m."Year" AND w."Month" = m."Month" AND w.nk = c.nk GROUP BY 1, 2, 3, 4"""))
def wave_sheet_from_file(spark, folder):
    """A monthly sheet written as a headerless CSV file and read from it, its columns matched by position."""
    sheet = s.wave_sheet(s.wave_facts(s.wave_lines(spark, folder), month=True), "max_height", month=True)
    path = shared_folder(spark)
    sheet.write.option("header", False).option("nullValue", "NA").csv(path)
    return rounded(tables.read_wave_file(spark, path, s.wave_coords(spark, folder), month=True), 4)


_CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])


@query("csv_with_missing", """
SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment
FROM customer""")
def csv_with_missing(spark, folder):
    """A CSV table with NA for missing values, written and read with its schema."""
    kept = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment"))
    path = f"{shared_folder(spark)}.csv"
    tables.write_table(kept, path)
    return tables.read_table(spark, path, _CUSTOMER)


@query("partitioned_grid_read", with_ctes("grid", f"""
SELECT cell, date, {r("nullif(value, -1000)", "value")} FROM grid WHERE year(date) BETWEEN 1996 AND 1999"""))
def partitioned_grid_read(spark, folder):
    """The grid written by year; only the asked years' folders are read."""
    path = shared_folder(spark)
    grid = s.grid(spark, folder).withColumn("year", F.year("date"))
    tables.write_table(grid, path, partition_by=["year"])
    return rounded(tables.read_grid(spark, path, 1996, 1999).select("cell", "date", "value"))


@query("month_from_file_path", """
SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS month FROM orders""")
def month_from_file_path(spark, folder):
    """The month that stands in the path of the file that a row was read from."""
    path = shared_folder(spark)
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.lit("multi_1.glo_30m.hs."), F.date_format("o_orderdate", "yyyyMM")).alias("name"))
    tables.write_table(orders, path, partition_by=["name"])
    return spark.read.parquet(path).select("o_orderkey", tables.file_month(F.col("_metadata.file_path")).alias("month"))
