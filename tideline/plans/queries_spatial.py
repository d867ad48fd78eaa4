"""Queries of grid cells, extraction, nearest valid cells and neighbor fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..sources.tables import clean_grid
from . import standins as s
from .catalog import query, r, rounded, rs
from .standins import with_ctes


@query("cell_numbers", with_ctes("points", """
SELECT c_custkey, CAST(least(floor(90 - "Latitude"), 179) * 360 + least(floor("Longitude" + 180), 359) + 1 AS BIGINT) AS cell FROM points"""))
def cell_numbers(spark, folder):
    return s.points(spark, folder).select("c_custkey", spatial.cell_of(F.col("Longitude"), F.col("Latitude")).alias("cell"))


_VALID = """, v AS (SELECT DISTINCT g.cell, cell_lon, cell_lat FROM grid g JOIN grid_cells c ON g.cell = c.cell
  WHERE date = DATE '1996-01-01' AND value <> -1000)"""
_KM = """2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians(cell_lat - "Latitude") / 2), 2)
  + cos(radians("Latitude")) * cos(radians(cell_lat)) * pow(sin(radians(cell_lon - "Longitude") / 2), 2))))"""


def valid_cells(spark, folder):
    """Cells with a value in the layer that decides validity."""
    layer = clean_grid(s.grid(spark, folder), 1996, 1996).where(F.col("value").isNotNull()).select("cell")
    lon, lat = spatial.cell_center(F.col("cell"))
    return layer.select("cell", lon.alias("cell_lon"), lat.alias("cell_lat"))


@query("nearest_valid_cell", with_ctes("points grid grid_cells", f"""{_VALID}
, p AS (SELECT DISTINCT "Latitude", "Longitude" FROM points)
, d AS (SELECT "Longitude", "Latitude", cell, round({_KM}, 6) AS km FROM p CROSS JOIN v)
, k AS (SELECT *, row_number() OVER (PARTITION BY "Longitude", "Latitude" ORDER BY km, cell) AS rn FROM d)
SELECT {rs("Longitude Latitude")}, cell AS non_na_cell, {r("km", "km", 6)} FROM k WHERE rn = 1"""))
def nearest_valid_cell(spark, folder):
    found = spatial.nearest_valid_cell(s.points(spark, folder), valid_cells(spark, folder))
    return rounded(found)


@query("extract_at_points", with_ctes("points grid", f"""
, q AS (SELECT c_custkey, CAST(least(floor(90 - "Latitude"), 179) * 360 + least(floor("Longitude" + 180), 359) + 1 AS BIGINT) AS cell FROM points)
SELECT c_custkey, q.cell, date, {r("nullif(value, -1000)", "value")} FROM q LEFT JOIN grid g ON q.cell = g.cell"""))
def extract_at_points(spark, folder):
    points = s.points(spark, folder).select(
        "c_custkey", spatial.cell_of(F.col("Longitude"), F.col("Latitude")).alias("cell"))
    return rounded(spatial.extract_at_points(points, clean_grid(s.grid(spark, folder), 1900, 2100)))


@query("neighbor_fill", with_ctes("grid grid_cells", f"""
, g AS (SELECT cell, date, nullif(value, -1000) AS value FROM grid)
, w AS (SELECT DISTINCT cell FROM grid_cells)
, ok AS (SELECT cell FROM g WHERE date = (SELECT min(date) FROM g) AND value IS NOT NULL)
, miss AS (SELECT cell, (cell - 1) // 360 AS rw, (cell - 1) % 360 AS cl FROM w WHERE cell NOT IN (SELECT cell FROM ok))
, nb AS (SELECT cell AS home, (rw + i) * 360 + (cl + j + 360) % 360 + 1 AS cell FROM miss
   CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) WHERE rw + i BETWEEN 0 AND 179)
SELECT cell, date, {r("value", "value")} FROM g WHERE cell IN (SELECT cell FROM ok)
UNION ALL SELECT home, date, round(avg(value) FILTER (home <> g.cell), 6) FROM nb JOIN g ON nb.cell = g.cell GROUP BY home, date"""))
def neighbor_fill(spark, folder):
    cells = s.grid_cells(spark, folder).select(spatial.cell_of(F.col("cell_lon"), F.col("cell_lat")).alias("cell"))
    return rounded(spatial.neighbor_fill(cells, clean_grid(s.grid(spark, folder), 1900, 2100)))


@query("mean_and_max_epochs", with_ctes("survey series", f"""
, f AS (SELECT s."Latitude", s."Longitude", date_trunc('month', a."DateName")::DATE AS "DateName", a."tempC" FROM (SELECT DISTINCT cell, "Latitude", "Longitude" FROM survey) s
   JOIN series a ON s.cell = a.cell)
SELECT {rs("Latitude Longitude")}, "DateName", {r('avg("tempC")', "meanWaves")}, max("tempC") AS "maxWaves" FROM f GROUP BY "Latitude", "Longitude", "DateName" """))
def mean_and_max_epochs(spark, folder):
    places = s.survey(spark, folder).select("cell", "Latitude", "Longitude").distinct()
    monthly = s.series(spark, folder).withColumn("DateName", F.trunc("DateName", "month"))
    at = places.join(monthly, "cell").groupBy("Latitude", "Longitude", "DateName").agg(
        F.avg("tempC").alias("meanWaves"), F.max("tempC").alias("maxWaves"))
    early, late = at.where("DateName < DATE'1998-06-01'"), at.where("DateName >= DATE'1998-06-01'")
    joined = spatial.join_mean_max([early.drop("maxWaves"), late.drop("maxWaves")], [early.drop("meanWaves"), late.drop("meanWaves")])
    return rounded(joined)


@query("cells_not_extracted", with_ctes("points grid_cells", """
SELECT DISTINCT CAST(least(floor(90 - "Latitude"), 179) * 360 + least(floor("Longitude" + 180), 359) + 1 AS BIGINT) AS cell FROM points
EXCEPT SELECT cell FROM grid_cells"""))
def cells_not_extracted(spark, folder):
    wanted = s.points(spark, folder).select(spatial.cell_of(F.col("Longitude"), F.col("Latitude")).alias("cell"))
    have = s.grid_cells(spark, folder).select(spatial.cell_of(F.col("cell_lon"), F.col("cell_lat")).alias("cell"))
    return spatial.cells_not_extracted(wanted, have)


@query("points_in_extent", with_ctes("points", """
SELECT c_custkey, "Longitude", "Latitude" FROM points WHERE "Longitude" BETWEEN -20 AND 40 AND "Latitude" BETWEEN 10 AND 65"""))
def points_in_extent(spark, folder):
    return spatial.in_extent(s.points(spark, folder), -20, 40, 10, 65).select("c_custkey", "Longitude", "Latitude")
