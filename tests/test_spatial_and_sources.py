"""Cells, nearest valid cells and neighbor fill; reading and writing tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import reshape, spatial
from tideline.sources import tables

D1, D2 = dt.date(1990, 1, 1), dt.date(1990, 2, 1)


def test_cell_numbers(spark):
    pts = [(-180.0, 90.0, 1), (180.0, 90.0, 360), (-180.0, -90.0, 179 * 360 + 1), (0.5, 0.5, 89 * 360 + 181), (181.0, 0.0, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pts], "lon double, lat double")
    got = [r[0] for r in df.select(spatial.cell_of(F.col("lon"), F.col("lat"))).collect()]
    assert got == [c for *_, c in pts]
    lon, lat = spatial.cell_center(F.lit(89 * 360 + 181))
    assert tuple(spark.range(1).select(lon, lat).first()) == (0.5, 0.5)


def km(a, b):
    (x1, y1), (x2, y2) = np.radians(a), np.radians(b)
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("n_cells", [1, 4, 60, 1500])
def test_nearest_cell_against_brute_force(spark, n_cells):
    rng = np.random.default_rng(n_cells)
    cells = sorted({int(c) for c in rng.integers(1, 64801, n_cells)})
    center = {c: ((c - 1) % 360 - 179.5, 90 - ((c - 1) // 360 + 0.5)) for c in cells}
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60))]
    pts += [(179.9, 10.0), (-179.9, 10.0), (30.0, 89.9), (0.0, -90.0), (0.0, 0.0)]
    found = spatial.nearest_valid_cell(
        spark.createDataFrame(pts + pts[:3], "Longitude double, Latitude double"),
        spark.createDataFrame([(c, *center[c]) for c in cells], "cell bigint, cell_lon double, cell_lat double"))
    out = {(r["Longitude"], r["Latitude"]): r for r in found.collect()}
    assert len(out) == len(pts)
    for p in pts:
        want = min((round(km(p, center[c]), 6), c) for c in cells)
        assert out[p]["km"] == pytest.approx(want[0], abs=2e-6)
        assert abs(km(p, center[out[p]["non_na_cell"]]) - want[0]) < 2e-6


def test_nearest_cell_tie_goes_to_the_lowest(spark):
    cells = spark.createDataFrame([(7, 1.5, 0.5), (3, -0.5, 0.5)], "cell bigint, cell_lon double, cell_lat double")
    pts = spark.createDataFrame([(0.5, 0.5)], "Longitude double, Latitude double")
    assert spatial.nearest_valid_cell(pts, cells).first()["non_na_cell"] == 3


def test_neighbor_fill(spark):
    center, edge = 1000, 360 * 5 + 1  # the second touches the date line
    around = [c for c in spark.range(1).select(spatial.neighbors(F.lit(center))).first()[0]]
    assert len(around) == 8
    wrap = spark.range(1).select(spatial.neighbors(F.lit(edge))).first()[0]
    assert edge + 359 in wrap and edge - 1 in wrap and len(wrap) == 8
    assert len(spark.range(1).select(spatial.neighbors(F.lit(5))).first()[0]) == 5
    grid = [(center, D1, None), (center, D2, 99.0), (40000, D1, None), (50000, D1, 7.0), (50000, D2, None)]
    grid += [(c, D1, float(i)) for i, c in enumerate(around)] + [(around[0], D2, 3.0), (around[1], D2, None)]
    df = spark.createDataFrame(grid, "cell bigint, date date, value double")
    cells = spark.createDataFrame([(center,), (40000,), (50000,), (center,)], "cell bigint")
    out = {(r["cell"], r["date"]): r["value"] for r in spatial.neighbor_fill(cells, df).collect()}
    assert out == {(center, D1): 3.5, (center, D2): 3.0, (40000, D1): None, (50000, D1): 7.0, (50000, D2): None}
    late = {(r["cell"], r["date"]): r["value"] for r in spatial.neighbor_fill(cells, df, judged_on=D2).collect()}
    assert late[(center, D2)] == 99.0 and late[(50000, D1)] is None


def test_extract_keeps_points_without_series(spark):
    points = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "p int, cell bigint")
    grid = spark.createDataFrame([(10, D1, 1.0), (11, D1, 2.0)], "cell bigint, date date, value double")
    out = sorted((r["p"], r["value"]) for r in spatial.extract_at_points(points, grid).collect() if r["value"] is not None)
    assert out == [(1, 1.0), (2, 1.0)] and spatial.extract_at_points(points, grid).count() == 3


def test_csv_round_trip_with_missing(spark, tmp_path):
    rows_ = [("a", "s", "a:s", 2000, 1.5, None, "t1"), ("b", None, "b", None, float("nan"), 2.0, "t2")]
    df = spark.createDataFrame(rows_, tables.SURVEY_SCHEMA)
    path = str(tmp_path / "survey.csv")
    tables.write_table(df, path)
    back = sorted(map(tuple, tables.read_table(spark, path, tables.SURVEY_SCHEMA).collect()))
    assert back == [("a", "s", "a:s", 2000, 1.5, None, "t1"), ("b", None, "b", None, None, 2.0, "t2")]
    with pytest.raises(ValueError):
        tables.read_table(spark, path)


def test_grid_read_prunes_years_and_drops_the_sentinel(spark, tmp_path):
    grid = spark.createDataFrame(
        [(1, dt.date(1949, 1, 1), 1.0), (1, dt.date(1950, 1, 1), -1000.0), (1, dt.date(2015, 1, 1), 3.0)],
        "cell bigint, date date, value double").withColumn("year", F.year("date"))
    path = str(tmp_path / "grid")
    tables.write_table(grid, path, partition_by=["year"])
    read = tables.read_grid(spark, path)
    assert sorted((r["year"], r["value"]) for r in read.collect()) == [(1950, None), (2015, 3.0)]
    assert "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().executedPlan().toString()


def test_file_months(spark):
    names = [("x/nww3.hs.199702.grb",), ("multi_1.glo_30m.hs.200612.grb2",), ("other.txt",), ("nww3.hs.199713.grb",)]
    out = [r[0] for r in spark.createDataFrame(names, "f string").select(tables.file_month(F.col("f"))).collect()]
    assert out == [dt.date(1997, 2, 1), dt.date(2006, 12, 1), None, None]


def test_wave_sheet_with_repeated_coordinates(spark):
    sheet = spark.createDataFrame([(2000, 1.0, 2.0, None), (2001, 3.0, 4.0, 5.0)], "_c0 int, _c1 double, _c2 double, _c3 double")
    coords = spark.createDataFrame([(0, 10.5, 1.0), (1, 10.5, 1.0), (2, -3.25, 2.0)], "pos int, GOWLon double, GOWLat double")
    out = sorted(map(tuple, tables.read_wave_sheet(sheet, coords).select("Year", "GOWLon", "measurement").collect()), key=repr)
    assert len(out) == 6 and (2000, 10.5, 2.0) in out and (2000, -3.25, None) in out


def test_coordinate_names(spark):
    df = spark.createDataFrame([("X_-3.5_10",), ("X_bad",)], "k string")
    out = [tuple(r) for r in reshape.split_coord_key(df, "k").collect()]
    assert out == [(-3.5, 10.0), (None, None)]


def test_stacked_tables_fill_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    out = sorted(map(tuple, tables.stack_tables({"a": a, "b": b}).select("x", "y", "file").collect()))
    assert out == [(1, 2, "a"), (3, None, "b")]


def test_nearest_cell_far_from_all_and_without_any(spark):
    cells = spark.createDataFrame([(1, -179.5, 89.5)], "cell bigint, cell_lon double, cell_lat double")
    pts = spark.createDataFrame([(0.0, -90.0), (None, 3.0), (10.0, None), (-179.5, 89.5)], "Longitude double, Latitude double")
    got = {(r["Longitude"], r["Latitude"]): (r["non_na_cell"], r["km"]) for r in spatial.nearest_valid_cell(pts, cells).collect()}
    assert got[(None, 3.0)] == got[(10.0, None)] == (None, None) and got[(-179.5, 89.5)] == (1, 0.0)
    assert got[(0.0, -90.0)] == (1, pytest.approx(km((0.0, -90.0), (-179.5, 89.5)), abs=1e-5))
    none = spatial.nearest_valid_cell(pts, cells.limit(0)).collect()
    assert len(none) == 4 and {r["non_na_cell"] for r in none} == {None}


def test_nearest_cell_reads_points_and_cells_once(spark):
    """Rows are counted as they are read."""
    read = {name: spark.sparkContext.accumulator(0) for name in ("points", "cells")}

    def counted(df, name):
        def run(batches):
            for b in batches:
                read[name].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    pts = spark.range(300).selectExpr("id * 1.17 - 175 AS Longitude", "id * 0.5 - 75 AS Latitude")
    cells = spark.range(40).selectExpr("id + 1 AS cell", "id * 4 - 80.5 AS cell_lon", "id - 19.5 AS cell_lat")
    found = spatial.nearest_valid_cell(counted(pts, "points"), counted(cells, "cells"))
    # of written tables: the state of the last level, the placed cells, the places
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
    assert found.count() == 300 and {k: a.value for k, a in read.items()} == {"points": 300, "cells": 40}


def test_neighbor_fill_reads_the_grid_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    grid = spark.range(120).selectExpr(
        "id DIV 4 + 1000 AS cell", "make_date(2000, CAST(id % 4 + 1 AS INT), 1) AS date", "IF(id DIV 4 = 7, NULL, CAST(id AS DOUBLE)) AS value")
    filled = spatial.neighbor_fill(spark.range(30).selectExpr("id + 1000 AS cell"), grid.mapInArrow(run, grid.schema))
    rows = {(r["cell"], r["date"].month): r["value"] for r in filled.collect()}
    assert read.value == 240 and len(rows) == 120
    assert rows[(1007, 2)] == (25 + 33) / 2 and rows[(1006, 2)] == 25


def test_years_reach_the_scan_as_dates(spark, tmp_path):
    """The pushed filter names the date column; results are those of comparing years."""
    from tideline.operators import climate, filters

    path = str(tmp_path / "series")
    spark.range(4000).selectExpr("id % 5 AS cell", "date_add(DATE'1990-06-01', CAST(id AS INT)) AS DateName",
                                 "year(date_add(DATE'1990-06-01', CAST(id AS INT))) AS Year", "CAST(id AS DOUBLE) AS tempC").write.parquet(path)
    series = spark.read.parquet(path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wanted = ["GreaterThanOrEqual(DateName,1993-01-01)", "LessThan(DateName,1996-01-01)"]
    means = climate.seasonal_means(series, ["cell"], "site", window=(1993, 1995))
    assert all(w in plan(means) for w in wanted)
    by_year = filters.study_window(series, 1993, 1995)
    by_date = filters.study_window(series, 1993, 1995, date="DateName")
    assert all(w in plan(by_date) for w in wanted) and by_date.exceptAll(by_year).isEmpty() and by_date.count() == by_year.count()
    grid = tables.clean_grid(series.selectExpr("cell", "DateName AS date", "tempC AS value"), 1993, 1995)
    assert "GreaterThanOrEqual(DateName,1993-01-01)" in plan(grid) and grid.count() == by_year.count()


def test_wave_tables_share_one_shuffle(spark):
    """Six tables, one aggregate; what a table lacks is missing, and keys come from the mean energy."""
    from tideline.operators.waves import wave_frame

    def made(rows, month=False):
        cols = "Year int, Month int, GOWLon double, GOWLat double, measurement double"
        df = spark.createDataFrame([(y, m, a, b, v) for y, m, a, b, v in rows], cols)
        return df if month else df.drop("Month")

    year = made([(2000, 0, 1.0, 2.0, 5.0), (2001, 0, 1.0, 2.0, None)])
    months = made([(2000, 1, 1.0, 2.0, 3.0), (2000, 2, 1.0, 2.0, 7.0), (2002, 1, 1.0, 2.0, 9.0)], True)
    empty = made([(2000, 1, 1.0, 2.0, None)], True)
    points = spark.createDataFrame([(10.0, 20.0, 1.0, 2.0)], "`orig Lat` double, `orig Lon` double, LonGOW double, LatGOW double")
    out = wave_frame(year, year, year.limit(0), months, empty, months, points)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(Year") == 1 and plan.count("Join") == 1
    rows = {r["Year"]: r for r in out.collect()}
    assert set(rows) == {2000, 2001}
    r = rows[2000]
    assert (r["mean_wave_energy"], r["max_mean_wave_energy"], r["max_wave_height"], r["total_wave_energy"], r["q95_wave_height"]) == (5, 7, 7, 0, None)
    assert rows[2001]["total_wave_energy"] is None and rows[2001]["max_wave_height"] is None
