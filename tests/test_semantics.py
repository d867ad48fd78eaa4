"""Hand-made edge tables for the missing-value, join and order rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import labels, scalars
from tideline.functions.semantics import missing_to_null, number, strict_mean
from tideline.operators import adequacy, climate, filters, joins, rows, trend


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


def test_nan_and_sentinel_become_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, -1000.0), (4, None)], "k int, v double")
    assert got(missing_to_null(df, ["v"], -1000.0)) == [(1, 1.0), (2, None), (3, None), (4, None)]
    assert missing_to_null(df).where("v IS NULL").count() == 2


def test_number_of_bad_text_is_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string")
    assert got(df.select(number(F.col("s")).alias("n"))) == [(1.5,), (None,), (None,)]


def test_missing_keys_match_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, r string")
    assert got(joins.natural_left_join(left, right)) == [
        (1, "a", "x"), (2, "c", None), (None, "b", "y"), (None, "b", "z")]
    assert (None, "b", None) in got(joins.natural_left_join(left, right, null_safe=False))
    assert got(joins.unmatched(left, right)) == [(2, "c")]
    assert got(joins.full_join(left, right.where("k = 1"))) == [(1, "a", "x"), (2, "c", None), (None, "b", None)]


def test_join_without_shared_columns_is_an_error(spark):
    with pytest.raises(ValueError):
        joins.natural_left_join(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int"))


def test_keyed_join_needs_a_rule_for_clashes(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, lat double")
    b = spark.createDataFrame([(1, 3.0)], "k int, lat double")
    with pytest.raises(ValueError):
        joins.keyed_left_join(a, b, ["k"])
    assert got(joins.keyed_left_join(a, b, ["k"], prefer_right=["lat"])) == [(1, 3.0)]


def test_dotted_column_names_survive_a_join(spark):
    a = spark.createDataFrame([(1, 2.0)], ["k", "x_std.error"])
    b = spark.createDataFrame([(1, 3.0)], ["k", "y_std.error"])
    assert joins.natural_left_join(a, b).columns == ["k", "x_std.error", "y_std.error"]


SEASON = [
    ("a", dt.date(2000, 3, 1), 10.0), ("a", dt.date(2000, 4, 1), None), ("a", dt.date(2000, 6, 1), 20.0),
    ("a", dt.date(2000, 7, 1), 17.0), ("b", dt.date(2000, 1, 1), None),
]


def test_season_mean_is_missing_if_a_month_is(spark):
    df = spark.createDataFrame(SEASON, "site string, DateName date, tempC double").withColumn("Year", F.lit(2000))
    out = got(climate.seasonal_means(df, ["site"], "site"))
    assert out == [("a", 47.0 / 3, None, 18.5), ("b", None, None, None)]
    counts = got(climate.stress_counts(df, ["site", "Year"]))
    assert counts[0][:4] == ("a", 2000, 47.0 / 3, 2) and counts[0][4:] == (10.0, 0, 18.5, 2)
    assert counts[1] == ("b", 2000, None, 0, None, 0, None, 0)


def test_strict_mean_without_scope(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "k string, v double")
    assert got(df.groupBy("k").agg(strict_mean("v").alias("m"))) == [("a", 2.0), ("b", None)]


def test_ice_free_months_count_missing_ice_as_none(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", None), ("a", 0.0)], "k string, ice_conc double")
    assert got(climate.ice_summary(df, ["k"])) == [("a", 0.5 / 3, 11)]


TREND = [
    ("one", 1, 1.0), ("two", 1, 1.0), ("two", 2, 3.0), ("flat_x", 1, 1.0), ("flat_x", 1, 2.0), ("flat_x", 1, 4.0),
    ("flat_y", 1, 2.0), ("flat_y", 2, 2.0), ("flat_y", 3, 2.0), ("nulls", 1, 1.0), ("nulls", 2, None),
    ("nulls", 3, 2.0), ("nulls", 4, 4.0), ("none", 1, None),
]


def test_trend_edges(spark):
    df = spark.createDataFrame(TREND, "site string, Year int, v double")
    out = {r["site"]: r for r in trend.group_trend(df, ["site"], "Year", "v").collect()}
    assert out["none"]["n"] == 0 and out["none"]["estimate"] is None
    assert out["one"]["n"] == 1 and out["one"]["estimate"] is None
    assert out["two"]["estimate"] == 2.0 and out["two"]["std.error"] is None and out["two"]["p.value"] is None
    assert out["flat_x"]["estimate"] is None
    assert out["flat_y"]["estimate"] == 0.0 and out["flat_y"]["std.error"] == 0.0 and out["flat_y"]["statistic"] is None
    assert out["nulls"]["n"] == 3
    kept = trend.sampled_trend(df, ["site"], "Year", "v", {"v": "v"})
    assert {r["site"] for r in kept.collect()} == {"flat_x", "flat_y", "nulls"}


def test_exact_line_has_the_error_of_its_rounding(spark):
    df = spark.createDataFrame([("a", i, 2.0 * i) for i in range(5)], "site string, Year int, v double")
    row = trend.group_trend(df, ["site"], "Year", "v").first()
    assert row["estimate"] == pytest.approx(2.0) and 0 < row["std.error"] < 1e-6
    assert row["statistic"] > 1e6 and 0 < row["p.value"] < 1e-18


def test_first_row_by_order_missing_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 3, 3), ("b", None, 4)], "k string, o int, v int")
    assert got(rows.first_row(df, ["k"], ["o", "v"])) == [("a", 3, 3), ("b", None, 4)]


def test_group_thresholds(spark):
    data = [("s1", "x", 1)] * 3 + [("s1", "y", 1)] * 2
    df = spark.createDataFrame(data, "Study string, Site string, v int")
    kept = rows.min_obs(df, ["Study", "Site"])
    assert kept.count() == 3 and kept.first()["n_per_site"] == 3
    sites = spark.createDataFrame([("e", f"s{i}") for i in range(6)] + [("f", f"s{i}") for i in range(5)], "E string, Site string")
    assert {r["E"] for r in rows.min_members(sites, "E", "Site").collect()} == {"e"}


def test_years_subset_keeps_the_other_study_of_a_site(spark):
    data = [("A", "x", y, 1.0) for y in (2000, 2001, 2002)] + [("B", "x", 1990, 1.0), ("B", "z", 2000, 1.0), ("A", "x", 2015, 1.0)]
    df = spark.createDataFrame(data, "StudyName string, SiteName string, Year int, y double")
    out = adequacy.years_subset(df, 3, 3, 2000, 2015)
    assert out.count() == 5 and {r["SiteName"] for r in out.collect()} == {"x"}
    assert adequacy.years_subset(df, 3, 3, 2000, 2002).count() == 0  # the upper end is excluded


def test_factor_index_skips_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "l string")
    assert got(rows.factor_index(df, "l", "i")) == [("a", 1), ("b", 2), ("b", 2), (None, None)]


def test_numbers_are_consecutive_over_many_parts(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    from tideline.operators.materialize import number_rows

    out = number_rows(df, [F.col("k")], "n")
    assert out.where("n <> k + 1").count() == 0 and out.count() == 5000


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (20.0,), (20.5,), (40.0,), (41.0,), (None,)], "x double")
    out = [r["b"] for r in df.select(scalars.pretty_cut(F.col("x"), [1, 20, 40]).alias("b")).collect()]
    assert out == [None, "1 - 20", "1 - 20", "20 - 40", "20 - 40", None, None]


def test_label_rules(spark):
    df = spark.createDataFrame(
        [("KelpAbundance_Foo.et al & bar",), ("Leinaas_and_Christie_1996",), ("KelpAbundance_NovaScotia x",)], "s string")
    out = [r[0] for r in df.select(labels.rewrite(F.col("s"), labels.TAXA_STUDY_RULES)).collect()]
    assert out == ["Foo_etal_bar", "Leinaas_Christie_1996", "Nova_Scotia_x"]
    trendy = spark.createDataFrame([("norway_inner_coast_norderhaug-Ei",), ("Gagnon_atal 2005",)], "s string")
    out = [r[0] for r in trendy.select(labels.rewrite(F.col("s"), labels.TREND_STUDY_RULES)).collect()]
    assert out == ["norway_inner_coast_norderhaug", "Gagnon_etal_2005"]


def test_box_bounds_are_strict(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.1, 0.0), (20.0, -5.0), (40.0, -5.0), (-5.0, 45.0)], "lon double, lat double")
    out = [r[0] for r in df.select(labels.override_in_boxes(F.lit("x"), F.col("lon"), F.col("lat"))).collect()]
    assert out == ["x", "no canopy", "canopy", "x", "no canopy"]


def test_canopy_of_a_group_with_missing_species(spark):
    df = spark.createDataFrame([("a", None), ("a", "Egregia menziesii"), ("b", None)], "Study string, Species string")
    assert got(climate.group_any(df, "Study", "Species")) == [("a", "canopy"), ("b", "no canopy")]


def test_column_choices(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, 3.0)], ["site", "sd_x", "se", "w_estimate"])
    assert filters.select_matching(df, without="sd_").columns == ["site", "se", "w_estimate"]
    assert filters.select_matching(df, matches="SE$|site").columns == ["site", "se"]
    assert filters.column_span(df, "sd_x", "se") == ["sd_x", "se"]
    assert filters.nonzero_error(df, ["se"]).count() == 0
    assert filters.nonzero_error(df, ["se"], floor=True).first()["se"] == 1e-20


def test_change_classes_and_bands(spark):
    df = spark.createDataFrame([(-2.0, -1.0), (1.0, 2.0), (-1.0, 1.0), (0.0, 1.0)], "lo double, hi double")
    out = [r[0] for r in df.select(scalars.classify_change(F.col("lo"), F.col("hi"))).collect()]
    assert out == ["Loss", "Gain", "No change", "Gain"]
    lat = spark.createDataFrame([(21.2,), (30.0,)], "l double")
    assert [r[0] for r in lat.select(scalars.name_latitude(F.col("l"))).collect()] == ["Baja,\n Peru", "30"]


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert got(climate.histogram(df, "x", 5)) == [(1, 2.0, 2)]


def test_one_row_cannot_multiply(spark):
    df = spark.range(3)
    assert [r.x for r in joins.with_one_row(df, spark.range(1).selectExpr("5 AS x")).collect()] == [5, 5, 5]
    assert [r.x for r in joins.with_one_row(df, spark.range(0).selectExpr("5 AS x")).collect()] == [None] * 3
    with pytest.raises(Exception, match="more than one row"):
        joins.with_one_row(df, spark.range(2).selectExpr("id AS x")).collect()


def test_bins_between_the_ends_of_the_data(spark):
    df = spark.createDataFrame([(-12.5,), (0.0,), (1e-3,), (4321.0,), (None,)], "v double")
    out = [r.bin for r in scalars.data_cut(df, "v", [0.0, 1e9], "bin", " C").collect()]
    assert out == [None, "-12.5 - 0 C", "0 - 4.32e+03 C", "0 - 4.32e+03 C", None]


def test_far_points_find_their_nearest_cell(spark):
    from tideline.operators.spatial import nearest_valid_cell

    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 10.5, 0.5)], "cell long, cell_lon double, cell_lat double")
    points = spark.createDataFrame([(0.4, 0.4), (179.9, 0.0), (-100.0, -80.0), (30.0, 0.5)], "Longitude double, Latitude double")
    got = {r.Longitude: r.non_na_cell for r in nearest_valid_cell(points, cells).collect()}
    assert got == {0.4: 1, 179.9: 2, -100.0: 1, 30.0: 2}


def test_analysis_rows_write_no_row_twice_for_a_second_wave(spark, monkeypatch):
    from tideline.operators import waves as wave_ops
    from tideline.plans import deviations

    survey = spark.createDataFrame(
        [(i, "s", f"site{i // 3}", "e", 2000 + i % 3, float(i // 3), 1.0) for i in range(18)]
        + [(90, "s", "site0", "e", 1990, 0.0, 1.0), (91, "s", "far", "e", 2000, 50.0, 1.0), (92, None, None, "e", 2001, None, 1.0),
           (93, "t", "few", "other", 2000, 0.0, 1.0)],
        "obs_id int, Study string, Site string, ECOREGION string, Year int, Latitude double, Longitude double")
    measures = wave_ops.WAVE_MEASURES
    waves = spark.createDataFrame(
        [(2000 + y, lat, 1.0, *[None if m == 0 and (k == 1 or y == 2) else float(k + y + m) for m in range(len(measures))])
         for lat in [0.0, 0.000001, 1.0, 2.0, 3.0, 4.0, 5.0, None] for y in range(3) for k in range(5)],
        "Year int, Latitude double, Longitude double, " + ", ".join(f"{m} double" for m in measures))
    sizes = []

    def counting(df):
        out = written(df)
        sizes.append(out.count())
        return out

    written = deviations.written
    window = (1995, 2005)
    inside = survey.where("Year BETWEEN 1995 AND 2005")
    want = deviations.analysis_rows(deviations.with_waves(inside, waves, measures, window), min_rows=1, min_sites=4)
    monkeypatch.setattr(deviations, "written", counting)
    got = deviations.wave_analysis_rows(inside, waves, measures, window, min_rows=1, min_sites=4)
    assert got.columns == [c for c in survey.columns] + ["n_per_site", "sites_per_ecoregion"] + want.columns[len(survey.columns):-2]
    rows = lambda df: sorted(map(str, df.select(sorted(want.columns)).collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 4 * 18
    assert sizes and sum(sizes) <= inside.count()
