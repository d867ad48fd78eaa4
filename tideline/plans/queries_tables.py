"""Queries of scans, filters, reshaping, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.scalars import dotted_date, text_key
from ..operators import filters, joins, reshape, rows
from ..sources import tables
from . import standins as s
from .catalog import query, r, rounded, rs
from .standins import table, with_ctes

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
])


@query("typed_scan", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS order_date
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def typed_scan(spark, folder):
    orders = tables.read_table(spark, f"{folder}/orders.parquet", ORDERS_SCHEMA)
    return orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("order_date")
    )


@query("wave_sheet_yearly", with_ctes("wave_annual wave_coords", f"""
SELECT "Year", {rs("GOWLon GOWLat")}, {r("mean_wave_energy", "measurement", 4)}
FROM wave_annual w JOIN wave_coords c ON w.nk = c.nk"""))
def wave_sheet_yearly(spark, folder):
    sheet = s.wave_sheet(s.wave_facts(s.wave_lines(spark, folder)), "mean_energy")
    return rounded(tables.read_wave_sheet(sheet, s.wave_coords(spark, folder)), measurement=4)


@query("wave_sheet_monthly", with_ctes("wave_month wave_coords", f"""
SELECT t."Year", t."Month", {rs("GOWLon GOWLat")}, {r("sum_energy", "measurement", 2)}
FROM (SELECT DISTINCT "Year", "Month" FROM wave_lines) t CROSS JOIN wave_coords c
LEFT JOIN wave_month m ON m."Year" = t."Year" AND m."Month" = t."Month" AND m.nk = c.nk"""))
def wave_sheet_monthly(spark, folder):
    sheet = s.wave_sheet(s.wave_facts(s.wave_lines(spark, folder), month=True), "sum_energy", month=True)
    return rounded(tables.read_wave_sheet(sheet, s.wave_coords(spark, folder), month=True), measurement=2)


@query("grid_scan", with_ctes("grid", f"""
SELECT cell, date, {r("nullif(value, -1000)", "value")} FROM grid WHERE year(date) BETWEEN 1996 AND 2000"""))
def grid_scan(spark, folder):
    return rounded(tables.clean_grid(s.grid(spark, folder), 1996, 2000))


@query("month_from_file_name", """
SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS month, count(*) AS n FROM orders GROUP BY 1""")
def month_from_file_name(spark, folder):
    named = table(spark, folder, "orders").select(
        F.concat(F.lit("/waves/multi_1.glo_30m.hs."), F.date_format("o_orderdate", "yyyyMM"), F.lit(".grb2")).alias("f")
    )
    return named.groupBy(tables.file_month(F.col("f")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("stack_tables_with_source", """
SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS file FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def stack_tables_with_source(spark, folder):
    customer = table(spark, folder, "customer").selectExpr(
        "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment")
    supplier = table(spark, folder, "supplier").selectExpr(
        "s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance")
    return tables.stack_tables({"customer": customer, "supplier": supplier})


@query("study_window", with_ctes("survey", """SELECT obs_id, "Year" FROM survey WHERE "Year" BETWEEN 1996 AND 2000"""))
def study_window(spark, folder):
    return filters.study_window(s.survey(spark, folder), *s.WINDOW).select("obs_id", "Year")


@query("complete_cases", """
SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def complete_cases(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    joined = joins.natural_left_join(docs, table(spark, folder, "labels"))
    return filters.complete_cases(joined, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("prior_site_slopes", with_ctes("prior_slopes", f"""
SELECT "SiteName", {rs("mean se", 7)} FROM prior_slopes
WHERE parameter = 'site_slope' AND "grouping" = 'Ecoregion' AND "Period" = '1900-2015'"""))
def prior_site_slopes(spark, folder):
    prior = s.prior_slopes(spark, folder)
    kept = filters.where_equal(prior, parameter="site_slope", grouping="Ecoregion", Period="1900-2015")
    return rounded(kept.select("SiteName", "mean", "se"), 7)


@query("listed_parameters", with_ctes("prior_slopes", """
SELECT parameter, count(*) AS n FROM prior_slopes WHERE parameter IN ('mean_slope', 'site_intercept') GROUP BY 1"""))
def listed_parameters(spark, folder):
    kept = filters.members(s.prior_slopes(spark, folder), "parameter", ["mean_slope", "site_intercept"])
    return kept.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"))


@query("nonzero_error", with_ctes("prior_slopes", f"""
SELECT "SiteName", parameter, {r("se", "se", 7)} FROM prior_slopes WHERE se <> 0"""))
def nonzero_error(spark, folder):
    kept = filters.nonzero_error(s.prior_slopes(spark, folder), ["se"])
    return rounded(kept.select("SiteName", "parameter", "se"), 7)


@query("floored_error", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 1e-20 ELSE l_tax END AS l_tax FROM lineitem""")
def floored_error(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return filters.nonzero_error(lineitem, ["l_tax"], floor=True)


@query("rename_with_suffix", """
SELECT c_custkey AS c_custkey_realm, c_nationkey AS c_nationkey_realm, c_acctbal FROM customer""")
def rename_with_suffix(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return filters.rename_suffix(customer, "key", "_realm")


@query("columns_by_name", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem""")
def columns_by_name(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    span = lineitem.select(*filters.column_span(lineitem, "l_orderkey", "l_discount"))
    kept = filters.select_matching(span, without="discount")
    return filters.select_matching(kept, matches="KEY|number")


@query("pick_measure", f"""
SELECT l_suppkey, {r("avg(l_extendedprice)", "waves", 4)}, {r("stddev_samp(l_extendedprice)", "se_waves", 4)},
  {r("avg(l_quantity)", "temp")}, {r("stddev_samp(l_quantity)", "se_temp")} FROM lineitem GROUP BY 1""")
def pick_measure(spark, folder):
    wide = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_extendedprice").alias("energy_estimate"), F.stddev_samp("l_extendedprice").alias("energy_std.error"),
        F.avg("l_quantity").alias("heat_estimate"), F.stddev_samp("l_quantity").alias("heat_std.error"),
    )
    picked = filters.pick_measure(wide, "energy_estimate", "heat_estimate")
    return rounded(picked.select("l_suppkey", "waves", "se_waves", "temp", "se_temp"), waves=4, se_waves=4)


@query("quality_report", with_ctes("grid", """
SELECT cell, count(*) AS n_rows, count(*) FILTER (value = -1000) AS n_missing,
  count(*) FILTER (value > 25 AND value <> -1000) AS n_high FROM grid GROUP BY 1"""))
def quality_report(spark, folder):
    grid = tables.clean_grid(s.grid(spark, folder), 1900, 2100)
    return filters.quality_report(grid, "value", ["cell"], limit=25.0)


@query("suspect_rows", with_ctes("grid", f"""
SELECT cell, date, {r("nullif(value, -1000)", "value")} FROM grid WHERE value = -1000 OR value > 25"""))
def suspect_rows(spark, folder):
    grid = tables.clean_grid(s.grid(spark, folder), 1900, 2100)
    return rounded(filters.suspect_rows(grid, "value", 25.0))


@query("relabel_columns", """SELECT s_suppkey AS cell, s_nationkey AS place FROM supplier""")
def relabel_columns(spark, folder):
    return filters.relabel(
        table(spark, folder, "supplier"), {"s_suppkey": "cell", "s_nationkey": "place"}, ["s_name", "s_acctbal"])


@query("magnitude_and_label_filter", """
SELECT c_custkey, c_acctbal, c_mktsegment FROM customer
WHERE abs(c_acctbal) <= 2000 AND c_mktsegment <> 'BUILDING' AND c_acctbal > 0.05""")
def magnitude_and_label_filter(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return customer.where(F.abs("c_acctbal") <= 2000).where(
        (F.col("c_mktsegment") != "BUILDING") & (F.col("c_acctbal") > 0.05))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("wide_to_long", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{m}' AS variable, {m} AS value FROM lineitem" for m in MEASURES))
def wide_to_long(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *MEASURES)
    return reshape.to_long(lineitem, ["l_orderkey", "l_linenumber"], "variable", "value")


@query("split_coordinate_names", """
SELECT c_custkey, ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS "GOWLon",
  ((c_custkey * 53) % 1400) / 10.0::DOUBLE - 70 AS "GOWLat" FROM customer""")
def split_coordinate_names(spark, folder):
    named = s.points(spark, folder).select("c_custkey", F.concat_ws("_", F.lit("X"), "Longitude", "Latitude").alias("k"))
    return reshape.split_coord_key(named, "k")


@query("wide_sheet_by_column_name", with_ctes("wave_month wave_coords", f"""
SELECT t."Year", t."Month", {rs("GOWLon GOWLat")}, max_height AS measurement
FROM (SELECT DISTINCT "Year", "Month" FROM wave_lines) t CROSS JOIN wave_coords c
LEFT JOIN wave_month m ON m."Year" = t."Year" AND m."Month" = t."Month" AND m.nk = c.nk"""))
def wide_sheet_by_column_name(spark, folder):
    sheet = s.wave_sheet(s.wave_facts(s.wave_lines(spark, folder), month=True), "max_height", month=True)
    names = [f"X_{n * 144 / 10 - 180}_{n * 56 / 10 - 70}" for n in range(s.NATIONS)]
    long = reshape.to_long(sheet.toDF("Year", "Month", *names), ["Year", "Month"], "gow_coords", "measurement")
    return rounded(reshape.split_coord_key(long, "gow_coords").select("Year", "Month", "GOWLon", "GOWLat", "measurement"))


@query("spread_statistics", f"""
SELECT l_suppkey, {", ".join(f'{r(f"avg(l_quantity) FILTER (l_returnflag = {chr(39)}{v}{chr(39)})", f"{v}_mean")}, max(l_quantity) FILTER (l_returnflag = {chr(39)}{v}{chr(39)}) AS "{v}_top"' for v in "ANR")}
FROM lineitem GROUP BY 1""")
def spread_statistics(spark, folder):
    tidy = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.avg("l_quantity").alias("mean"), F.max("l_quantity").alias("top"))
    return rounded(reshape.spread_stats(tidy, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], ["mean", "top"]))


@query("spread_wide", """
SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS "F",
 max(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", max(o_totalprice) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1""")
def spread_wide(spark, folder):
    return reshape.spread(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("prediction_grid", f"""
WITH a AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.75) AS q3, quantile_cont(l_discount, 0.5) AS med FROM lineitem)
SELECT canopy AS has_canopy, {r("lo + (hi - lo) / 29.0 * i", "l_quantity")},
  {r("unnest([q1, q3])", "l_extendedprice", 3)}, med AS l_discount
FROM a CROSS JOIN (SELECT unnest(range(0, 30)) AS i) CROSS JOIN (SELECT unnest(['no canopy', 'canopy']) AS canopy)""")
def prediction_grid(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    points = reshape.grid(
        lineitem, spaced_over={"l_quantity": 30},
        quantiles={"l_extendedprice": (0.25, 0.75), "l_discount": (0.5,)},
        literals={"has_canopy": ("no canopy", "canopy")},
    )
    return rounded(points.select("has_canopy", "l_quantity", "l_extendedprice", "l_discount"), l_extendedprice=3)


@query("left_join_shared_names", with_ctes("survey series", f"""
, annual AS (SELECT cell, "Year", avg("tempC") AS mean_temp FROM series GROUP BY 1, 2)
SELECT s.obs_id, s.cell, s."Year", {r("mean_temp", "mean_temp")} FROM survey s
LEFT JOIN annual a ON s.cell IS NOT DISTINCT FROM a.cell AND s."Year" IS NOT DISTINCT FROM a."Year" """))
def left_join_shared_names(spark, folder):
    annual = s.series(spark, folder).groupBy("cell", "Year").agg(F.avg("tempC").alias("mean_temp"))
    return rounded(joins.natural_left_join(s.survey(spark, folder).select("obs_id", "cell", "Year"), annual))


@query("fold_left_joins", with_ctes("survey province_series", f"""
, pr AS (SELECT "PROVINCE", avg("tempC") AS mean_province FROM province_series GROUP BY 1)
, re AS (SELECT "REALM", avg("tempC") AS mean_realm FROM province_series GROUP BY 1)
SELECT obs_id, s."PROVINCE", s."REALM", {rs("mean_province mean_realm")} FROM survey s
LEFT JOIN pr ON s."PROVINCE" = pr."PROVINCE" LEFT JOIN re ON s."REALM" = re."REALM" """))
def fold_left_joins(spark, folder):
    def mean_of(level):
        return s.region_series(spark, folder, level).groupBy(level).agg(F.avg("tempC").alias(f"mean_{level.lower()}"))

    base = s.survey(spark, folder).select("obs_id", "PROVINCE", "REALM")
    return rounded(joins.reduce_left_join([base, mean_of("PROVINCE"), mean_of("REALM")]))


@query("keyed_join_prefer_right", """
SELECT c_custkey AS key, c_nationkey AS nation, s_acctbal AS balance
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def keyed_join_prefer_right(spark, folder):
    left = table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_nationkey AS nation", "c_acctbal AS balance")
    right = table(spark, folder, "supplier").selectExpr("s_suppkey AS key", "s_acctbal AS balance")
    return joins.keyed_left_join(left, right, ["key"], prefer_right=["balance"])


@query("join_differently_named_keys", """
SELECT l_orderkey, l_linenumber, l_suppkey, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def join_differently_named_keys(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return joins.join_as(lineitem, supplier, {"l_suppkey": "s_suppkey"})


_TWO_SERIES = """
WITH we AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS "Year", max(l_extendedprice) AS wave_energy
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
wh AS (SELECT l_suppkey AS cell, CAST(year(l_shipdate) AS INTEGER) AS "Year", max(l_quantity) AS wave_height
  FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45 GROUP BY 1, 2)
SELECT coalesce(we.cell, wh.cell) AS cell, coalesce(we."Year", wh."Year") AS "Year", wave_energy, wave_height
FROM we {how} JOIN wh ON we.cell = wh.cell AND we."Year" = wh."Year" """


def _two_series(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    keys = [F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("Year")]
    energy = lineitem.where("l_returnflag = 'A'").groupBy(*keys).agg(F.max("l_extendedprice").alias("wave_energy"))
    height = lineitem.where("l_linestatus = 'O' AND l_quantity > 45").groupBy(*keys).agg(
        F.max("l_quantity").alias("wave_height"))
    return energy, height


@query("full_join_series", _TWO_SERIES.format(how="FULL"))
def full_join_series(spark, folder):
    """Two halves of the series, cut so that each lacks some keys of the other."""
    return joins.full_join(*_two_series(spark, folder))


@query("right_join_series", _TWO_SERIES.format(how="RIGHT"))
def right_join_series(spark, folder):
    """The same halves as in ``full_join_series``."""
    return joins.right_join(*_two_series(spark, folder))


@query("unmatched_keys", """
SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
  AND o_orderstatus = 'P' AND o_totalprice > 250000)""")
def unmatched_keys(spark, folder):
    """Customers without a large pending order; the filter makes keys that miss."""
    customer = table(spark, folder, "customer")
    big = table(spark, folder, "orders").where("o_orderstatus = 'P' AND o_totalprice > 250000")
    return joins.unmatched_keys(customer, big.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("missed_points_per_file", with_ctes("points", """
, ull AS (SELECT "Latitude", "Longitude", 'timeseries.xls' AS file FROM points WHERE "Longitude" < 60
  UNION ALL SELECT "Latitude", "Longitude", 'timeseries_v2.xls' FROM points WHERE "Latitude" > 0),
want AS (SELECT "Latitude", "Longitude", file FROM points CROSS JOIN (SELECT unnest(['timeseries.xls', 'timeseries_v2.xls']) AS file))
SELECT DISTINCT w."Latitude", w."Longitude", w.file FROM want w WHERE NOT EXISTS (SELECT 1 FROM ull u
 WHERE u."Latitude" = w."Latitude" AND u."Longitude" = w."Longitude" AND u.file = w.file)"""))
def missed_points_per_file(spark, folder):
    points = s.points(spark, folder)
    files = {"timeseries.xls": points.where("Longitude < 60"), "timeseries_v2.xls": points.where("Latitude > 0")}
    listed = tables.stack_tables({n: d.select("Latitude", "Longitude") for n, d in files.items()})
    wanted = joins.tag_each(points.select("Latitude", "Longitude"), "file", list(files))
    return joins.unmatched_keys(wanted, listed, ["Latitude", "Longitude", "file"])


@query("rows_of_listed_keys", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def rows_of_listed_keys(spark, folder):
    rich = table(spark, folder, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.keep_matching(table(spark, folder, "lineitem"), rich, ["l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("rounded_coordinate_join", with_ctes("points", """
SELECT a.c_custkey, b.c_custkey AS other FROM points a LEFT JOIN points b
ON round(a."Latitude" * 100000) = round(b."Latitude" * 100000) AND round(a."Longitude" * 100000) = round(b."Longitude" * 100000)"""))
def rounded_coordinate_join(spark, folder):
    points = s.points(spark, folder)
    noisy = points.select(
        F.col("c_custkey").alias("other"), (F.col("Latitude") + 1e-9).alias("Latitude"),
        (F.col("Longitude") - 1e-9).alias("Longitude"))
    return joins.rounded_coord_join(points, noisy).select("c_custkey", "other")


@query("first_row_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_row_per_group(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rows.first_row(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("sorted_sites", with_ctes("survey", """
SELECT DISTINCT "SiteName", "Latitude", "Longitude" FROM survey ORDER BY "Latitude", "Longitude", "SiteName" """))
def sorted_sites(spark, folder):
    sites = s.survey(spark, folder).select("SiteName", "Latitude", "Longitude").distinct()
    return rows.sorted_by(sites, "Latitude", "Longitude", "SiteName")


@query("distinct_key_tuples", with_ctes("survey", 'SELECT DISTINCT "REALM", "PROVINCE", "focalUnit" FROM survey'))
def distinct_key_tuples(spark, folder):
    return s.survey(spark, folder).select("REALM", "PROVINCE", "focalUnit").distinct()


@query("dotted_dates", """
SELECT CAST(l_shipdate AS DATE) AS day, CAST(year(l_shipdate) AS INTEGER) AS "Year",
 CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def dotted_dates(spark, folder):
    named = table(spark, folder, "lineitem").select(
        F.concat(F.lit("X"), F.date_format("l_shipdate", "yyyy.MM.dd")).alias("DateName"))
    day = named.select(dotted_date(F.col("DateName")).alias("day"))
    return day.groupBy("day", F.year("day").alias("Year"), F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("compound_site_names", """
SELECT concat_ws(':', o_custkey, o_orderpriority) AS "SiteName", count(*) AS n FROM orders GROUP BY 1""")
def compound_site_names(spark, folder):
    return table(spark, folder, "orders").groupBy(
        text_key("o_custkey", "o_orderpriority").alias("SiteName")).agg(F.count(F.lit(1)).alias("n"))
