"""The given tables in the roles of the analysis, as DataFrames and as SQL.

Each role is written twice, once per side of the check: a function of
(spark, folder) and a common table expression over the same parquet tables.
Dimension tables of a fixed size (regions, nations) may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.materialize import written

NATIONS = 25  # columns of the wide wave sheets, one per nation
WINDOW = (1996, 2000)  # study window inside the tables' years 1995-2001


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
              " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
                " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
                " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table with its declared schema (no job to infer it)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def point(key: Column) -> list[Column]:
    """Coordinates derived from a key."""
    return [
        (F.pmod(key * 53, F.lit(1400)) / 10 - 70).alias("Latitude"),
        (F.pmod(key * 37, F.lit(3600)) / 10 - 180).alias("Longitude"),
    ]


def places(spark, folder) -> DataFrame:
    """Nation with its region's name."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )


def survey(spark, folder) -> DataFrame:
    """One row per order: a site observed in a year."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(places(spark, folder)), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("obs_id"),
            F.col("o_custkey").cast("string").alias("Site"),
            F.col("o_orderpriority").alias("Study"),
            F.concat_ws(":", "o_custkey", "o_orderpriority").alias("SiteName"),
            F.year("o_orderdate").alias("Year"),
            F.floor(F.col("o_custkey") / 15).alias("cell"),
            *point(F.col("c_custkey")),
            F.concat_ws("-", "o_custkey", "o_orderstatus").alias("trajectory_ID"),
            F.col("c_acctbal").alias("mean_Depth"),
            F.col("c_mktsegment").alias("focalUnit"),
            F.concat_ws("-", "n_name", "c_mktsegment").alias("ECOREGION"),
            F.col("n_name").alias("PROVINCE"),
            F.col("r_name").alias("REALM"),
            F.col("o_totalprice").alias("y"),
        )
    )


def series(spark, folder) -> DataFrame:
    """Long series of a location: one value per line item of a supplier."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        F.to_date("l_shipdate").alias("DateName"),
        F.year("l_shipdate").alias("Year"),
        F.col("l_quantity").alias("tempC"),
    )


def region_series(spark, folder, level: str) -> DataFrame:
    """The series by PROVINCE or REALM of the supplier, or ECOREGION of the customer."""
    lineitem = table(spark, folder, "lineitem")
    if level == "ECOREGION":
        orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
        placed = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(
            customer, orders.o_custkey == customer.c_custkey
        ).join(F.broadcast(places(spark, folder)), F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.concat_ws("-", "n_name", "c_mktsegment")
    else:
        supplier = table(spark, folder, "supplier")
        placed = lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey).join(
            F.broadcast(places(spark, folder)), F.col("s_nationkey") == F.col("n_nationkey")
        )
        key = F.col({"PROVINCE": "n_name", "REALM": "r_name"}[level])
    return placed.select(
        key.alias(level), F.to_date("l_shipdate").alias("DateName"), F.year("l_shipdate").alias("Year"),
        F.col("l_quantity").alias("tempC"),
    )


def wave_lines(spark, folder) -> DataFrame:
    lineitem, supplier = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    return lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey).select(
        F.year("l_shipdate").alias("Year"), F.month("l_shipdate").alias("Month"),
        F.when(F.col("s_nationkey").between(0, NATIONS - 1), F.col("s_nationkey"))
        .otherwise(F.raise_error(F.lit(f"a sheet has {NATIONS} columns"))).cast("int").alias("s_nationkey"),
        F.col("l_extendedprice").alias("energy"), F.col("l_quantity").alias("height"),
    )


def wave_facts(lines: DataFrame, month: bool = False) -> DataFrame:
    """All measures of the wave lines by year (and month) and nation, which the sheets of one kind share."""
    ids = ["Year", "Month"] if month else ["Year"]
    return written(lines.groupBy(*ids, "s_nationkey").agg(
        F.avg("energy").alias("mean_energy"), F.sum("energy").alias("sum_energy"), F.avg("height").alias("mean_height"),
        F.max("height").alias("max_height"),
        # The heights take 50 distinct values, which bounds what the percentile holds.
        F.expr("percentile(height, 0.95)").alias("q95_height")))


def wave_sheet(facts: DataFrame, measure: str, month: bool = False) -> DataFrame:
    """Wide sheet of a measure of :func:`wave_facts`: one row per year (and month), one column per nation."""
    ids = "Year, Month" if month else "Year"
    nations = ", ".join(str(n) for n in range(NATIONS))
    return facts.sparkSession.sql(
        f"SELECT * FROM (SELECT {ids}, s_nationkey, {measure} FROM {{facts}}) PIVOT (any_value({measure}) FOR s_nationkey IN ({nations}))",
        facts=facts)


def wave_coords(spark, folder) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        key.alias("pos"), (key * 144 / 10 - 180).alias("GOWLon"), (key * 56 / 10 - 70).alias("GOWLat")
    )


def wave_points(spark, folder) -> DataFrame:
    """Original points (customers) and the wave grid point (nation) each one reads."""
    coords = wave_coords(spark, folder)
    customer = table(spark, folder, "customer")
    lat, lon = point(F.col("c_custkey"))
    return customer.join(F.broadcast(coords), customer.c_nationkey == coords.pos).select(
        lat.alias("orig Lat"), lon.alias("orig Lon"), F.col("GOWLon").alias("LonGOW"), F.col("GOWLat").alias("LatGOW")
    ).distinct()


def prior_slopes(spark, folder) -> DataFrame:
    """Result table of an earlier model: mean and standard error per site and parameter."""
    orders = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    return orders.groupBy(F.col("o_custkey").cast("string").alias("SiteName"), status).agg(
        F.avg("o_totalprice").alias("mean"),
        (F.stddev_samp("o_totalprice") / F.sqrt(F.count("o_totalprice").cast("double"))).alias("se"),
    ).select(
        "SiteName",
        F.when(status == "F", "site_slope").when(status == "O", "site_intercept").otherwise("mean_slope").alias("parameter"),
        F.lit("Ecoregion").alias("grouping"),
        F.lit("1900-2015").alias("Period"),
        "mean",
        "se",
        (F.col("mean") - 1.645 * F.col("se")).alias("lower_0.9"),
        (F.col("mean") + 1.645 * F.col("se")).alias("upper_0.9"),
    )


def taxa(spark, folder) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.concat(F.lit("KelpAbundance_"), F.regexp_replace("p_brand", "#", " et al. ")).alias("Study"),
        F.col("p_name").alias("Species"),
    )


def points(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", *point(F.col("c_custkey")))


def grid_cells(spark, folder) -> DataFrame:
    """Suppliers on the 1-degree grid; several may share a cell."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        (F.pmod(key * 61, F.lit(360)) - 179.5).alias("cell_lon"),
        (F.pmod(key * 29, F.lit(140)) - 69.5).alias("cell_lat"),
    )


def grid(spark, folder) -> DataFrame:
    """Yearly layers of the grid; some cells carry the missing sentinel."""
    from ..operators.spatial import cell_of

    cells = grid_cells(spark, folder).withColumn("cell", cell_of(F.col("cell_lon"), F.col("cell_lat")))
    lineitem = table(spark, folder, "lineitem")
    layers = lineitem.join(cells, lineitem.l_suppkey == cells.s_suppkey).groupBy(
        "cell", F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("date")
    ).agg(F.avg("l_quantity").alias("v"))
    return layers.select("cell", "date", F.when(F.col("v") > 26, -1000.0).otherwise(F.col("v")).alias("value"))


def draws(spark, folder) -> DataFrame:
    """Long draws: chain, iteration, parameter (position in the vector), value."""
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("iteration"),
        F.pmod("vec_id", F.lit(4)).alias("chain"),
        F.col("vec_id").alias("draw"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("param", "value"),
    )


def log_lik(spark, folder, power: int = 1) -> DataFrame:
    """Draw-by-observation log-likelihoods of two models."""
    v = F.col("value")
    return draws(spark, folder).select("draw", F.col("param").alias("obs"), (-F.abs(v) if power == 1 else -v * v).alias("ll"))


CTES = {
    "places": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "survey": """
        SELECT o_orderkey AS obs_id, CAST(o_custkey AS VARCHAR) AS "Site", o_orderpriority AS "Study",
               concat_ws(':', o_custkey, o_orderpriority) AS "SiteName",
               CAST(year(o_orderdate) AS INTEGER) AS "Year", o_custkey // 15 AS cell,
               ((c_custkey * 53) % 1400) / 10.0::DOUBLE - 70 AS "Latitude",
               ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS "Longitude",
               concat_ws('-', o_custkey, o_orderstatus) AS "trajectory_ID", c_acctbal AS "mean_Depth",
               c_mktsegment AS "focalUnit", concat_ws('-', n_name, c_mktsegment) AS "ECOREGION",
               n_name AS "PROVINCE", r_name AS "REALM", o_totalprice AS y
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey""",
    "series": """
        SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS "DateName",
               CAST(year(l_shipdate) AS INTEGER) AS "Year", l_quantity AS "tempC" FROM lineitem""",
    "province_series": """
        SELECT n_name AS "PROVINCE", r_name AS "REALM", CAST(l_shipdate AS DATE) AS "DateName",
               CAST(year(l_shipdate) AS INTEGER) AS "Year", l_quantity AS "tempC"
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey""",
    "ecoregion_series": """
        SELECT concat_ws('-', n_name, c_mktsegment) AS "ECOREGION", CAST(l_shipdate AS DATE) AS "DateName",
               CAST(year(l_shipdate) AS INTEGER) AS "Year", l_quantity AS "tempC"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN places ON c_nationkey = n_nationkey""",
    "wave_lines": """
        SELECT CAST(year(l_shipdate) AS INTEGER) AS "Year", CAST(month(l_shipdate) AS INTEGER) AS "Month",
               s_nationkey AS nk, l_extendedprice AS energy, l_quantity AS height
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "wave_coords": """
        SELECT n_nationkey AS nk, n_nationkey * 144 / 10.0::DOUBLE - 180 AS "GOWLon",
               n_nationkey * 56 / 10.0::DOUBLE - 70 AS "GOWLat" FROM nation""",
    "wave_points": """
        SELECT DISTINCT ((c_custkey * 53) % 1400) / 10.0::DOUBLE - 70 AS "Latitude",
               ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS "Longitude",
               "GOWLon" AS "LonGOW", "GOWLat" AS "LatGOW", nk
        FROM customer JOIN wave_coords ON c_nationkey = nk""",
    "wave_year": """
        SELECT "Year", nk, avg(energy) AS mean_wave_energy, avg(height) AS mean_wave_height,
               quantile_cont(height, 0.95) AS q95_wave_height
        FROM wave_lines GROUP BY 1, 2""",
    "wave_month": """
        SELECT "Year", "Month", nk, avg(energy) AS mean_energy, sum(energy) AS sum_energy, max(height) AS max_height
        FROM wave_lines GROUP BY 1, 2, 3""",
    "wave_annual": """
        SELECT s."Year", s.nk, any_value(mean_wave_energy) AS mean_wave_energy,
               any_value(mean_wave_height) AS mean_wave_height,
               max(mean_energy) AS max_mean_wave_energy, stddev_samp(mean_energy) AS sd_mean_wave_energy,
               max(sum_energy) AS max_sum_wave_energy, coalesce(sum(sum_energy), 0) AS total_wave_energy,
               stddev_samp(sum_energy) AS sd_sum_wave_energy,
               max(max_height) AS max_wave_height, stddev_samp(max_height) AS sd_max_wave_height,
               any_value(q95_wave_height) AS q95_wave_height
        FROM (SELECT * FROM (SELECT DISTINCT "Year" FROM wave_lines) CROSS JOIN (SELECT nk FROM wave_coords)) s
        LEFT JOIN wave_year y ON y."Year" = s."Year" AND y.nk = s.nk
        LEFT JOIN wave_month m ON m."Year" = s."Year" AND m.nk = s.nk GROUP BY 1, 2""",
    "wave_frame": """
        SELECT p."Latitude", p."Longitude", p."LonGOW", p."LatGOW", w.* EXCLUDE (nk)
        FROM wave_points p JOIN wave_annual w ON p.nk = w.nk""",
    "prior_slopes": """
        SELECT CAST(o_custkey AS VARCHAR) AS "SiteName",
               CASE o_orderstatus WHEN 'F' THEN 'site_slope' WHEN 'O' THEN 'site_intercept' ELSE 'mean_slope' END
                 AS parameter, 'Ecoregion' AS "grouping", '1900-2015' AS "Period", avg(o_totalprice) AS mean,
               stddev_samp(o_totalprice) / sqrt(count(o_totalprice)) AS se,
               avg(o_totalprice) - 1.645::DOUBLE * (stddev_samp(o_totalprice) / sqrt(count(o_totalprice))) AS "lower_0.9",
               avg(o_totalprice) + 1.645::DOUBLE * (stddev_samp(o_totalprice) / sqrt(count(o_totalprice))) AS "upper_0.9"
        FROM orders GROUP BY o_custkey, o_orderstatus""",
    "taxa": """
        SELECT 'KelpAbundance_' || replace(p_brand, '#', ' et al. ') AS "Study", p_name AS "Species" FROM part""",
    "points": """
        SELECT c_custkey, ((c_custkey * 53) % 1400) / 10.0::DOUBLE - 70 AS "Latitude",
               ((c_custkey * 37) % 3600) / 10.0::DOUBLE - 180 AS "Longitude" FROM customer""",
    "grid_cells": """
        SELECT s_suppkey, (s_suppkey * 61) % 360 - 179.5::DOUBLE AS cell_lon,
               (s_suppkey * 29) % 140 - 69.5::DOUBLE AS cell_lat,
               CAST(least(floor(90 - ((s_suppkey * 29) % 140 - 69.5::DOUBLE)), 179) * 360
                 + least(floor((s_suppkey * 61) % 360 - 179.5::DOUBLE + 180), 359) + 1 AS BIGINT) AS cell
        FROM supplier""",
    "grid": """
        SELECT cell, make_date(year(l_shipdate), 1, 1) AS date,
               CASE WHEN avg(l_quantity) > 26 THEN -1000.0::DOUBLE ELSE avg(l_quantity) END AS value
        FROM lineitem JOIN grid_cells ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "draws": """
        SELECT vec_id // 4 AS iteration, vec_id % 4 AS chain, vec_id AS draw,
               CAST(i AS INTEGER) - 1 AS param, CAST(embedding[i] AS DOUBLE) AS value
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "log_lik": "SELECT draw, param AS obs, -abs(value) AS ll, -value * value AS ll2 FROM draws",
}

_NEEDS = {
    "survey": ["places"],
    "province_series": ["places"],
    "ecoregion_series": ["places"],
    "wave_points": ["wave_coords"],
    "wave_year": ["wave_lines"],
    "wave_month": ["wave_lines"],
    "wave_annual": ["wave_year", "wave_month", "wave_coords"],
    "wave_frame": ["wave_points", "wave_annual"],
    "grid": ["grid_cells"],
    "log_lik": ["draws"],
}


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _ordered(_NEEDS.get(n, []), seen)
            seen.append(n)
    return seen


def with_ctes(names: str, rest: str) -> str:
    """``WITH`` clause of the named roles and what they need, then the given SQL.

    The given SQL may itself start with further ``name AS (...)`` items and ``;``-free text.
    """
    items = [f'"{n}" AS ({CTES[n]})' for n in _ordered(names.split(), [])]
    return "WITH " + ",\n".join(items) + "\n" + rest
