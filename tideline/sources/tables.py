"""Typed reads, the wide wave sheet, the date-layered grid, and writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.semantics import MISSING_SENTINEL, missing_to_null
from ..operators.filters import within_years
from ..operators.reshape import positional_long

# File names that carry a year and month.
MONTH_IN_FILE = r"(?:nww3|multi_1)[^/]*?\.(\d{4})(\d{2})"

SURVEY_SCHEMA = T.StructType([
    T.StructField("StudySite", T.StringType()),
    T.StructField("Study", T.StringType()),
    T.StructField("SiteName", T.StringType()),
    T.StructField("Year", T.IntegerType()),
    T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()),
    T.StructField("trajectory_ID", T.StringType()),
])

SERIES_SCHEMA = T.StructType([
    T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()),
    T.StructField("cell", T.LongType()),
    T.StructField("non_na_cell", T.LongType()),
    T.StructField("DateName", T.StringType()),
    T.StructField("tempC", T.DoubleType()),
    T.StructField("Year", T.IntegerType()),
])

TREND_SCHEMA = T.StructType([
    T.StructField("SiteName", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("grouping", T.StringType()),
    T.StructField("Period", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("se", T.DoubleType()),
    T.StructField("lower_0.9", T.DoubleType()),
    T.StructField("upper_0.9", T.DoubleType()),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, or CSV with a header when the path ends in ``.csv``.

    ``NA`` is missing; so is NaN. CSV needs a schema, it is never inferred.
    """
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs an explicit schema")
        df = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return missing_to_null(df)


def read_wave_sheet(df: DataFrame, coords: DataFrame, month: bool = False) -> DataFrame:
    """Headerless wide sheet (year, [month,] one column per point) to long.

    ``coords`` gives, per 0-based position ``pos``, the point's GOWLon and GOWLat.
    Columns are matched by position, so repeated coordinates stay separate.
    """
    ids = ["Year", "Month"] if month else ["Year"]
    points = len(df.columns) - len(ids)
    sheet = df.toDF(*ids, *[f"X_{i}" for i in range(points)])
    long = positional_long(sheet, ids, "measurement")
    # One row per column of the sheet, a width known before the plan runs.
    return long.join(F.broadcast(coords.select("pos", "GOWLon", "GOWLat")), "pos", "left").drop("pos")


def read_wave_file(spark: SparkSession, path: str, coords: DataFrame, month: bool = False, missing: str = "NA") -> DataFrame:
    """A headerless CSV sheet (year, [month,] one column per point) as a long table; ``coords`` as in :func:`read_wave_sheet`."""
    ids = ["Year", "Month"] if month else ["Year"]
    width = coords.count()  # one row per column of the sheet, which gives the file its schema
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ids] + [T.StructField(f"X_{i}", T.DoubleType()) for i in range(width)])
    return read_wave_sheet(spark.read.schema(schema).option("header", False).option("nullValue", missing).csv(path), coords, month)


def read_grid(
    spark: SparkSession, path: str, first_year: int = 1950, last_year: int = 2015,
    sentinel: float = MISSING_SENTINEL,
) -> DataFrame:
    """Long grid (cell, lon, lat, date, value); partitioned by year where the writer did so."""
    return clean_grid(spark.read.parquet(path), first_year, last_year, sentinel)


def clean_grid(
    grid: DataFrame, first_year: int = 1950, last_year: int = 2015, sentinel: float = MISSING_SENTINEL
) -> DataFrame:
    """Rows of the years asked for, the sentinel as missing. Years and dates are compared as ranges, for scans to skip by."""
    if "year" in grid.columns:
        grid = grid.where(F.col("year").between(first_year, last_year))
    return missing_to_null(within_years(grid, "date", first_year, last_year), ["value"], sentinel)


def file_month(file_name: Column) -> Column:
    """First day of the month written in a file name; NULL if there is none."""
    def part(i: int) -> Column:
        return F.regexp_extract(file_name, MONTH_IN_FILE, i).try_cast("int")

    return F.when(part(1).isNotNull() & part(2).between(1, 12), F.make_date(part(1), part(2), F.lit(1)))


def stack_tables(tables: Mapping[str, DataFrame], tag: str = "file") -> DataFrame:
    """Union by name with the source's name as a column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a parquet table, or a CSV table when the path ends in ``.csv``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.parquet(path)
