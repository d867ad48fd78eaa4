"""Scalar expressions used across the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def text_key(*parts: str | Column, sep: str = ":") -> Column:
    """Compound text key of several columns."""
    return F.concat_ws(sep, *parts)


def dotted_date(text: Column) -> Column:
    """Date written as ``yyyy.MM.dd``, with or without a leading ``X``."""
    return F.to_date(F.regexp_replace(text, "^X", ""), "yyyy.MM.dd")


def rotate_longitude(lon: Column) -> Column:
    """0..360 degrees to -180..180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def precision(se: Column) -> Column:
    """1/se, NULL for a standard error of zero."""
    return F.try_divide(F.lit(1.0), se)


def interval_width(lower: Column, upper: Column) -> Column:
    return upper - lower


def offset(value: Column, by: float = 0.001) -> Column:
    """Small shift that keeps a logarithm defined at zero."""
    return value + F.lit(by)


def _edge(x: float) -> str:
    return f"{x:.3g}"


def pretty_cut(value: Column, breaks: Sequence[float], suffix: str = "") -> Column:
    """Right-closed bins labelled ``lo - hi``; the lowest edge itself is NULL."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(breaks[:-1], breaks[1:]):
        out = F.when((value > lo) & (value <= hi), f"{_edge(lo)} - {_edge(hi)}{suffix}").otherwise(out)
    return out


def data_cut(df: DataFrame, column: str, inner: Sequence[float], name: str, suffix: str = "") -> DataFrame:
    """Right-closed bins whose outer breaks are the column's least and greatest value.

    The lowest value itself is in no bin; breaks outside the range split nothing off.
    """
    def edge(x: Column) -> Column:
        # three significant digits without closing zeros, as the fixed breaks are shown
        text = F.format_string("%.2e", x)
        power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
        plain = F.regexp_replace(text.cast("double").cast("decimal(20,8)").cast("string"), r"\.?0+$", "")
        return F.when(power.between(-4, 2), plain).otherwise(F.regexp_replace(text, r"\.?0+e", "e"))

    ends = df.agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    breaks = F.array_sort(F.filter(
        F.array(F.col("_low"), *[F.lit(float(b)) for b in inner], F.col("_high")),
        lambda b: (b >= F.col("_low")) & (b <= F.col("_high"))))
    value = F.col(column)
    below = F.array_max(F.filter("_breaks", lambda b: b < value))
    above = F.array_min(F.filter("_breaks", lambda b: b >= value))
    return df.crossJoin(F.broadcast(ends)).withColumn("_breaks", breaks).withColumn(  # one row, by construction
        name, F.when(below.isNotNull(), F.concat(edge(below), F.lit(" - "), edge(above), F.lit(suffix)))
    ).drop("_low", "_high", "_breaks")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin of n equal-width right-closed bins, the lowest edge included."""
    position = F.try_divide((value - low) * bins, high - low)
    return F.when(
        value.isNotNull(),
        F.coalesce(F.least(F.greatest(F.ceil(position), F.lit(1)), F.lit(bins)), F.lit(1)).cast("int"),
    )


def two_way(value: Column, threshold: float, below: str, otherwise: str) -> Column:
    """Label by side of a threshold; missing stays missing."""
    return F.when(value < threshold, below).when(value.isNotNull(), otherwise)


def signed_label(value: Column, digits: int, negative: str, positive: str, unit: str) -> Column:
    """``negative`` or ``positive`` word, the rounded number and its unit."""
    shown = F.bround(value, digits)
    word = F.when(shown < 0, negative).when(shown.isNotNull(), positive)
    return F.concat(word, F.format_string(f"%.{digits}f", shown), F.lit(unit))


def latitude_label(value: Column, prefix: str = "", suffix: str = "°") -> Column:
    return F.concat(F.lit(prefix), F.bround(value, 0).cast("long").cast("string"), F.lit(suffix))


# Names of the five latitude bands of the effect surface.
LATITUDE_BANDS = {
    21: "Baja,\n Peru",
    32: "Japan,\n W. Australia",
    43: "Gulf of Maine,\n Tasmania",
    55: "Northern Canada,\n Southern Chile",
    66: "Norway,\n Northern Alaska",
}


def classify_change(lower: Column, upper: Column) -> Column:
    """Gain or Loss when the interval excludes zero on one side, else No change."""
    total = F.signum(lower) + F.signum(upper)
    return F.when(total < 0, "Loss").when(total > 0, "Gain").otherwise("No change")


def name_latitude(value: Column) -> Column:
    """Band name of a rounded latitude; a latitude without a name keeps its number."""
    rounded = F.bround(value, 0).cast("int")
    out = rounded.cast("string")
    for lat, name in LATITUDE_BANDS.items():
        out = F.when(rounded == lat, name).otherwise(out)
    return out
