"""Joins in which a missing key matches a missing key.

No side is hinted unless its size is fixed by construction; the adaptive planner
broadcasts on measured size and splits skewed partitions of the other joins.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.semantics import KEY_DIGITS, coord_key, named

log = logging.getLogger(__name__)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Column names of both sides, in the left side's order; none is an error."""
    there = set(right.columns)
    names = [c for c in left.columns if c in there]
    if not names:
        raise ValueError(f"no shared columns: {left.columns} and {right.columns}")
    log.info("joining by %s", names)
    return names


def natural_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool = True
) -> DataFrame:
    """Equi-join keeping one copy of each key; keys are coalesced for right and full."""
    on = list(on)
    op = "<=>" if null_safe else "="
    kept = [c for c in right.columns if c not in set(on)]
    tagged = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    joined = left.join(tagged, F.expr(" AND ".join(f"`{c}` {op} `_r_{c}`" for c in on)), how)
    if how in ("left_semi", "left_anti"):
        return joined
    side = {"right": "`_r_{c}` AS `{c}`", "full": "coalesce(`{c}`, `_r_{c}`) AS `{c}`"}.get(how, "`{c}`")
    keys = {c: side.format(c=c) for c in on}
    return joined.selectExpr(*[keys.get(c, f"`{c}`") for c in left.columns], *[f"`{c}`" for c in kept])


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = True) -> DataFrame:
    """Left join on all shared column names."""
    return natural_join(left, right, shared_columns(left, right), "left", null_safe)


def reduce_left_join(frames: Iterable[DataFrame]) -> DataFrame:
    """Fold a list of tables with the natural left join, left to right."""
    return reduce(natural_left_join, frames)


def full_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return natural_join(left, right, shared_columns(left, right), "full")


def right_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return natural_join(left, right, shared_columns(left, right), "right")


def keyed_left_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], prefer_right: Sequence[str] = ()
) -> DataFrame:
    """Left join by named keys; of other shared columns, keep the right-hand copy if asked."""
    by = list(by)
    clashing = [c for c in left.columns if c in right.columns and c not in by]
    undecided = sorted(set(clashing) - set(prefer_right))
    if undecided:
        raise ValueError(f"columns on both sides without a rule: {undecided}")
    return natural_join(left.drop(*clashing), right, by, "left")


def join_as(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left") -> DataFrame:
    """Join on differently named keys; the right-hand key is dropped."""
    return natural_join(left, right.withColumnsRenamed({r: l for l, r in pairs.items()}), list(pairs), how)


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Rows of the left side without a partner."""
    return natural_join(left, right, on or shared_columns(left, right), "left_anti")


def unmatched_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys without a partner."""
    return unmatched(left.select(*on).distinct(), right, on)


def keep_matching(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """All left rows whose key occurs on the right."""
    return natural_join(left, right, on, "left_semi")


def tag_each(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Every row once per label: the product with a literal list, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table, such as a global aggregate.

    The row goes through an aggregate here, so the product has one row per row of ``df``
    whatever is passed: no row gives NULLs, more than one is an error.
    """
    once = one_row.agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row to attach"))).alias("_many"),
        F.first(F.struct(*[named(c) for c in one_row.columns])).alias("_row"))
    return df.crossJoin(F.broadcast(once)).where(F.col("_many").isNull()).select(
        *[named(c) for c in df.columns], *[F.col("_row")[c].alias(c) for c in one_row.columns])


def rounded_coord_join(
    left: DataFrame,
    right: DataFrame,
    coords: Sequence[str] = ("Latitude", "Longitude"),
    also: Sequence[str] = (),
    digits: int = KEY_DIGITS,
    how: str = "left",
) -> DataFrame:
    """Join on coordinates rounded to integer keys, plus exact keys."""
    keys = {f"_k_{c}": coord_key(F.col(c), digits) for c in coords}
    r = right.withColumns(keys).drop(*coords)
    out = natural_join(left.withColumns(keys), r, [*keys, *also], how)
    return out.drop(*keys)
