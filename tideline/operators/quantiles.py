"""Exact quantiles and ranks that survive a group holding most of the rows.

Rows are sorted by group and value over all tasks; a range partitioning cuts a large group, and a run of
equal values, wherever its share of the rows is full. What a task holds of a group is a run of
consecutive numbers, so a rank is found from the runs' lengths, and no task sees a group. There is one way
for groups of any size: nothing is sketched, and no group's size is looked at first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import natural_join
from .materialize import written

_PART_BITS = 33  # monotonically_increasing_id: the row within its task, below the task


class SortedRuns:
    """The rows of (keys, value), sorted, numbered and written, and the run that each task has of each group.

    Missing values are kept, after all others, without a rank.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], value: str):
        self.keys = list(keys)
        rows = df.select(*[F.col(f"`{k}`") for k in self.keys], F.col(f"`{value}`").cast("double").alias("_v"))
        # the row's number before the sort lets equal rows be cut apart
        order = [F.col(f"`{k}`") for k in self.keys] + [F.col("_v").asc_nulls_last()]
        dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie")
        self.rows = written(
            dealt.drop("_tie").sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))

    def runs(self) -> DataFrame:
        """(keys, _part, _first, _count, _before, n): where a run starts, its values, those of the group before it and in all.

        The windows see a row per task that has some of the group.
        """
        own = _names(self.keys)
        return self.rows.sparkSession.sql(
            f"""
            WITH r AS (SELECT {own}, shiftright(_at, {_PART_BITS}) AS _part, min(_at) AS _first, count(_v) AS _count
                       FROM {{rows}} GROUP BY {own}, shiftright(_at, {_PART_BITS}))
            SELECT *, coalesce(sum(_count) OVER (PARTITION BY {own} ORDER BY _part
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before,
                   sum(_count) OVER (PARTITION BY {own}) AS n FROM r
            """, rows=self.rows)


def _names(keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}`" for k in keys)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], extra: Sequence[Column] = (),
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs``.

    ``extra`` are further aggregate columns over the same groups. A group without a value has missing
    quantiles. The rows are sorted once; then only the rows at the wanted ranks are looked up.
    """
    keys = list(keys)
    own = _names(keys)
    sorted_rows = SortedRuns(df, keys, value)
    # both order statistics (0-based) that each quantile lies between, and the step from the lower to the upper
    wanted = ", ".join(
        f"named_struct('_i', {2 * i + side}, '_rank', CAST({f}({float(p)!r}D * (n - 1)) AS BIGINT),"
        f" '_step', {float(p)!r}D * (n - 1) - floor({float(p)!r}D * (n - 1)))"
        for i, p in enumerate(probs.values()) for side, f in enumerate(("floor", "ceil")))
    sides = ", ".join(f"max(CASE WHEN _i = {k} THEN _v END) AS _s{k}" for k in range(2 * len(probs)))
    steps = ", ".join(f"max(CASE WHEN _i = {2 * i} THEN _step END) AS _t{i}" for i in range(len(probs)))
    values = ", ".join(f"_s{2 * i} + (_s{2 * i + 1} - _s{2 * i}) * _t{i} AS `{name}`" for i, name in enumerate(probs))
    wide = df.sparkSession.sql(
        f"""
        WITH w AS (
          SELECT {own}, _first, _before, inline_outer(filter(array({wanted}), w -> w._rank BETWEEN _before AND _before + _count - 1))
          FROM {{runs}}),
        found AS (
          SELECT {own}, _i, _step, _v FROM (SELECT *, _first + _rank - _before AS _at FROM w) AS asked
          LEFT JOIN (SELECT _at AS _there, _v FROM {{rows}}) AS r ON asked._at = r._there),
        wide AS (SELECT {own}, {sides}, {steps} FROM found GROUP BY {own})
        SELECT {own}, {values} FROM wide
        """, runs=sorted_rows.runs(), rows=sorted_rows.rows)
    return natural_join(df.groupBy(*[f"`{k}`" for k in keys]).agg(*extra), wide, keys, "left") if extra else wide


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The non-missing values (keys, _v) with a number of their group, their rank in it (from 1, all different), and its size n."""
    runs = SortedRuns(df, keys, value)
    own = list(runs.keys)
    group = F.min("_first").over(Window.partitionBy(*[f"`{k}`" for k in own]))
    placed = runs.runs().select("*", group.alias("_group")).select(
        *[F.col(f"`{k}`").alias(f"_key_{k}") for k in own], F.col("_part").alias("_of"), "_first", "_before", "_group", "n")
    rows = runs.rows.where("_v IS NOT NULL").withColumn("_part", F.shiftright("_at", _PART_BITS))
    same = (F.col("_part") == F.col("_of"))
    for k in own:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`"))
    return rows.join(placed, same).select(
        *[F.col(f"`{k}`") for k in own], "_v", "_group", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("_rank"), "n")
