"""Quantiles of effects over a grid by radix selection: counts travel, effects don't.

An effect is a sum of coefficients times products of axis values: one matrix product of a batch of draws
with the grid's products. Each round counts 16 further bits of an order-preserving image of the effects,
among those that share the bits that are known of a wanted rank; at most four rounds know all 64.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

DIGIT, ROUNDS = 16, 4
CELLS = 1 << 21  # effects that a task holds at once
COUNTS = "point long, target long, digit long, n long, low long, high long, total double"


def image(values: np.ndarray) -> np.ndarray:
    """A long for each double, in the order of the doubles; both zeros are one."""
    bits = values.view(np.int64)
    return np.where(bits < 0, -(bits & np.int64(0x7FFF_FFFF_FFFF_FFFF)), bits)


def value_of(images: np.ndarray) -> np.ndarray:
    """The double of an image."""
    return np.where(images < 0, -np.abs(images).view(np.float64), np.abs(images).view(np.float64))


def _counter(products: np.ndarray, known: np.ndarray | None, left: int):
    """Arrow function: rows (point, target, digit, n, low, high, total) of the draws of a task.

    Of effects at a point, those that share the known bits of the target count; in the first round all do, as
    target 0, and their total is added up. low and high are the least and largest image that counted.
    """
    cells, digit = CELLS, DIGIT

    def image_of(values):
        bits = values.view(np.int64)
        return np.where(bits < 0, -(bits & np.int64(0x7FFF_FFFF_FFFF_FFFF)), bits)

    def reduced(parts):
        """One entry per key of (keys, counts, lows, highs)."""
        keys, n, low, high = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(starts):
            return keys, n, low, high
        return (keys[starts], np.add.reduceat(n[order], starts), np.minimum.reduceat(low[order], starts),
                np.maximum.reduceat(high[order], starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_points = products.shape[1]
        targets = 1 if known is None else known.shape[1]
        totals = np.zeros(n_points)
        parts, fresh = [tuple(np.zeros(0, np.int64) for _ in range(4))], 0
        for batch in batches:
            draws = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
            draws = draws[~np.isnan(draws).any(axis=1)]  # a missing coefficient leaves no effect
            step = max(cells // max(n_points, 1), 1)
            for at in range(0, len(draws), step):
                effects = draws[at: at + step] @ products
                whole = image_of(effects)
                if known is None:
                    totals += effects.sum(axis=0)
                    met = [(whole.ravel(), ((whole >> left) + (1 << 15) + (np.arange(n_points) << digit)).ravel())]
                else:
                    met = []
                    for target in range(targets):
                        row, point = np.nonzero((whole >> (left + digit)) == known[:, target])
                        own = whole[row, point]
                        met.append((own, (own >> left & (1 << digit) - 1) + (point * targets + target << digit)))
                for own, key in met:
                    parts.append(reduced([(key, np.ones(len(key), np.int64), own, own)]))
                    fresh += len(parts[-1][0])
                if fresh > 1 << 20:
                    parts, fresh = [reduced(parts)], 0
        keys, n, low, high = reduced(parts)
        place, bits = keys >> digit, keys & (1 << digit) - 1
        point, target = place // targets, place % targets
        total = np.zeros(len(keys))
        if known is None and len(keys):
            opens = np.unique(point, return_index=True)[1]
            total[opens] = totals[point[opens]]
            bits = bits - (1 << 15)
        columns = {"point": point, "target": target, "digit": bits, "n": n, "low": low, "high": high, "total": total}
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at: at + (1 << 16)]) for x in columns.values()], names=list(columns))

    return run


def counted_quantiles(
    draws: DataFrame, grid: Mapping[str, Sequence[float]], terms: Mapping[str, Sequence[str]],
    probs: Mapping[str, float], name: str,
) -> DataFrame:
    """One row per point of the ``grid`` (axis values by name): its axis values, the mean effect and its quantiles.

    ``terms`` tells the axes that each coefficient (a column of ``draws``) is multiplied with. The draws are
    read once a round, in four rounds at most; a round's shuffle has at most one row per task, point, wanted rank and digit that
    occurs. Two ranks per point and quantile come to the driver and go out again, so the grid must
    be of a checked size. Draws with a missing coefficient have no effect; without any there is no row.
    """
    spark = draws.sparkSession
    points = list(itertools.product(*grid.values()))
    axes = {n: np.array([p[k] for p in points], np.float64) for k, n in enumerate(grid)}
    products = np.stack([np.prod([np.ones(len(points)), *(axes[a] for a in of)], axis=0) for of in terms.values()])
    rows = draws.select(*[F.col(f"`{c}`").cast("double") for c in terms]).repartition(spark.sparkContext.defaultParallelism)
    left, known, rank, step = 64, None, None, None
    for _ in range(ROUNDS):
        left -= DIGIT
        counts = rows.mapInArrow(_counter(products, known, left), COUNTS)
        summed = counts.groupBy("point", "target", "digit").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
        if known is None:
            # the shares of a point's draws below each digit tell both ranks that a quantile lies between
            group = Window.partitionBy("point")
            upto = F.sum("n").over(group.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
            every = summed.select("point", "digit", "n", "low", "high", upto.alias("upto"), F.sum("n").over(group).alias("size"),
                                  F.sum("total").over(group).alias("total"))
            sides = [f(F.lit(float(p)) * (F.col("size") - 1)).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]
            wanted = F.array(*[F.struct(F.lit(k).alias("target"), s.alias("rank")) for k, s in enumerate(sides)])
            picked = every.select("*", F.explode(wanted).alias("w")).select("point", "w.*", "digit", "n", "low", "high", "upto", "size", "total")
        else:
            asked = pa.table({"point": np.repeat(np.arange(len(points)), rank.shape[1]),
                              "target": np.tile(np.arange(rank.shape[1]), len(points)), "rank": rank.ravel()})
            group = Window.partitionBy("point", "target").orderBy("digit")
            upto = F.sum("n").over(group.rowsBetween(Window.unboundedPreceding, 0))
            picked = summed.select("point", "target", "digit", "n", "low", "high", upto.alias("upto")).join(
                F.broadcast(spark.createDataFrame(asked)), ["point", "target"])  # as many rows as known ranks
        picked = picked.where(F.col("rank").between(F.col("upto") - F.col("n"), F.col("upto") - 1))
        found = picked.select("*", (F.col("rank") - F.col("upto") + F.col("n")).alias("inside")).toArrow()
        column = {c: found[c].to_numpy() for c in found.column_names}
        if not len(found):
            break
        if known is None:
            known = np.zeros((len(points), 2 * len(probs)), np.int64)
            rank, size, total = known.copy(), np.zeros(len(points), np.int64), np.zeros(len(points))
            size[column["point"]], total[column["point"]] = column["size"], column["total"]
        spot = (column["point"], column["target"])
        known[spot] = (known[spot] << DIGIT) + column["digit"]
        rank[spot] = column["inside"]
        if (column["low"] == column["high"]).all():  # nothing else shares the bits: they are all known
            known[spot] = column["low"]
            break
    schema = ", ".join(f"`{c}` double" for c in (*grid, name, *probs))
    if known is None:
        return spark.createDataFrame([], schema)
    bounds, results = value_of(known), {}
    for k, (quantile, p) in enumerate(probs.items()):
        place = float(p) * (size - 1)
        low, high = bounds[:, 2 * k], bounds[:, 2 * k + 1]
        results[quantile] = low + (high - low) * (place - np.floor(place))
    return spark.createDataFrame(pa.table({**axes, name: total / size, **results}), schema)
