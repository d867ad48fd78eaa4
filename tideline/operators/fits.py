"""Observations meet the draws of their place within a task: their product is neither shuffled nor written.

Draws are packed, those of a batch and place in one row, and each part of a place's observations gets them all.
The parts are cut by the number of their fits and bounded in number, so what is sent grows with the draws and not with the
product. A task goes through its parts in turn; it holds the draws of one place, or one part's observations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Parts that the observations are cut into besides one per place (or twice as many as cores, if that is more).
MOST_PARTS = 128
#: Observations of a part; a task may hold them.
ROWS_A_PART = 1 << 20
#: Draws that are packed at once, over all places.
PACKED_ROWS = 1 << 17
#: Draws and observations of a block of fits: it stays in a core's cache.
BLOCK = (1 << 12, 1 << 4)


def _packer(place: Sequence[str], sets: Mapping[str, Sequence[str]]):
    """Arrow function: a row per place and batch of draws, with their number and the doubles of each set of columns.

    A draw without one of a set's columns isn't in that set.
    """
    most = PACKED_ROWS

    def packed(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        code = np.zeros(len(table), np.int64)
        for k in place:
            own = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * max(len(own.dictionary), 1) + own.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        columns = {k: table[k].combine_chunks().take(pa.array(order[starts])) for k in place}
        columns["_n"] = pa.array(ends - starts)
        for name, of in sets.items():
            given = np.logical_and.reduce([table[c].is_valid().to_numpy() for c in of])[order]
            values = np.stack([table[c].to_numpy() for c in of])[:, order]
            columns[name] = pa.array([values[:, a:b][:, given[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    return run


def packed(draws: DataFrame, place: Sequence[str], sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """The draws (place, columns of the sets), packed: place, their number _n, and a binary column per set."""
    columns = list(dict.fromkeys(c for of in sets.values() for c in of))
    rows = draws.select(*place, *[F.col(c).cast("double").alias(c) for c in columns])
    schema = T.StructType([*(rows.schema[k] for k in place), T.StructField("_n", T.LongType()),
                           *(T.StructField(name, T.BinaryType()) for name in sets)])
    return rows.mapInArrow(_packer(list(place), {k: list(v) for k, v in sets.items()}), schema)


def met(
    rows: DataFrame, packs: DataFrame, place: Sequence[str], sets: Sequence[str], fits_a_part: int, draws_first: bool, fn, schema: T.StructType,
) -> DataFrame:
    """What an Arrow function makes of the observations (place, obs, x, ..., and _n, their place's draws) and the packed draws.

    It gets the parts one after the other; all draws of a part stand before its observations, or after them.
    """
    places = rows.groupBy(*place).agg(F.sum("_n").alias("_fits"), F.count(F.lit(1)).alias("_rows"), F.max("_n").alias("_size"))
    fits, n = places.agg(F.sum("_fits"), F.count(F.lit(1))).first()
    share = max(fits_a_part, (fits or 0) / max(MOST_PARTS, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    parts = places.select(*place, "_size", F.greatest(
        F.ceil(F.col("_fits") / F.lit(float(share))), F.ceil(F.col("_rows") / ROWS_A_PART)).alias("_parts"))
    tasks = min(math.ceil((fits or 0) / share) + n or 1, 10_000)  # more parts than that share tasks
    place = list(place)
    own = [c for c in rows.columns if c not in (*place, "_n")]
    dealt = rows.join(parts, place).select(
        *place, *own, F.pmod(F.xxhash64(*own), F.col("_parts")).alias("_part"), F.lit(draws_first).alias("_late"))
    sent = packs.select(*place, "_n", *sets).join(parts, place).select(
        *place, "_n", *sets, "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"),
        F.lit(not draws_first).alias("_late"))
    keys = [*place, "_part"]
    both = sent.unionByName(dealt, allowMissingColumns=True).repartition(tasks, *keys).sortWithinPartitions(*keys, "_late")
    return both.mapInArrow(fn(keys, draws_first), schema)


def _runs(keys: Sequence[str], draws_first: bool):
    """Cuts a batch of :func:`met` into (part, whether they are draws, rows)."""
    def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, bool, pa.RecordBatch]]:
        names = map(repr, zip(*(batch.column(k).to_pylist() for k in keys)))
        at = 0
        for (part, late), same in itertools.groupby(zip(names, batch.column("_late").to_pylist())):
            n = sum(1 for _ in same)
            yield part, late != draws_first, batch.slice(at, n)
            at += n

    return runs


def summaries(rows: DataFrame, packs: DataFrame, place: Sequence[str], prefixes: Mapping[str, str], prob: float, fits_a_part: int) -> DataFrame:
    """Per row of (place, obs, x, y, _n): obs, y, and of the fits under each set of draws their mean and shortest interval.

    A set (intercepts, slopes) is named by its column in ``packs``; its results are named by its prefix, and _L, _U. A task
    holds the draws of a place and one observation's fits. Only the fits that an interval may end at are sorted.
    """
    sets = list(prefixes)

    def fn(keys, draws_first):
        runs = _runs(keys, draws_first)

        def shortest(v):
            """The shortest interval as of posterior.hpd_interval; v is reordered."""
            n = len(v)
            gap = max(1, min(n - 1, round(n * prob)))
            if n <= gap:
                return None, None
            ends = n - gap
            if ends <= gap:  # it starts among the least and ends among the largest fits
                v.partition(gap)
                upper, lower = np.sort(v[gap:]), v[:gap]
                lower.partition(ends - 1)
                lower = np.sort(lower[:ends])
            else:
                v.sort()
                lower, upper = v[:ends], v[gap:]
            width = upper - lower
            real = np.flatnonzero(~np.isnan(width))  # NaN is the largest
            at = real[width[real].argmin()] if len(real) else 0
            return float(lower[at]), float(upper[at])

        def summary(draws, x):
            if x is None or not draws.shape[1]:
                return None, None, None
            v = draws[1] * x
            v += draws[0]
            np.exp(v, out=v)
            return float(v.sum() / len(v)), *shortest(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, draws, filled = None, {}, {}
            for batch in batches:
                for part, are_draws, some in runs(batch):
                    if part != now:
                        now, draws = part, {}
                        draws = {s: np.empty((2, some.column("_size")[0].as_py())) for s in sets}
                        filled = dict.fromkeys(sets, 0)
                    if are_draws:
                        for s, value in itertools.product(sets, range(some.num_rows)):
                            got = np.frombuffer(some.column(s)[value].as_buffer()).reshape(2, -1)
                            draws[s][:, filled[s]: filled[s] + got.shape[1]] = got
                            filled[s] += got.shape[1]
                        continue
                    out = {"obs": some.column("obs"), "y": some.column("y")}
                    with np.errstate(all="ignore"):
                        for s in sets:
                            own = draws[s][:, :filled[s]]
                            found = [summary(own, x) for x in some.column("x").to_pylist()]
                            for name, values in zip((prefixes[s], prefixes[s] + "_L", prefixes[s] + "_U"), zip(*found)):
                                out[name] = pa.array(values, pa.float64())
                    yield pa.RecordBatch.from_pydict(out)

        return run

    given = rows.select(*place, "obs", F.col("x").cast("double").alias("x"), "y", "_n")
    schema = T.StructType([given.schema["obs"], given.schema["y"], *(
        T.StructField(p + end, T.DoubleType()) for p in prefixes.values() for end in ("", "_L", "_U"))])
    return met(given, packs, place, sets, fits_a_part, True, fn, schema)


def density_means(rows: DataFrame, packs: DataFrame, place: Sequence[str], fits_a_part: int) -> DataFrame:
    """Per obs of (place, obs, x, y, _n): the means over all draws of resid, y_loc_mu and log_lik, and the number n of draws.

    Each is worked out for each draw and observation, as in posterior.pointwise_loglik, a block of both at a time, and
    added up; missing ones don't count. ``packs`` has the sets own (intercepts, slopes, sd) and mu (intercepts, slopes). A task
    holds the observations of a part and passes over its draws. An obs that comes repeatedly is one.
    """
    counted = ["resid", "y_loc_mu", "log_lik"]
    (many, few), constant = BLOCK, 0.5 * math.log(2 * math.pi)

    def fn(keys, draws_first):
        runs = _runs(keys, draws_first)

        class Part:
            def __init__(self, rows: list[pa.RecordBatch]):
                table = pa.Table.from_batches(rows)
                self.obs = table["obs"].combine_chunks()
                self.x, self.log_y = (table[c].to_numpy() for c in ("x", "log_y"))
                placed = table["x"].is_valid().to_numpy()
                both = placed & table["log_y"].is_valid().to_numpy()
                self.given = {"resid": both, "y_loc_mu": placed, "log_lik": both}
                self.sums = {c: np.zeros(len(table)) for c in counted}
                self.n = dict.fromkeys((*counted, "n"), 0)

            def add(self, own: np.ndarray, mu: np.ndarray):
                """The fits of some draws: own has intercepts, slopes and sd, mu intercepts and slopes."""
                if not own[2].all() and self.given["resid"].any():
                    raise ZeroDivisionError("a draw's sd_e is zero")
                self.n["y_loc_mu"] += mu.shape[1]
                self.n["resid"] += own.shape[1]
                for d, o in itertools.product(range(0, own.shape[1], many), range(0, len(self.x), few)):
                    (a, b, sd), rows = own[:, d: d + many], slice(o, o + few)
                    log_y = self.log_y[rows, None]
                    resid = np.multiply.outer(self.x[rows], b)
                    resid += a
                    np.subtract(log_y, resid, out=resid)
                    resid /= sd
                    self.sums["resid"][rows] += resid.sum(axis=1)
                    likely = ~(sd <= 0)  # the others have no logarithm
                    if not likely.all():
                        resid, sd = resid[:, likely], sd[likely]
                    log_lik = np.multiply(resid, resid, out=resid)
                    log_lik *= -0.5
                    log_lik -= np.log(sd) + constant
                    log_lik -= log_y
                    self.sums["log_lik"][rows] += log_lik.sum(axis=1)
                self.n["log_lik"] += int((~(own[2] <= 0)).sum())
                for d, o in itertools.product(range(0, mu.shape[1], many), range(0, len(self.x), few)):
                    (a, b), rows = mu[:, d: d + many], slice(o, o + few)
                    loc = np.multiply.outer(self.x[rows], b)
                    loc += a
                    self.sums["y_loc_mu"][rows] += loc.sum(axis=1)

            def result(self) -> pa.RecordBatch:
                out = {"obs": self.obs}
                for c in counted:
                    out[c] = pa.array(np.where(self.given[c], self.sums[c], 0.0))
                    out[f"_n_{c}"] = pa.array(self.given[c] * np.int64(self.n[c]))
                return pa.RecordBatch.from_pydict(out | {"n": pa.array(np.full(len(self.x), self.n["n"], np.int64))})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, waiting, met = None, [], None
            for batch in batches:
                for part, are_draws, some in runs(batch):
                    if part != now:
                        if met is not None:
                            yield met.result()
                        now, waiting, met = part, [], None
                    if not are_draws:
                        waiting.append(some.select(["obs", "x", "log_y"]))
                    elif waiting:  # else no observation is in this part
                        met = met or Part(waiting)
                        with np.errstate(all="ignore"):
                            for i in range(some.num_rows):
                                met.n["n"] += some.column("_n")[i].as_py()
                                met.add(*(np.frombuffer(some.column(s)[i].as_buffer()).reshape(k, -1) for s, k in (("own", 3), ("mu", 2))))
            if met is not None:
                yield met.result()

        return run

    given = rows.select(*place, "obs", F.col("x").cast("double").alias("x"), F.log("y").alias("log_y"), "_n")
    schema = T.StructType([given.schema["obs"], *itertools.chain.from_iterable(
        (T.StructField(c, T.DoubleType()), T.StructField(f"_n_{c}", T.LongType())) for c in counted), T.StructField("n", T.LongType())])
    sums = met(given, packs, place, ["own", "mu"], fits_a_part, False, fn, schema)
    return sums.groupBy("obs").agg(
        *[F.try_divide(F.sum(c), F.sum(f"_n_{c}")).alias(c) for c in counted], F.sum("n").alias("n"))
