"""Cover trees and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm.cover_tree import CoverTree, angles, augmented, bounds, farthest_first
from tideline.llm.hard_negatives import OUTPUT, mine


def vectors(kind, n, d, r):
    if kind == "spread":
        return r.integers(-100, 100, (n, d))
    if kind == "clusters":
        return r.integers(-200, 200, (6, d))[r.integers(0, 6, n)] + r.integers(-5, 6, (n, d))
    if kind == "copies":
        return r.integers(-3, 4, (4, d))[r.integers(0, 4, n)]
    if kind == "zeros":
        return np.zeros((n, d), np.int64)
    if kind == "huge":
        return r.integers(-(1 << 27), 1 << 27, (n, d))
    lengths = np.exp(r.normal(size=(n, 1)) * 3)
    return (r.normal(size=(n, d)) * lengths).astype(np.int64)


KINDS = ["spread", "clusters", "copies", "zeros", "huge", "lengths"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("fanout, leaf", [(3, 4), (8, 40)])
def test_tree_against_all_rows(kind, fanout, leaf):
    r = np.random.default_rng(7)
    n, d = 300, 6
    v, labels, ids = vectors(kind, n, d, r), r.integers(0, 3, n), r.permutation(n) * 3
    tree = CoverTree(ids, labels, v, fanout, leaf)
    assert sorted(tree.ids.tolist()) == sorted(ids.tolist())
    for a in range(0, n, 11):
        q = np.array([sum(int(x) * int(y) for x, y in zip(v[a], w)) for w in v])
        order = [k for k in np.lexsort((ids, -q))]
        like = [(int(q[k]), int(ids[k])) for k in order if labels[k] == labels[a] and k != a][:5]
        assert tree.nearest_of_label(v[a], labels[a], ids[a], 5) == like
        if len(like) == 5:
            assert tree.nearest_of_label(v[a], labels[a], ids[a], 5, like[2][0]) == [x for x in like if x[0] >= like[2][0]]
        spans = [(s // 2, s) for s, _ in like] + [(-10 ** 17, 10 ** 17), (5, 4)]
        want = [[(int(q[k]), int(ids[k])) for k in order if labels[k] != labels[a] and low <= q[k] <= high][:5] for low, high in spans]
        assert tree.windows_of_other_labels(v[a], labels[a], spans, 5) == want


@pytest.mark.parametrize("kind", KINDS[:3] + KINDS[5:])
def test_radii_cover_and_bounds_hold(kind):
    r = np.random.default_rng(2)
    v = vectors(kind, 400, 5, r)
    tree = CoverTree(np.arange(400), np.zeros(400, np.int64), v, 4, 10)
    units = augmented(tree.vectors, tree.longest)
    centers = np.concatenate([tree.center, np.sqrt(np.maximum(1 - (tree.center ** 2).sum(axis=1, keepdims=True), 0))], axis=1)
    for node in range(len(tree.start)):
        inside = slice(tree.start[node], tree.stop[node])
        assert angles(units[inside] @ centers[node]).max() <= tree.radius[node] + 1e-6
        query = r.normal(size=5) * 50
        length = np.sqrt((query ** 2).sum())
        low, high = bounds(length, tree.longest, angles(tree.center[[node]] @ (query / length)), tree.radius[[node]])
        scores = tree.vectors[inside] @ query
        assert low[0] <= scores.min() and scores.max() <= high[0]
        if tree.count[node]:
            kids = range(tree.first[node], tree.first[node] + tree.count[node])
            assert sum(tree.stop[k] - tree.start[k] for k in kids) == tree.stop[node] - tree.start[node]


def test_clusters_are_skipped():
    """A query that meets one of many tight clusters reads few rows."""
    r = np.random.default_rng(1)
    v = r.integers(-1000, 1000, (40, 16))[np.repeat(np.arange(40), 100)] + r.integers(-2, 3, (4000, 16))
    tree = CoverTree(np.arange(4000), np.zeros(4000, np.int64), v, 8, 100)
    read = []
    scores = tree._scores
    tree._scores = lambda q, a, b: read.append(b - a) or scores(q, a, b)
    for a in range(0, 4000, 400):
        tree.nearest_of_label(v[a], 0, a, 5)
    assert sum(read) < 10 * 4000 / 5


def test_centers_end_when_all_are_near():
    units = augmented(np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]]), 1.0)
    assert farthest_first(units, 9, 0.0)[0] == [0, 2]


def by_hand(rows, every, scale=256, positives=5, negatives=5, percent=80):
    """Plain Python over (id, label, vector) rows."""
    sound = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) or abs(x * scale) >= 1 << 28 for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        sound[i] = min(sound.get(i, row), row)
    out = []
    for a, (label, v) in sound.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in sound.items() if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if sound[i][0] == label][:positives]:
            s = score[p]
            hits = [i for i in first if sound[i][0] != label and percent * s <= 100 * score[i] <= 100 * s]
            out += [(a, p, k + 1, i, s, score[i]) for k, i in enumerate(hits[:negatives])]
    return sorted(out)


SCHEMA = "id long, label long, vector array<double>"


def mined(spark, rows, every=10, schema=SCHEMA, **more):
    out = mine(spark.createDataFrame(rows, schema), F.col("id") % every == 0, **more)
    assert tuple(out.columns) == OUTPUT
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("more", [{}, {"block_rows": 17, "centers": 5, "sample_rows": 40}, {"positives": 2, "negatives": 1, "percent": 50}])
def test_mined_against_brute_force(spark, more):
    r = np.random.default_rng(3)
    hot = (r.normal(size=8) / 3).tolist()
    rows = [(i, int(i % 4), hot if i % 3 == 0 else (r.normal(size=8) / 3).tolist()) for i in range(260)]
    hand = {k: v for k, v in more.items() if k in ("positives", "negatives", "percent")}
    assert mined(spark, rows, **more) == by_hand(rows, 10, **hand)


def test_awkward_vectors(spark):
    r = random.Random(4)
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None], [3e6, 1.0], [1.0], [0.5, 0.25, 4.0, -1.0], [-1.0, -1.0], [9e5, 9e5]]
    rows = [(k, k % 2, v) for k, v in enumerate(odd)] + [(None, 1, [1.0, 1.0]), (40, None, [1.0, 1.0])]
    rows += [(k, k % 3, [r.uniform(-1, 1), r.uniform(-1, 1)]) for k in range(50, 80)]
    rows += [(60, 1, [0.5, 0.5]), (60, 1, [0.5, 0.5]), (60, 0, [0.7, 0.1])] * 30  # one id holds most rows
    clash = [(*x, 1, "a", 2.0, 3) for x in rows]
    got = mined(spark, clash, schema=SCHEMA + ", home int, block string, score double, anchor_id int", block_rows=9, centers=3)
    assert got == by_hand(rows, 10) and got
    assert mined(spark, []) == [] and mined(spark, [(None, None, None)]) == []
    assert mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.0])]) == []


def test_equal_vectors_and_floats(spark):
    rows = [(i, i % 2, [0.1, -0.3]) for i in range(120)]
    assert mined(spark, rows, 50, "id long, label int, vector array<float>", block_rows=30) == [
        (a, p, k + 1, 1 + 2 * k, 25 * 25 + 77 * 77, 25 * 25 + 77 * 77)
        for a in (0, 50, 100) for p in [i for i in range(0, 14, 2) if i != a][:5] for k in range(5)]
