"""The n-gram join, connected components and the toxicity classifier."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from small import LOWER, WORD, documents, edge_tables, story

from tideline.llm import ngram_join, toxicity
from tideline.llm.common import QUERIES
from tideline.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def by_brute_force(docs, n, percent):
    """component by doc_id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in docs}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_join_query_against_brute_force(spark):
    rows = QUERIES["op4_ngram_jaccard_join"](spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == by_brute_force(docs, 3, 90)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_join_of_many_near_copies(spark, n, percent, monkeypatch):
    """Groups of copies with one to six changed words: many pairs lie close to the threshold."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 7)  # several blocks a list
    r = np.random.default_rng(n)
    texts = []
    for base in range(4):
        words = story(base, 150).split()
        for _ in range(20):
            copy = list(words)
            for at in r.integers(0, len(copy), r.integers(0, 7)):
                copy[at] = f"new{r.integers(1000)}"
            texts.append(" ".join(copy))
    rows = ngram_join.jaccard_join(documents(spark, texts), n=n, percent=percent).collect()
    expected = by_brute_force(list(enumerate(texts)), n, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == expected
    assert 4 < len({c for _, c in expected.values()}) < 80 or percent != 90


def test_join_keeps_its_numbers_when_files_are_split_otherwise(spark, monkeypatch):
    """Between the links and their use, written rows are read in other parts, as with other executors."""
    texts = [story(k, 200) for k in range(60)]
    texts += [t + " more" for t in texts[::2]]
    size, found = "spark.sql.files.maxPartitionBytes", ngram_join.components
    before = spark.conf.get(size)

    def then_split(links):
        out = found(links)
        spark.conf.set(size, "2000")
        return out

    monkeypatch.setattr(ngram_join, "components", then_split)
    try:
        rows = ngram_join.jaccard_join(documents(spark, texts), n=3, percent=90).collect()
    finally:
        spark.conf.set(size, before)
    expected = by_brute_force(list(enumerate(texts)), 3, 90)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == expected
    assert len({c for _, c in expected.values()}) == 60


def test_join_edges(spark):
    full, empty = edge_tables(spark)
    clash = full.selectExpr("*", "1 AS n_shingles", "2 AS component_id")
    out = ngram_join.jaccard_join(clash, n=3, percent=90)
    assert out.count() == full.count() and "class_id" in out.columns
    rows = out.collect()
    assert {r.component_id for r in rows if r.doc_id in (18, 19)} == {18}
    assert {r.component_id for r in rows if r.doc_id in (14, 15)} == {14}
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert ngram_join.jaccard_join(empty).count() == 0


def test_one_of_each_group(spark):
    texts = [story(1), story(2), story(1) + " more", "", "", story(2).upper(), story(3)]
    kept = ngram_join.one_of_each_group(documents(spark, [*enumerate(texts), (6, story(3))]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 6]
    assert kept.columns == documents(spark, []).columns


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(201, 202), (202, 203), (203, 201)]
    links += [(7, 7), (None, 3), (5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 201: 201, 202: 201, 203: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(rows[i].predicted, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    toxic = [p for p, y in held if y == 1]
    assert sum(toxic) >= 0.7 * len(toxic)  # three languages have 25 to 60 toxic rows to learn from


def test_toxicity_edges(spark):
    full, empty = edge_tables(spark)
    clash = full.selectExpr("*", "1 AS score", "true AS held_out")
    words = "idiot moron scum trash".split()
    labelled = documents(spark, [(1000 + k, story(k) + (" " + words[k % 4] if k % 2 else "")) for k in range(120)])
    labels = spark.createDataFrame([(1000 + k, k % 2) for k in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(clash.unionByName(labelled, allowMissingColumns=True), labels)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == full.count() + 120 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[1000 + k].predicted == k % 2 for k in range(120)) >= 110
    none = toxicity.score_toxicity(full, labels.limit(0))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_lists_whose_32_bit_sums_collide_are_told_apart(spark):
    """Same number, first and last member, and a 32-bit sum of hashes in common: no such list may stand for the other."""
    from pyspark.sql import functions as F

    low = {r.id: r.h for r in spark.range(1, 4000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("h")).collect()}
    seen = {}
    pair = next((seen[s], (a, b)) for a in low for b in range(a + 1, 4000)
                if seen.setdefault(s := (low[a] + low[b]) % (1 << 32), (a, b)) not in ((a, b),) and not set(seen[s]) & {a, b})
    rows = [(t, node) for t, p in enumerate(pair) for node in (0, *p, 10_000)]
    marks = spark.createDataFrame(rows, "token long, node long").groupBy("token").agg(*ngram_join._membership("node")).collect()
    assert len({tuple(r[c] for c in ngram_join._MEMBERS) for r in marks}) == 2
    assert len({(r["members"], r["first"], r["last"]) for r in marks}) == 1


def test_components_of_long_chains(spark):
    """Links settle late; every chain must be whole."""
    rows = [(1000 * c + k, 1000 * c + k + 1) for c in range(3) for k in range(300)]
    found = components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {1000 * c + k: 1000 * c for c in range(3) for k in range(301)}
