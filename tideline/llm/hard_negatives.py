"""Hard negatives by cover trees.

For an anchor and each of its nearest rows of the same label (positives), the rows of other labels are
wanted whose score lies just below the positive's. Scores are integer inner products, results are exact.

The top of the tree is a fixed number of centers, picked farthest first from a bounded sample; every row
goes to its nearest center and, by its id, to one of the center's blocks of bounded size. Each block is a
cover tree of its own. An anchor first meets the blocks of its own center, which gives a score that its
positives must reach, then those other blocks whose radius lets them reach it, then the blocks whose
bounds cross the windows below its positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.common import checkpointed, map_arrow, query, table
from tideline.llm.cover_tree import CoverTree, angles, augmented, bounds, farthest_first

LARGEST = 1 << 28  # of a scaled component; scores are longs
NO_FLOOR = -(1 << 62)
ROWS = "id long, label long, vector array<int>"


def _vectors(column: pa.Array, dtype=np.int64) -> np.ndarray:
    """A list column as a matrix; shorter lists end with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(lengths.max(initial=0))), dtype)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if lengths.size and (lengths == out.shape[1]).all():
        return values.reshape(out.shape).astype(dtype)
    inside = np.arange(out.shape[1]) < lengths[:, None]
    out[inside] = values
    return out


def numbers(rows: DataFrame, scale: float) -> DataFrame:
    """Rows that take part, one per id: (id, label, vector of floor(scale * x)).

    Left out are rows without id, label or vector, and with a component that is missing, not finite or
    beyond 2^28 when scaled. Of rows with one id the least (label, vector) counts.
    """
    scaled = rows.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                 & (F.abs(x.cast("double") * scale) < float(LARGEST))).alias("sound"))
    sound = scaled.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND sound")
    least = sound.groupBy("id").agg(F.min(F.struct("label", F.col("vector").cast("array<int>").alias("vector"))).alias("row"))
    return least.select("id", "row.label", "row.vector")


class Top:
    """The centers above all blocks, with what each covers. Its size is fixed by the number of centers."""

    def __init__(self, centers: np.ndarray, longest: float):
        self.longest, self.units = longest, augmented(centers, longest)
        self.reach = np.zeros(len(centers))
        self.first = np.zeros(len(centers), np.int64)
        self.parts = np.zeros(len(centers), np.int64)

    def theta(self, vectors: np.ndarray, unit: bool) -> np.ndarray:
        """Angles of rows (with their added component) or of queries (without) to the centers."""
        if unit:
            own = augmented(vectors, self.longest)
            width = min(own.shape[1], self.units.shape[1]) - 1
            return angles(own[:, :width] @ self.units[:, :width].T + own[:, -1:] * self.units[:, -1])
        length = np.maximum(np.sqrt((vectors ** 2).sum(axis=1, keepdims=True)), 1e-300)
        width = min(vectors.shape[1], self.units.shape[1] - 1)
        return angles(vectors[:, :width] / length @ self.units[:, :width].T)

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their nearest center and the angle to it."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                theta = self.theta(_vectors(batch.column("vector"), np.float64), True)
                home = theta.argmin(axis=1)
                away = theta[np.arange(len(theta)), home]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(away)],
                                                 names=[*batch.schema.names, "home", "away"])

        return map_arrow(rows, run, f"{ROWS}, home int, away double")

    def route(self, queries: DataFrame) -> DataFrame:
        """Queries (id, label, vector, home, low, high) with each block, but those at home, that may score within [low, high]."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _vectors(batch.column("vector"), np.float64)
                length = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
                least, most = bounds(length, self.longest, self.theta(vectors, False), self.reach)
                low, high, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "home"))
                met = (most >= low[:, None]) & (least <= high[:, None]) & (self.parts > 0)
                at_home = np.flatnonzero(home >= 0)
                met[at_home, home[at_home]] = False
                row, center = np.nonzero(met)
                count = self.parts[center]
                row, block = np.repeat(row, count), np.repeat(self.first[center] - np.cumsum(count) + count, count) + np.arange(count.sum())
                for at in range(0, len(row), 4096):
                    part = batch.take(pa.array(row[at: at + 4096]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block[at: at + 4096])],
                                                     names=[*part.schema.names, "block"])

        return map_arrow(queries, run, f"{QUERIES_OF}, block long")


QUERIES_OF = f"{ROWS}, home int, low long, high long, wanted array<long>"


def _searched(blocks: DataFrame, queries: DataFrame, n_blocks: int, searched, schema: str) -> DataFrame:
    """``searched(tree, id, label, vector, low, wanted)`` over the block of each query; rows (id, ...).

    A block's rows come first in its task, then the queries that are sent there, a batch at a time.
    """
    spark = blocks.sparkSession
    both = (
        blocks.selectExpr("block", "id", "label", "vector", "-1 AS kind", "CAST(NULL AS long) AS low", "CAST(NULL AS array<long>) AS wanted")
        .unionByName(queries.selectExpr("block", "id", "label", "vector", "0 AS kind", "low", "wanted"))
    )
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 16, 1)
    both = both.repartition(width, "block").sortWithinPartitions("block", "kind", "id")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tree = None, [], None
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*found) if found else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            found.clear()
            return made

        for batch in batches:
            number = batch.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if number[a] != block:
                    block, parts, tree = number[a], [], None
                part = batch.slice(a, b - a)
                row_count = int((part.column("kind").to_numpy() < 0).sum())
                if row_count:
                    rows = part.slice(0, row_count)
                    parts.append((rows.column("id").to_numpy(), rows.column("label").to_numpy(), _vectors(rows.column("vector"))))
                if row_count == b - a or not parts:
                    continue
                if tree is None:
                    wide = max(v.shape[1] for _, _, v in parts)
                    tree = CoverTree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                                     np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, _, v in parts]))
                asked = part.slice(row_count)
                lists = zip(*(asked.column(c).to_pylist() for c in ("id", "label", "low", "wanted")))
                for vector, (own, label, low, wanted) in zip(_vectors(asked.column("vector")), lists):
                    found += [(own, *x) for x in searched(tree, own, label, vector, low, wanted)]
                    if len(found) >= 8192:
                        yield out()
        if found:
            yield out()

    return map_arrow(both, run, schema)


def _first(rows: DataFrame, keys: list[str], score: str, ident: str, k: int, rank: str) -> DataFrame:
    """The first k rows of each key by falling score, then id; Spark keeps k per task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


OUTPUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 5,
         percent: int = 80, centers: int = 16, sample_rows: int = 2048, block_rows: int = 1 << 15) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label, vector of numbers).

    For each anchor and each of its first ``positives`` other rows of the same label: the first ``negatives``
    rows of other labels whose score is at least ``percent`` % of the positive's and at most the positive's.
    A score is the inner product of vectors of floor(scale * x), vectors of other lengths being filled up
    with zeros; higher scores come first, ties by smaller id. ``is_anchor``: a condition on the column id.

    Rows without id, label or vector, or with a component that is missing, not finite or 2^28 or more in size
    when scaled, take no part. Repeated ids count once (the least label, then vector). Zero vectors score 0.
    Any number of equal vectors is fine: a node of them has no radius and is a leaf. Other columns, whatever
    their names, are not looked at. Without rows, positives or negatives there is no result. Columns: OUTPUT.

    ``centers``, ``sample_rows``: size of the top of the tree, which is held in memory. ``block_rows``: rows of
    a tree; a task holds one tree and a batch of anchors. Anchors travel, as often as there are blocks that
    their bounds reach.
    """
    spark = rows.sparkSession
    own = checkpointed(numbers(rows, scale))
    longest = own.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))), F.count(F.lit(1))).first()
    n_rows, longest = longest[1], float(longest[0] or 0.0)
    if not n_rows:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in OUTPUT))
    sample = own.orderBy(F.xxhash64("id"), "id").select("vector").limit(sample_rows).toArrow()["vector"].combine_chunks()
    sample = _vectors(sample, np.float64)
    picked = farthest_first(augmented(sample, longest), centers, 0.0)[0]
    top = Top(sample[picked], longest)
    placed = checkpointed(top.place(own))
    size = min(block_rows, max(4096, n_rows // 256))
    covered = placed.groupBy("home").agg(F.max("away").alias("reach"), F.count(F.lit(1)).alias("n_rows")).collect()  # one row per center
    for r in covered:
        top.reach[r["home"]], top.parts[r["home"]] = r["reach"] + 1e-7, -(-r["n_rows"] // size)
    top.first = np.cumsum(top.parts) - top.parts
    of_center = F.array(*[F.lit(int(x)) for x in top.first]), F.array(*[F.lit(int(x)) for x in top.parts])
    first, parts = (F.get(x, F.col("home")).cast("long") for x in of_center)
    blocks = placed.withColumn("block", first + F.pmod(F.xxhash64("id"), parts))
    n_blocks = int(top.parts.sum())
    anchors = placed.where(is_anchor)

    def like(tree, own, label, vector, low, wanted):
        return [(i, s) for s, i in tree.nearest_of_label(vector, label, own, positives, low)]

    likes = "anchor_id long, other_id long, score long"
    home = anchors.withColumn("block", F.explode(F.sequence(first, first + parts - 1))).selectExpr(
        "*", f"CAST({NO_FLOOR} AS long) AS low", "CAST(NULL AS array<long>) AS wanted")
    near = checkpointed(_first(_searched(blocks, home, n_blocks, like, likes), ["anchor_id"], "score", "other_id", positives, "place"))
    floors = near.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    reached = anchors.join(floors, anchors["id"] == floors["anchor_id"], "left").select(
        "id", "label", "vector", "home", F.when(F.col("n") == positives, F.col("least")).otherwise(F.lit(NO_FLOOR)).alias("low"),
        F.lit(-NO_FLOOR).alias("high"), F.expr("CAST(NULL AS array<long>)").alias("wanted"))
    far = _searched(blocks, top.route(reached), n_blocks, like, likes)
    best = checkpointed(_first(near.drop("place").unionByName(far), ["anchor_id"], "score", "other_id", positives, "place"))

    lows = best.groupBy("anchor_id").agg(F.sort_array(F.collect_set("score")).alias("wanted"))  # at most ``positives`` scores
    lows = lows.withColumn("tops", F.array_max("wanted"))
    asked = anchors.join(lows, anchors["id"] == lows["anchor_id"]).where("tops >= 0").select(
        "id", "label", "vector", F.lit(-1).alias("home"),
        F.array_min(F.transform(F.filter("wanted", lambda s: s >= 0), lambda s: F.floor((s - s % 100) / 100) * percent)).alias("low"),
        F.col("tops").alias("high"), "wanted")

    def windows(tree, own, label, vector, low, wanted):
        spans = [(-(-percent * s // 100), s) for s in wanted if s >= 0]  # a negative score has an empty window
        hits = tree.windows_of_other_labels(vector, label, spans, negatives)
        return [(top_score, i, s) for (_, top_score), w in zip(spans, hits) for s, i in w]

    unlike = _searched(blocks, top.route(asked), n_blocks, windows, "anchor_id long, positive_score long, negative_id long, negative_score long")
    unlike = _first(unlike, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives, "rank")
    pairs = best.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(unlike, ["anchor_id", "positive_score"]).select(*OUTPUT)


SQL = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM parts a JOIN parts r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark, sf_dir):
    """The first negatives just below each of the first positives of every hundredth vector, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)
