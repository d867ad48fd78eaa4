"""Similarity join on word n-grams by Jaccard likeness, with exact results.

Documents with equal n-gram sets are one class; the join is between classes. N-grams
are ordered by the count of their hash bucket over all documents, rarest first, then by
hash. Two sets that are as like as asked share an n-gram among the first few of that
order, so each class is listed under those n-grams alone (prefix filter). In each list, the
length filter and a suffix filter on parity bitmaps (a bound on how much two sets differ)
leave few members; only these are compared on their whole sets, with the positional filter,
and a pair only in the list of its first common n-gram, so at most once. Lists with the
same members are worked through once. Members that links already join aren't compared
again, so a group of n near copies costs about n verifications and gives n - 1 links, not all
pairs; a list too long for one task is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.common import checkpointed, map_arrow, query, shielded, slices, table
from tideline.llm.components import components
from tideline.llm.word_hashes import Words, grams, mix, words_of

#: Buckets of the n-gram counts: the only table sent to all tasks, 4 bytes a bucket.
COUNT_BUCKETS = 1 << 18
#: Members that one task compares at once; longer lists are dealt out in pairs of blocks.
BLOCK_MEMBERS = 512
#: Bits of the filter that spares texts which no list needs.
FILTER_BITS = 1 << 23


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram of all its words."""
    hashes = words.hashes()
    every = grams(hashes, n)
    out = []
    for at, stop in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        count = stop - at
        if count >= n:
            out.append(np.unique(every[at: stop - n + 1]))
        elif count:
            # the number of words is part of it: no n-gram of n words is meant
            out.append(mix(grams(hashes[at:stop], count) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BUCKETS.bit_length() + 1)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many documents' n-grams fall into each bucket, over all documents (at most 2^32 - 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in slices(batches, text):
            every = shingle_sets(words_of(batch.column(text), lower=True), n)
            counts += np.bincount(_buckets(np.concatenate(every)), minlength=COUNT_BUCKETS)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full])], names=["b", "n"])

    # summed per bucket first: at most COUNT_BUCKETS rows come back, as columns
    summed = map_arrow(docs.select(text), run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNT_BUCKETS, np.uint32)
    out[summed["b"].to_numpy()] = np.minimum(summed["n"].to_numpy(), (1 << 32) - 1)
    return out


def least_common(size: np.ndarray, percent: int) -> np.ndarray:
    """The least n-grams that a set has in common with any set that it links to."""
    return (size * percent + 99) // 100


def linked(common, size_a, size_b, percent: int):
    """100 * |a and b| >= percent * |a or b|."""
    return 100 * common >= percent * (size_a + size_b - common)


class Members:
    """The members of one list: their n-grams, flat, each member's in the global order."""

    def __init__(self, sets: list[np.ndarray], counts: np.ndarray, token: np.uint64, percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        # n-grams as their ranks among those of the list, in the global order
        values, inverse, members = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.lexsort((values, counts[_buckets(values)]))
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        self.members = members[order]
        self.flat = rank[inverse]
        self.token = rank[np.searchsorted(values, token)]
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.before = np.bincount(owner, self.flat < self.token, len(sets)).astype(np.int64)
        self.in_hub = np.zeros(len(values), bool)

    def commonness(self) -> np.ndarray:
        """How many members an n-gram of each member is in, on average."""
        return np.add.reduceat(self.members[self.flat], self.ends[:-1]) / self.size

    def links(self, hub: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that link with the hub and share no n-gram before the token."""
        size, sizes = self.size[hub], self.size[others]
        # positional filter: before the token nothing is common, or the pair belongs to another list
        rest = np.minimum(size - self.before[hub], sizes - self.before[others])
        others = others[linked(rest, size, sizes, self.percent)]
        if not len(others):
            return others
        sizes = self.size[others]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        take = self.flat[np.repeat(self.ends[others] - starts, sizes) + np.arange(sizes.sum())]
        mine = self.flat[self.ends[hub]: self.ends[hub + 1]]
        self.in_hub[mine] = True
        hit = self.in_hub[take]
        self.in_hub[mine] = False
        common = np.add.reduceat(hit.astype(np.int64), starts)
        earlier = np.add.reduceat((hit & (take < self.token)).astype(np.int64), starts)
        return others[(earlier == 0) & linked(common, size, sizes, self.percent)]


def parity_bits(size: int) -> int:
    """Bits of the parity bitmap of a set: the power of two from half the n-grams on, 64 at least.

    So few bits tell unrelated sets apart by far; what comes close is compared as whole sets.
    """
    return max(64, 1 << ((size + 1) // 2 - 1).bit_length()) if size else 64


def parity(grams_: np.ndarray) -> bytes:
    """For each bit, whether an odd number of the set's n-grams falls on it.

    Bitmaps of two sets differ in no more bits than the sets differ in n-grams.
    """
    bits = parity_bits(len(grams_))
    odd = np.bincount((grams_ & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def alike(sizes: np.ndarray, bitmaps: list[bytes], sides: np.ndarray, percent: int) -> np.ndarray:
    """Which members may link with another of the list, by the length and the suffix filter.

    Sizes of linked sets differ little, so bitmaps are compared within a width and with the next,
    whose halves are laid over one another. ``sides``: 0 and 1 for the two blocks of a pair of
    blocks, which alone are compared with one another; 2 for a block that is compared with itself.
    """
    widths = np.array([len(b) for b in bitmaps])
    useful = np.zeros(len(sizes), bool)
    for width in np.unique(widths):
        narrow, wide = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        own = np.frombuffer(b"".join([bitmaps[i] for i in narrow]), np.uint64).reshape(len(narrow), -1)
        rows = np.concatenate([narrow, wide])
        if len(rows) < 2:
            continue
        folded = own
        if len(wide):
            both = np.frombuffer(b"".join([bitmaps[i] for i in wide]), np.uint64).reshape(len(wide), 2, -1)
            folded = np.concatenate([own, both[:, 0] ^ both[:, 1]])
        step = max(1, (1 << 21) // max(folded.size, 1))
        for at in range(0, len(narrow), step):
            mine = narrow[at: at + step]
            a, b = sizes[mine][:, None], sizes[rows][None, :]
            left = linked(np.minimum(a, b), a, b, percent) & (mine[:, None] != rows[None, :])
            left &= (sides[mine][:, None] != sides[rows][None, :]) | (sides[mine][:, None] == 2)
            if not left.any():
                continue
            apart = np.bitwise_count(own[at: at + step, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
            left &= linked((a + b - apart) // 2, a, b, percent)
            useful[mine] |= left.any(axis=1)
            useful[rows] |= left.any(axis=0)
    return useful


def runs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as whole lists: tables in which no list is cut (one has a block's rows at most)."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        keys = [rows.column(k).to_numpy() for k in ("token", "low", "high")]
        border = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        last = int(border[-1]) if len(border) else 0
        if last:
            yield rows.slice(0, last)
        kept = rows.slice(last)
    if kept is not None and kept.num_rows:
        yield kept


def spanning_links(sets: list[np.ndarray], sides: np.ndarray, token: np.uint64, counts: np.ndarray,
                   percent: int) -> list[tuple[int, int]]:
    """Links that join all members which links first met at this n-gram join.

    Hubs are taken by how common their n-grams are among the members: the original of many near
    copies comes first and joins them at once, and what is joined isn't compared again.
    """
    members = Members(sets, counts, token, percent)
    label = np.arange(len(sets))
    waiting = np.ones(len(sets), bool)  # each pair is looked at once, by the hub that comes first
    out: list[tuple[int, int]] = []
    for hub in np.argsort(-members.commonness(), kind="stable").tolist():
        waiting[hub] = False
        apart = waiting & (label != label[hub])
        if sides[hub] != 2:
            apart &= sides != sides[hub]
        if apart.any():
            for other in members.links(hub, np.flatnonzero(apart)).tolist():
                if label[other] != label[hub]:
                    label[label == label[other]] = label[hub]
                    out.append((hub, other))
    return out


def shingled(docs: DataFrame, text: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``docs`` with n_shingles, sig (digest of the set), grams and parity in place of the text.

    grams holds the prefix that a class is listed under, 8 bytes per n-gram; parity the set's bitmap.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_shingles", "sig", "grams", "parity")]
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # fixed size: COUNT_BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in slices(batches, text):
            sets = shingle_sets(words_of(batch.column(text), lower=True), n)
            sigs = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            prefixes = [ordered(s, shared.value)[: len(s) - least_common(len(s), percent) + 1].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(sigs, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(map(parity, sets), pa.binary())],
                names=[*(f.name for f in kept), "n_shingles", "sig", "grams", "parity"])

    schema = T.StructType([*kept, T.StructField("n_shingles", T.LongType()),
                           *(T.StructField(c, T.BinaryType()) for c in ("sig", "grams", "parity"))])
    return map_arrow(docs.select(*[f"`{f.name}`" for f in kept], F.col(text).cast("string").alias(text)), run, schema)


def ordered(grams_: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n-grams, rarest bucket first."""
    return grams_[np.lexsort((grams_, counts[_buckets(grams_)]))]


def listed(classes: DataFrame) -> DataFrame:
    """(token, node): each class under each n-gram of its prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(g, np.int64) for g in batch.column("grams").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])), batch.column("node").take(rows)],
                names=["token", "node"])

    return map_arrow(classes.select("node", "grams"), run, "token long, node long")


def _with_order(tokens: DataFrame, counts: np.ndarray) -> DataFrame:
    """``tokens`` with order: the place of the n-gram (column token) in the global order."""
    shared = tokens.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column("token").to_numpy().view(np.uint64)
            yield batch.append_column("bucket_count", pa.array(shared.value[_buckets(token)].astype(np.int64)))

    counted = map_arrow(tokens, run, T.StructType([*tokens.schema.fields, T.StructField("bucket_count", T.LongType())]))
    unsigned = F.expr("token ^ (-9223372036854775807L - 1L)")
    return counted.withColumn("order", F.struct("bucket_count", unsigned.alias("hash"))).drop("bucket_count")


_MEMBERS = ["members", "mark1", "mark2", "first", "last"]


def _membership(*columns: str) -> list:
    """What tells the members of a list from those of another: number, first, last, and 128 bits of all their hashes."""
    marks = [F.bit_xor(F.xxhash64(F.lit(f"members {k}"), *columns)).alias(f"mark{k}") for k in (1, 2)]
    return [F.count(F.lit(1)).alias("members"), *marks, F.min("node").alias("first"), F.max("node").alias("last")]


def lists_to_compare(places: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, blocks): lists with two members or more, one of those with the same members.

    It is the one whose n-gram is first in the global order, so a pair's first common
    n-gram always stands for the lists that hold the pair and no less.
    """
    found = places.groupBy("token").agg(*_membership("node")).where("members > 1")
    return (
        _with_order(found, counts).groupBy(*_MEMBERS)
        .agg(F.min(F.struct("order", "token")).alias("best"))
        .select("best.token", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    )


def whole_sets(docs: DataFrame, wanted: DataFrame, text: str, n: int, counts: np.ndarray) -> DataFrame:
    """(node, grams): the whole ordered sets of the wanted classes (node, _k1, _k2).

    A bitmap of fixed size, set from the wanted keys, spares most texts the work and the shuffle; the join
    then tells for sure. With very many wanted classes it lets more through and stays right.
    """
    bits = FILTER_BITS
    at = F.pmod("_k1", F.lit(bits))
    words = wanted.groupBy(F.shiftright(at, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(_k1, {bits}L) & 63 AS INT))")).alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)  # bits / 64 rows at most
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, counts = shared.value
        for batch in slices(batches, text):
            spot = batch.column("_k1").to_numpy().view(np.int64) % bits
            hit = np.flatnonzero(bitmap[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1))
            if len(hit):
                some = batch.take(pa.array(hit))
                sets = shingle_sets(words_of(some.column(text), lower=True), n)
                yield pa.RecordBatch.from_arrays(
                    [some.column("_k1"), some.column("_k2"),
                     pa.array([ordered(s, counts).tobytes() for s in sets], pa.binary())], names=["_k1", "_k2", "grams"])

    found = map_arrow(docs.select("_k1", "_k2", F.col(text).cast("string").alias(text)), run,
                      "_k1 long, _k2 long, grams binary")
    return found.join(wanted, ["_k1", "_k2"]).groupBy("node").agg(F.first("grams").alias("grams"))


def class_links(classes: DataFrame, docs: DataFrame, text: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(a, b): nodes of linked classes, enough links to join all that links join.

    ``classes``: node, n_shingles, grams (prefix), parity and _k1, _k2 of one document of the class in
    ``docs``, whose text gives the whole set where one is needed.
    """
    import pandas as pd

    places = listed(classes)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # the lists grow with the corpus: a shuffle at every size, rather than a broadcast while they are few
    dealt = (
        places.join(checkpointed(lists_to_compare(places, counts)).hint("merge"), "token").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
        .withColumn("side", F.when(F.col("low") == F.col("high"), 2).when(F.col("own") == F.col("low"), 0).otherwise(1))
        .drop("own"))
    shared = classes.sparkSession.sparkContext.broadcast(counts)
    key = ["token", "low", "high"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of_lists(batches):
            keys = [rows.column(k).to_numpy() for k in key]
            border = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *border.tolist(), rows.num_rows]
            sizes, sides = rows.column("n_shingles").to_numpy(), rows.column("side").to_numpy()
            bitmaps = rows.column("parity").to_pylist()
            useful = np.concatenate([alike(sizes[a:b], bitmaps[a:b], sides[a:b], percent)
                                     for a, b in zip(edges[:-1], edges[1:], strict=True)])
            yield from rows.select(["node", *key, "side"]).filter(pa.array(useful)).to_batches()

    def compare(group, frame):
        token = np.array([group[0]], np.int64).view(np.uint64)[0]
        pairs = spanning_links([np.frombuffer(g, np.uint64) for g in frame["grams"]], frame["side"].to_numpy(),
                               token, shared.value, percent)
        nodes = frame["node"].to_numpy()
        return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64")

    sifted = checkpointed(map_arrow(
        dealt.join(classes.select("node", "n_shingles", "parity"), "node").repartition(*key).sortWithinPartitions(*key),
        sift, "node long, token long, low int, high int, side int"))
    # sifted lists with the same members on the same sides: again the first in the order stands for all
    chosen = (
        _with_order(sifted.groupBy(*key).agg(*_membership("node", "side")), counts)
        .groupBy(*_MEMBERS).agg(F.min(F.struct("order", *key)).alias("best")).select("best.token", "best.low", "best.high"))
    useful = checkpointed(sifted.join(chosen, key, "left_semi"))
    wanted = checkpointed(
        useful.select("node").distinct().join(classes.select("node", "_k1", "_k2"), "node"))
    sets = whole_sets(docs, wanted, text, n, counts)
    return useful.join(sets, "node").groupBy(*key).applyInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """``docs`` without the text, with _k1, _k2 (digests of doc_id and text), n_shingles, class_id,
    component_id and _group (a number of the component; null without words)."""
    outputs = ("n_shingles", "class_id", "component_id")
    kept = [c for c in docs.columns if c not in outputs or c in (doc_id, text)]
    keyed = _keyed(docs.select(*[f"`{c}`" for c in kept]), doc_id, text)
    counts = bucket_counts(keyed, text, n)
    rows = checkpointed(shingled(keyed, text, n, percent, counts))
    classes = checkpointed(
        rows.where("n_shingles > 0").groupBy("sig").agg(
            F.min(doc_id).alias("class_id"), F.min(F.struct("_k1", "_k2")).alias("_k"),
            F.first("n_shingles").alias("n_shingles"), F.first("grams").alias("grams"), F.first("parity").alias("parity"))
        .select("sig", "class_id", "_k.*", "n_shingles", "grams", "parity")
        # numbered before they are written: how written rows are split into tasks may change from job to job
        .withColumn("node", F.monotonically_increasing_id()))
    found = components(class_links(classes, keyed, text, n, percent, counts))
    known = classes.select("sig", "class_id", "node").join(found, "node", "left")
    reached = known.where("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = known.join(reached, "component", "left").select(
        "sig", "class_id", F.coalesce("component_id", "class_id").alias("component_id"),
        F.coalesce("component", "node").alias("_group"))
    return (
        rows.join(named, "sig", "left")  # empty sets have a digest of their own, which no class has
        .select(*[f"`{c}`" for c in kept if c != text], "_k1", "_k2", "_group", "n_shingles",
                F.coalesce("class_id", F.col(doc_id)).alias("class_id"),
                F.coalesce("component_id", F.col(doc_id)).alias("component_id"))
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns({f"_k{i}": F.xxhash64(F.lit(i), F.col(doc_id), F.col(text)) for i in (1, 2)})


@shielded("doc_id", "text")
def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5,
                 percent: int = 80) -> DataFrame:
    """``docs`` without the text, with n_shingles, class_id and component_id.

    Words are runs of characters other than white space, A-Z in lower case. A document's set
    are its distinct ``n``-word shingles; with fewer words, the whole sequence as one; without
    a word, nothing. Documents link when 100 * |intersection| >= percent * |union|. class_id is
    the smallest doc_id of the documents with the same set, component_id the smallest that links
    reach, itself included; a document without words is in a component of its own. Null
    texts are empty; rows that repeat a doc_id take part each by its own text; a null doc_id
    is never the smallest if there is another. Every row gives one row; other columns pass
    through, whatever their names; columns named like an output are replaced; an empty table gives an empty
    table. A text above 1 MB is hashed alone, with some tens of bytes per byte of it; its set is 8 bytes a shingle.
    """
    return _grouped(docs, doc_id, text, n, percent).drop("_k1", "_k2", "_group")


@shielded("doc_id", "text")
def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5,
                      percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.

    Links are those of ``jaccard_join``. Documents without words all stay; rows equal in doc_id
    and text are one document, of which one row stays. Nulls and ties: as there, nulls first.
    """
    words = F.col("n_shingles") > 0
    first = (
        _grouped(docs.select(doc_id, text), doc_id, text, n, percent)
        .groupBy("_group", F.when(~words, F.col("_k1")).alias("_e1"), F.when(~words, F.col("_k2")).alias("_e2"))
        .agg(F.min(F.struct(doc_id, "_k1", "_k2")).alias("_first"))
        .select("_first._k1", "_first._k2")
    )
    kept = _keyed(docs, doc_id, text).join(first, ["_k1", "_k2"], "left_semi")
    return kept.dropDuplicates(["_k1", "_k2"]).select(*[f"`{c}`" for c in docs.columns])


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingles are alike by 0.9 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")
