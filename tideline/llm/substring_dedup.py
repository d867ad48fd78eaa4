"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes decides after which words a text is cut, so cuts
depend on what stands before them and not on their distance from the text's start:
an insertion shifts no cut but those beside it. From every cut a chunk runs to the first
cut that is at least ``min_words`` words on. Chunks are told apart by a digest of their words. What a chunk
repeats from an earlier place goes, where such chunks cover a run of ``min_run`` words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.common import checkpointed, map_arrow, query, shielded, slices, table
from tideline.llm.word_hashes import BYTE_VALUES, Words, mix, words_of

_GEAR = (BYTE_VALUES >> np.uint64(16)).astype(np.uint32)
_WINDOW = 16
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the last 16 bytes (32 bits; the upper half sees all of them)."""
    h = _GEAR[data]
    step = 1
    while step < _WINDOW:
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
        step *= 2
    return h


class Chunks:
    """The chunks of the texts of a slice: text, first and last word, digest."""

    def __init__(self, words: Words, mean_words: int, min_words: int):
        n = len(words.start)
        texts = len(words.first) - 1
        owner = np.repeat(np.arange(texts), np.diff(words.first))
        last = words.first[1:][owner] - 1 if n else np.zeros(0, np.int64)
        ends = words.end - 1
        value = gear(words.data)[ends] >> np.uint32(16) if n else np.zeros(0, np.uint32)
        # within the first bytes of a text the window would see the text before
        cut = (value < 65536 // mean_words) & (ends - words.text_ends[owner] >= _WINDOW)
        cut |= np.arange(n) == last
        starts = np.ones(n, bool)
        starts[1:] = cut[:-1]
        start = np.flatnonzero(starts)
        cuts = np.flatnonzero(cut)
        reach = start + min_words - 1
        full = reach <= last[start]
        start, reach = start[full], reach[full]
        end = cuts[np.searchsorted(cuts, reach)] if len(start) else start
        hashes = words.hashes()
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        inverse[:1] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)])
        length = (end - start + 1).astype(np.uint64)
        self.text = owner[start]
        self.start, self.end = start, end
        self.digest = mix((sums[end + 1] - sums[start]) * inverse[start] + length)
        first = np.searchsorted(self.text, np.arange(texts))
        self.ordinal = np.arange(len(start)) - first[self.text]
        self.first = np.append(first, len(start))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)))


def chunk_table(keyed: DataFrame, doc_id: str, text: str, mean_words: int, min_words: int) -> DataFrame:
    """(_digest, _id, _key, _ordinal): every chunk of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = Chunks(words_of(batch.column(text)), mean_words, min_words)
            rows = pa.array(found.text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.digest.view(np.int64)), batch.column("_id").take(rows),
                 batch.column("_key").take(rows), pa.array(found.ordinal, pa.int32())],
                names=["_digest", "_id", "_key", "_ordinal"])

    kind = keyed.schema[doc_id].dataType.simpleString()
    return map_arrow(keyed.select(F.col(doc_id).alias("_id"), "_key", F.col(text).cast("string").alias(text)), run,
                     f"_digest long, _id {kind}, _key long, _ordinal int")


def later_chunks(chunks: DataFrame) -> DataFrame:
    """(_id, _key, _later): per document the ordinals of chunks that occur at an earlier place.

    Places are ordered by doc_id (nulls first), key and ordinal. A digest that very many
    places share is counted before the shuffle. What is counted is written before it is joined:
    both sides of the joins then are plain shuffles, whose large partitions Spark splits.
    """
    repeated = checkpointed(
        chunks.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"))
    shared = checkpointed(chunks.join(repeated, "_digest", "left_semi").select(
        "_digest", F.struct("_id", "_key", "_ordinal").alias("_place")))
    firsts = checkpointed(shared.groupBy("_digest").agg(F.min("_place").alias("_first")))
    return (
        shared.join(firsts, "_digest").where(F.col("_place") != F.col("_first"))
        .groupBy("_place._id", "_place._key").agg(F.collect_set("_place._ordinal").alias("_later"))
    )


def covered_words(found: Chunks, row: int, ordinals: list[int], min_run: int) -> list[tuple[int, int]]:
    """Runs of words (first, last) that the chunks cover, of ``min_run`` words at least."""
    picked = np.sort(np.asarray(ordinals, np.int64)) + found.first[row]
    runs: list[tuple[int, int]] = []
    for start, end in zip(found.start[picked].tolist(), found.end[picked].tolist(), strict=True):
        if runs and start <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], end))
        else:
            runs.append((start, end))
    return [(a, b) for a, b in runs if b - a + 1 >= min_run]


@shielded("doc_id", "text")
def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mean_words: int = 4,
                     min_words: int = 8, min_run: int = 20, counts: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, all but their first place.

    A chunk (about ``mean_words`` between cuts, ``min_words`` or more) is repeated if its
    words occur as a chunk at an earlier place, in this document or another. Runs of words
    that repeated chunks cover go if they have ``min_run`` words or more, with the white
    space after them; nothing else changes. A repeated passage loses all but its words
    before its first cut and after its last, a few on average. Shorter texts and null texts
    stay as they are; a text of which nothing stays is empty. Rows equal in doc_id and
    text are one document and cut alike; null doc_ids come first. A text above 1 MB is chunked alone, with some
    tens of bytes per byte of it. An empty table gives an empty table. Other columns pass through, whatever their names;
    with ``counts``, n_cut_words is added and replaces a column of that name.
    """
    keyed = _keyed(docs, doc_id, text)
    later = later_chunks(chunk_table(keyed, doc_id, text, mean_words, min_words))
    joined = keyed.join(
        later.withColumnRenamed("_key", "_later_key"),
        (F.col("_key") == F.col("_later_key")) & F.col(doc_id).eqNullSafe(F.col("_id")), "left")
    names = [c for c in docs.columns if not (counts and c == "n_cut_words")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            later = batch.column("_later").to_pylist()
            hit = [i for i, x in enumerate(later) if x]
            new, gone = batch.column(text).to_pylist(), [0] * batch.num_rows
            if hit:
                column = batch.column(text).take(pa.array(hit))
                words = words_of(column)
                found = Chunks(words, mean_words, min_words)
                for row, i in enumerate(hit):
                    low, high = words.text_ends[row], words.text_ends[row + 1]
                    stop = words.first[row + 1]
                    kept, at = [], low
                    for a, b in covered_words(found, row, later[i], min_run):
                        kept.append(words.data[at: words.start[a]].tobytes())
                        at = words.start[b + 1] if b + 1 < stop else high
                        gone[i] += b - a + 1
                    new[i] = b"".join([*kept, words.data[at:high].tobytes()]).decode()
            columns = {n: batch.column(n) for n in names} | {text: pa.array(new, pa.string())}
            if counts:
                columns["n_cut_words"] = pa.array(gone, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = [docs.schema[c] if c != text else T.StructField(text, T.StringType()) for c in names]
    if counts:
        fields.append(T.StructField("n_cut_words", T.LongType()))
    return map_arrow(joined.select(*[f"`{c}`" for c in names], "_later"), cut, T.StructType(fields))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    """Every document's text without passages that an earlier place has, and how many words went."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
