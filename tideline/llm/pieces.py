"""SentencePiece encoding and decoding over a table of distinct marked words.

A marked word is a run of white-space markers and the characters after it. No piece
of a suitable vocabulary has a marker after another character, so no merge crosses
the border of two marked words: each distinct one is segmented and decoded once per
worker, and texts take their ids from the table by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.chunk_table import ChunkTable, once_per_worker, packed
from tideline.llm.common import map_arrow, query, slices, table, texts_of, with_columns

MARK = "▁"
_BORDER = re.compile("(?<=[^ ]) (?=.)", re.DOTALL)


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first marker.

    A marker character in the text is a space to the library. A last lone space
    stays with the word before it: an empty word would have no marker.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _BORDER.split(text)
    return text.split(" ")


class PieceTable(ChunkTable):
    """Ids by marked word, and what they decode to where that is not the word itself."""

    def __init__(self, model: bytes, bound: int):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        names = map(self.processor.id_to_piece, range(self.processor.get_piece_size()))
        if any(crossing.search(p) for p in names):
            raise ValueError("pieces of this model cross white-space markers; words can't be segmented alone")
        super().__init__(lambda words: [packed(ids) for ids in self.processor.encode(words, num_threads=1)], bound)
        self.other: dict[str, str] = {}

    def learn(self, chunked) -> list[str]:
        new = super().learn(chunked)
        if len(self.other) > 2 * self.bound:
            self.other = {w: d for w, d in self.other.items() if w in self.ids or w in self.aside}
        if new:
            decoded = self.processor.decode([np.frombuffer(self.ids[w], "<u4").tolist() for w in new])
            self.other.update((w, d) for w, d in zip(new, decoded, strict=True) if w != d)
        return new

    def decoded(self, words: list[str]) -> str:
        if not self.other or self.other.keys().isdisjoint(words):
            return " ".join(words)
        return " ".join([self.other.get(w, w) for w in words])


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids",
                  decoded: str = "decoded", end_id: bool = True, bound: int = 200_000) -> DataFrame:
    """``docs`` without the text, with its ids (array<int>) and what they decode to.

    Equal to the library's encode(text, add_eos=end_id) and decode(ids). A null or
    empty text has the end id alone and decodes to an empty text. Every row gives one
    row, repeated ones too; other columns pass through, and a column named like an
    output is replaced. An empty table gives an empty table. ``bound``: words that a
    worker's table holds before it starts anew.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: PieceTable = once_per_worker(("pieces", hash(model.value), bound), lambda: PieceTable(model.value, bound))
        end = np.asarray([known.processor.eos_id()] if end_id else [], "<u4").tobytes()
        for batch in slices(batches, text):
            chunked = [marked_words(t) for t in texts_of(batch, text)]
            known.learn(chunked)
            raw = [known.joined(words) + end for words in chunked]
            offsets = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(raw), "<i4"))
            yield with_columns(
                batch, (text,),
                **{ids: pa.ListArray.from_arrays(pa.array(offsets), values),
                   decoded: pa.array([known.decoded(words) for words in chunked], pa.string())},
            )

    kept = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded, T.StringType())])
    columns = [f"`{f.name}`" for f in kept]
    return map_arrow(docs.select(*columns, F.col(text).cast("string").alias(text)), run, schema)


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    """Ids of every text by the 32k model with an end id, and what they decode to, as digests."""
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
