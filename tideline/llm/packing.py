"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The packing is decided on the counts of piece lengths (one count for each length up to
the capacity, however large the corpus), and each piece then takes the place that its
rank among the pieces of its length has in that plan. Large items (over a third of
the capacity) come at most twice in a sequence: the largest is matched with the
largest that still fits, which gives the most pairs. Smaller items fill the
smallest gap that takes them, longest first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm.chunk_table import ChunkTable, once_per_worker, packed
from tideline.llm.common import checkpointed, map_arrow, map_pandas, query, shielded, slices, table, texts_of

#: White space other than a space or line feed, to either library.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B)))
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def spaced_words(text: str) -> list[str]:
    """The text cut before each single space between two other characters.

    Byte-level pre-tokenization starts a new word at such a space, whatever stands
    around it, so the parts can be tokenized alone. Every part but the first has
    lost its space.
    """
    if (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text
            or any(c in text for c in _OTHER_SPACE)):
        return _BORDER.split(text)
    return text.split(" ")


def word_tokenizer(spec: str, ranks: bytes | None):
    """Two functions: ids of many words, each tokenized alone, and ids of a text as a whole.

    With the same vocabulary as ``ranks``, words and texts without special tokens take the faster of
    two libraries that give the same ids; on a text it takes less time than a look-up of its words. Other texts have None.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    slow = lambda words: [packed(e.ids) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    if ranks is None:
        return slow, lambda text: None
    import base64

    import public_tokenizers
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
    return (lambda words: [packed(encode(w)) if not special.search(w) else slow([w])[0] for w in words],
            lambda text: None if special.search(text) else packed(encode(text)))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, ranks_path: str | None = None,
                 doc_id: str = "doc_id", text: str = "text", bound: int = 200_000) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32).

    A document is its tokens and the end id (null and empty texts: the end id alone).
    All pieces but the first have ``capacity`` tokens.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    ranks = None
    if ranks_path is not None:
        with open(ranks_path, "rb") as f:
            ranks = f.read()
    files = docs.sparkSession.sparkContext.broadcast((spec, ranks))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables():
            encode, whole = word_tokenizer(*files.value)
            return ChunkTable(encode, bound), ChunkTable(lambda parts: encode([" " + p for p in parts]), bound), whole

        first, later, whole = once_per_worker(("words", hash(files.value), bound), tables)
        for batch in slices(batches, text):
            texts = texts_of(batch, text)
            ids = [whole(t) for t in texts]
            parts = {row: spaced_words(t) for row, t in enumerate(texts) if ids[row] is None}
            first.learn([p[:1] for p in parts.values()])
            later.learn([p[1:] for p in parts.values()])
            rows = []
            for row, raw in enumerate(ids):
                if raw is None:
                    raw = first.joined(parts[row][:1]) + later.joined(parts[row][1:])
                raw += end
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    stop = at + ((n - at - 1) % capacity + 1 if at == 0 else capacity)
                    rows.append((row, piece, at, stop - at, crc32(raw[4 * at: 4 * stop])))
                    at, piece = stop, piece + 1
            row, piece, start, length, crc = (np.array(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id).take(pa.array(row)), pa.array(piece, pa.int32()),
                 *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(
        docs.select(doc_id, text), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, offset).

    Pieces ``first rank`` and up of a length go, so many a sequence, one after the other
    into the sequences from ``first sequence`` on, at ``offset``. Sequences of one gap
    are kept as ranges, so time and result are bounded by the lengths, not the counts.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges (first sequence, sequences)
    order: list[int] = []  # gaps that have ranges, ascending
    n_sequences = 0

    def place(length: int, pieces: int, each: int, sequence: int, gap: int) -> None:
        plan.append((length, used[length], pieces, each, sequence, capacity - gap))
        used[length] += pieces
        left[length] -= pieces
        if not left[length]:
            del left[length]
        full, rest = divmod(pieces, each)
        for first, count, inside in ((sequence, full, each), (sequence + full, 1 if rest else 0, rest)):
            remaining = gap - inside * length
            if count and remaining:
                if not gaps[remaining]:
                    insort(order, remaining)
                gaps[remaining].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        count = left[longest]
        fits = bisect_left(large, capacity - longest + 1)
        partner = large[fits - 1] if fits else None
        if partner == longest:  # a pair of equal lengths; an odd one stays for the next round
            count = count - count % 2 if count > 1 else count
            each = 2 if count > 1 else 1
            if each == 1 and fits > 1:
                partner = large[fits - 2]
            else:
                place(longest, count, each, n_sequences, capacity)
                n_sequences += count // each
                large = [n for n in large if n in left]
                continue
        if partner is not None:
            count = min(count, left[partner])
        start, gap = n_sequences, capacity
        n_sequences += count
        plan.append((longest, used[longest], count, 1, start, 0))
        used[longest] += count
        left[longest] -= count
        if not left[longest]:
            del left[longest]
        gap -= longest
        if partner is not None:
            place(partner, count, 1, start, gap)
        elif gap:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((start, count))
        large = [n for n in large if n in left]

    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect_left(order, length)
            gap = order[at] if at < len(order) else capacity
            each = gap // length
            if at < len(order):
                sequence, count = gaps[gap].pop()
                if not gaps[gap]:
                    del order[at]
            else:
                sequence, count = n_sequences, -(-left[length] // each)
                n_sequences += count
            pieces = min(left[length], count * each)
            touched = -(-pieces // each)
            if touched < count:
                if not gaps[gap]:
                    insort(order, gap)
                gaps[gap].append((sequence + touched, count - touched))
            place(length, pieces, each, sequence, gap)
    return plan


@shielded("length")
def best_fit(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Needs a column ``length`` (1 to ``capacity``); other columns pass through, whatever their names. Pieces of
    one length are told apart by their partition and place, written with the rows,
    so a length that a third of all pieces have is ranked by many tasks.
    """
    order = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    placed = checkpointed(pieces.withColumn("_at", order)).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # one row a length at most
    runs = np.array(sorted(packing_plan(totals, capacity)), np.int64).reshape(-1, 6)
    inside = Window.partitionBy("length", "_part").orderBy("_at")
    ranked = (
        placed.withColumn("_within", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_within"))
        .select(*[f"`{c}`" for c in pieces.columns], "_rank")
    )

    def assign(frames):
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["_rank"].to_numpy()
            # the last run that starts at or before (length, rank): runs are sorted by both
            low = np.searchsorted(runs[:, 0], length, "left")
            high = np.searchsorted(runs[:, 0], length, "right")
            while (open_ := high - low > 1).any():
                mid = (low + high) // 2
                up = open_ & (runs[np.minimum(mid, len(runs) - 1), 1] <= rank)
                low, high = np.where(up, mid, low), np.where(open_ & ~up, mid, high)
            run = runs[low]
            behind = rank - run[:, 1]
            frame["sequence_id"] = run[:, 4] + behind // run[:, 3]
            frame["offset"] = run[:, 5] + behind % run[:, 3] * length
            yield frame.drop(columns="_rank")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return map_pandas(ranked, assign, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         ranks_path: str | None = None) -> DataFrame:
    """Documents (doc_id, text) as pieces in sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null
    and empty texts are one piece of the end id. ``ranks_path`` may name the same vocabulary as
    ranks, which is faster. Repeated rows and null doc_ids are packed
    as any other row; further columns are ignored; an empty table gives an empty table. Pieces of one length tie: which
    takes which place hangs on the partitions. A long text's ids are held once, four bytes each, in its task.
    """
    return best_fit(token_pieces(docs, tokenizer_path, capacity, end_id, ranks_path), capacity)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    """All documents, tokenized by the 50k byte-level vocabulary, in sequences of 2048."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
