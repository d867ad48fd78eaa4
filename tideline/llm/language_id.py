"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For every place of the code a binary classifier over
hashed byte n-grams of the whole text predicts the bit; the language whose codeword costs least,
with places weighted by how well their classifier does on rows it hasn't seen, is chosen. A few
wrong bits don't change the nearest codeword; when two codewords are nearly as near, the row is
flagged as ambiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tideline.llm.common import map_arrow, query, slices, table
from tideline.llm.word_hashes import text_bytes

UNDETERMINED = "und"
LETTER = r"\p{L}"
SIZES = (1, 2, 3, 4)  # bytes of an n-gram
ROWS = 1 << 17  # of the weight table, for n-grams of all sizes
STEP = 1 << 18  # bytes whose n-grams are weighed at once, whatever the length of the texts
EXHAUSTIVE = 6  # up to so many languages every way to part them is a place of the code
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes as n-grams see them: ASCII letters in lower case, other ASCII as a space.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[:128] = 32
_SEEN[65:91] = _SEEN[97:123] = np.arange(97, 123)


def code_of(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of n languages, one per row: every parting of few, well separated random ones of many."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= EXHAUSTIVE:
        sides = np.arange(1, 2 ** (n - 1))[None, :] >> np.arange(n - 1)[:, None] & 1
        return np.vstack([sides, np.zeros((1, sides.shape[1]), np.int64)]).astype(np.float32) * 2 - 1
    random, best, apart = np.random.default_rng(seed), None, -1.0
    places = int(np.ceil(12 * np.log2(n)))
    for _ in range(40):
        half = np.repeat([1.0, -1.0], [n - n // 2, n // 2])
        code = np.stack([random.permutation(half) for _ in range(places)], axis=1).astype(np.float32)
        near = code @ code.T - 2 * places * np.eye(n)
        if (least := (places - near.max()) / 2) > apart:
            best, apart = code, least
    return best


def gram_rows(data: np.ndarray, text_end: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: rows of the n-grams that start in [start, stop), and which count.

    Those that leave their text or hold two spaces in a row don't.
    """
    wide = _SEEN[data[start: min(stop + SIZES[-1] - 1, len(data))]].astype(np.uint64)
    count = stop - start
    wide = np.concatenate([wide, np.zeros(count + SIZES[-1] - 1 - len(wide), np.uint64)])
    value, spaced = np.zeros(count, np.uint64), np.zeros(count, bool)
    space = wide == 32
    shift = np.uint64(64 - ROWS.bit_length() + 1)
    at = np.arange(start, stop)
    for n in SIZES:
        value = value * np.uint64(256) + wide[n - 1: n - 1 + count]
        if n > 1:
            spaced |= space[n - 2: n - 2 + count] & space[n - 1: n - 1 + count]
        yield ((value + np.uint64(n << 40)) * _FACTOR >> shift).astype(np.int32), (at + n <= text_end) & ~spaced


def text_rows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all n-grams of some texts, and where each text's begin (for training; the texts are few and bounded)."""
    parts = []
    for a, b in zip(ends[:-1], ends[1:]):
        found = [rows[inside] for rows, inside in gram_rows(data, np.full(b - a, b), a, b)] if b > a else []
        parts.append(np.concatenate(found) if found else np.zeros(0, np.int32))
    return np.concatenate([*parts, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, parts)])


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x places
    weights: np.ndarray  # ROWS + 1 x places; the last row, of n-grams that don't count, is zero
    slope: np.ndarray
    trust: np.ndarray  # of each place, adding up to 1
    unsure: float = 0.0  # margins up to this one are ambiguous

    def margins(self, column: pa.Array) -> np.ndarray:
        """The mean weight of each text's n-grams for each place, times the place's slope."""
        data, ends = text_bytes(pc.utf8_lower(column))
        n, places = len(ends) - 1, self.code.shape[1]
        sums, counts = np.zeros((n, places)), np.zeros(n)
        for start in range(0, len(data), STEP):
            stop = min(start + STEP, len(data))
            first = int(np.searchsorted(ends, start, "right")) - 1  # the text that start lies in
            last = int(np.searchsorted(ends, stop, "left"))
            cuts = np.clip(ends[first: last + 1], start, stop) - start
            full = np.flatnonzero(np.diff(cuts))
            text_end = np.repeat(ends[first + 1: last + 1], np.diff(cuts))
            total, inside_all = np.zeros((stop - start, places), np.float32), np.zeros(stop - start)
            for rows, inside in gram_rows(data, text_end, start, stop):
                total += self.weights[np.where(inside, rows, ROWS)]
                inside_all += inside
            sums[first + full] += np.add.reduceat(total, cuts[full], axis=0, dtype=np.float64)
            counts[first + full] += np.add.reduceat(inside_all, cuts[full])
        return sums / np.maximum(counts, 1)[:, None] * self.slope

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Each codeword's weighted logistic loss: texts x languages."""
        right = np.logaddexp(0, -margins) * self.trust
        wrong = np.logaddexp(0, margins) * self.trust
        return right @ (self.code.T > 0) + wrong @ (self.code.T < 0)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword (the first, if tied), its share of belief, and its lead over the next."""
        losses = self.losses(margins) * max(self.code.shape[1], 1)
        order = np.argsort(losses, axis=1, kind="stable")
        best = np.take_along_axis(losses, order[:, :1], 1)
        belief = 1 / np.exp(best - losses).sum(axis=1)
        lead = np.take_along_axis(losses, order[:, 1:2], 1)[:, 0] - best[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
        return order[:, 0], belief, lead


def _train(rows: np.ndarray, first: np.ndarray, language: np.ndarray, code: np.ndarray, used: np.ndarray,
           random: np.random.Generator, epochs: int = 3, batch: int = 32, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and slopes: smoothed log-odds of the two sides of each place, then adaptive gradient steps."""
    n, places = code.shape
    share = np.zeros((n, ROWS))
    for k in used:
        own = rows[first[k]: first[k + 1]]
        if len(own):
            np.add.at(share[language[k]], own, 1 / len(own))
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
    smooth = 1e-5
    weights = np.zeros((ROWS + 1, places), np.float32)
    for b in range(places):
        up, down = (share[code[:, b] == side].mean(axis=0) for side in (1, -1))
        weights[:ROWS, b] = np.log((up + smooth) / (down + smooth))
    del share
    slope = np.full(places, 8.0)
    state = np.full((ROWS + 1, places), 1e-2, np.float32)
    weight_of = 1 / np.maximum(np.bincount(language[used], minlength=n), 1)  # languages count alike
    weight_of *= len(used) / n
    for _ in range(epochs):
        mixed = random.permutation(used)
        for at in range(0, len(mixed), batch):
            picked = [k for k in mixed[at: at + batch] if first[k + 1] > first[k]]
            if not picked:
                continue
            own = [rows[first[k]: first[k + 1]] for k in picked]
            means = np.stack([weights[r].mean(axis=0) for r in own])
            side = code[language[picked]]
            error = -side / (1 + np.exp(np.clip(side * means * slope, -60, 60))) * weight_of[language[picked]][:, None] / len(picked)
            touched, inverse = np.unique(np.concatenate(own), return_inverse=True)
            sizes = np.array([len(r) for r in own])
            gradient = np.stack([np.bincount(inverse, np.repeat(error[:, b] * slope[b] / sizes, sizes), len(touched))
                                 for b in range(places)], axis=1)
            gradient *= ROWS ** 0.5  # shares of single n-grams are tiny
            state[touched] += gradient ** 2
            weights[touched] -= (rate * gradient / np.sqrt(state[touched])).astype(np.float32)
    return weights, slope


def fit(texts: list[str], labels: list[str], seed: int = 11) -> Model | None:
    """A model of the texts' languages; trust and the ambiguity bound come from a fifth held out from a first fit."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code, random = code_of(len(languages)), np.random.default_rng(seed)
    places = code.shape[1]
    if not places:
        return Model(languages, code, np.zeros((ROWS + 1, 0), np.float32), np.ones(0), np.ones(0))
    data, ends = text_bytes(pc.utf8_lower(pa.array(texts, pa.large_string())))
    rows, first = text_rows(data, ends)
    language = np.searchsorted(languages, labels)
    held = random.permutation(len(texts)) % 5 == 0
    model = Model(languages, code, *_train(rows, first, language, code, np.flatnonzero(~held), random), np.ones(places) / places)
    column = pa.array([t for t, h in zip(texts, held) if h], pa.large_string())
    if len(column):
        margins = model.margins(column)
        loss = np.logaddexp(0, -margins * code[language[held]]).mean(axis=0)
        model.trust = (t := 1 / (loss + 0.05)) / t.sum()
        picked, _, lead = model.decode(margins)
        wrong = lead[picked != language[held]]
        # up to the middle of the leads at which a held-out row was decoded wrongly
        model.unsure = float(np.median(wrong)) if len(wrong) else float(lead.min()) / 2
    model.weights, model.slope = _train(rows, first, language, code, np.arange(len(texts)), random)
    return model


def _fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def training_rows(docs: DataFrame, sample_rows: int, longest: int, most_languages: int) -> tuple[list[str], list[str]]:
    """At most ``sample_rows`` texts, none above ``longest`` characters, with about as many of each language.

    Rows whose fold is 2 and rows without doc_id, text or language are left out. Which rows of a language
    are taken is told by hashes of their ids; of rows with one id and language, one is.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(_fold(F.col("doc_id")) != 2)
    known = known.where(F.length("text") <= longest)
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = [(r["lang"], r["n_rows"]) for r in sizes.orderBy(F.desc("n_rows"), "lang").limit(most_languages).collect()]
    if not sizes:
        return [], []
    quota = max(sample_rows // len(sizes), 1)
    shares = docs.sparkSession.createDataFrame(
        [(name, min(1.0, (1.5 * quota + 30) / n)) for name, n in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = (
        known.join(F.broadcast(shares), "lang")  # at most most_languages rows
        .where(draw < F.col("share"))
        .groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # copies of a row are one, before any shuffle
    )
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # about 1.5 quotas of each language
    rows = drawn.withColumn("place", F.row_number().over(place)).where(F.col("place") <= quota).select("lang", "text").collect()
    rows = sorted((r["text"], r["lang"]) for r in rows)
    return [t for t, _ in rows], [name for _, name in rows]


def identify(docs: DataFrame, sample_rows: int = 1000, longest: int = 20_000, most_languages: int = 512) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, score and ambiguous.

    The model is fitted on the driver on at most ``sample_rows`` texts of at most ``longest`` characters of
    the ``most_languages`` most frequent languages (its size is fixed by the languages) and sent to the tasks.
    lang, source and doc_id are no inputs of a prediction: equal texts get equal ones. Whole texts are weighed,
    a bounded run of bytes at a time, so a text of any length takes the memory of its bytes and little more.
    A null text, an empty one and one without a letter get ``und`` and score 0; so does everything if no
    language is known. With one language all other texts get it, with score 1. Of tied codewords the first
    language in order wins. Every row gives one row, repeated ones too; other columns pass through, whatever
    their names; columns named like an output are replaced. An empty table gives an empty table.
    """
    outputs = ("held_out", "lang_pred", "score", "ambiguous")
    texts, labels = training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"),
                                              F.col("lang").cast("string").alias("lang")),
                                  sample_rows, longest, most_languages)
    model = fit(texts, labels)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in cache:
            cache["model"] = pickle.loads(shared.value)
        known: Model | None = cache["model"]
        for batch in slices(batches):
            text, letters = batch.column("text"), batch.column("letters").to_numpy(zero_copy_only=False)
            names = np.full(batch.num_rows, UNDETERMINED, object)
            score, unsure = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if known is not None and letters.any():
                picked, belief, lead = known.decode(known.margins(text))
                names[letters] = np.array(known.languages, object)[picked[letters]]
                score[letters], unsure[letters] = belief[letters], lead[letters] <= known.unsure
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(unsure)],
                names=["row", *outputs[1:]])

    kept = [c for c in docs.columns if c not in outputs]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(LETTER), F.lit(False)).alias("letters"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    scored = map_arrow(packed, run, schema)
    return scored.select(*[F.col("row")[c].alias(c) for c in kept],
                         (_fold(F.col("row")["doc_id"]) == 2).alias("held_out"), *outputs[1:])


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    """Every whole text's language, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
