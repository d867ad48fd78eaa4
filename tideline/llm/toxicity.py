"""Toxicity by a convolutional text classifier, trained in numpy.

Words are embedded as sums of hashed rows (the word and its first five and four bytes, so
inflected forms share rows), filters of several widths run over them, the maximum of each
over the whole text is kept, and a logistic layer weighs these. Embeddings start
from smoothed log-odds, training moves all parameters. Each language, told by its
function words in the text, gets the threshold that is best on rows that weren't trained on;
scores are shifted so that the threshold lies at one half.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tideline.llm.common import map_arrow, query, slices, table
from tideline.llm.word_hashes import mix, words_of

#: Frequent function words of the languages that thresholds are set for.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for was on are with they be at this from or had by but what were we when",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur ne se ce il sont avec plus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus",
}
LANGUAGES = tuple(FUNCTION_WORDS)
ROWS, WIDTH = 1 << 18, 8  # of the embedding table: 8 MB, whatever the corpus
WIDTHS, FILTERS = (1, 2, 3), 8
LEAST_OF_A_LABEL = 8  # rows of each label that a language needs for a threshold of its own
_SIGNS = np.zeros(256, bool)
_SIGNS[np.frombuffer(b".,;:!?\"'()[]*$%&#|<>", np.uint8)] = True


def _language_table() -> np.ndarray:
    """Language bits of a word by the low 16 bits of its hash."""
    out = np.zeros(1 << 16, np.uint8)
    for bit, words in enumerate(FUNCTION_WORDS.values()):
        known = words_of(pa.array([words]), lower=True).hashes()
        out[(known & np.uint64(0xFFFF)).astype(np.int64)] |= 1 << bit
    return out


_LANGUAGE_TABLE = _language_table()


@dataclass
class Features:
    rows: np.ndarray  # words x 3, rows of the embedding table
    first: np.ndarray  # index of each text's first word, one more than texts
    language: np.ndarray  # index of each text's language


def features(column: pa.Array) -> Features:
    """Embedding rows of the words of each text, without signs at their ends, and its language."""
    words = words_of(pc.utf8_lower(column), lower=True)
    end = words.end.copy()
    for _ in range(3):
        signed = (end - words.start > 1) & _SIGNS[words.data[end - 1]] if len(end) else np.zeros(0, bool)
        end = end - signed
    words.end = end
    h = words.hashes()
    rows = np.stack([(x + np.uint64(k) if k else x) >> np.uint64(64 - ROWS.bit_length() + 1)
                     for k, x in enumerate((h, mix(words.hashes(5) + np.uint64(5)), mix(words.hashes(4) + np.uint64(4))))],
                    axis=1).astype(np.int32)
    bits = _LANGUAGE_TABLE[(h & np.uint64(0xFFFF)).astype(np.int64)]
    ends = [np.concatenate([[0], np.cumsum(bits >> k & 1)])[words.first] for k in range(len(LANGUAGES))]
    language = np.stack([np.diff(e) for e in ends]).argmax(axis=0)
    return Features(rows, words.first, language)


def features_of(texts: list[str], step: int = 200) -> Features:
    """The features of many texts, a few at a time: their bytes need many times their memory."""
    parts = [features(pa.array(texts[k: k + step], pa.string())) for k in range(0, len(texts), step)]
    sizes = np.concatenate([np.diff(p.first) for p in parts])
    return Features(np.concatenate([p.rows for p in parts]), np.concatenate([[0], np.cumsum(sizes)]),
                    np.concatenate([p.language for p in parts]))


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, WIDTH, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = self.embedding[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            out += self.embedding[rows[:, k]]
        return out

    def convolved(self, embedded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter (rows) at each word, and where each text starts and ends among the columns.

        Texts are set apart by empty words, so no window sees the next text.
        """
        texts = len(first) - 1
        gap = max(WIDTHS) - 1
        apart = np.zeros((len(embedded) + gap * texts, WIDTH), np.float32)
        apart[np.arange(len(embedded)) + gap * np.repeat(np.arange(texts), np.diff(first))] = embedded
        out = np.empty((len(self.bias), len(apart)), np.float32)
        for k, width in enumerate(WIDTHS):
            part = self.filters[width][0].T @ apart.T
            for j in range(1, width):
                part[:, :-j] += self.filters[width][j].T @ apart[j:].T
            out[k * FILTERS: (k + 1) * FILTERS] = part
        out += self.bias[:, None]
        starts = first[:-1] + gap * np.arange(texts)
        return out, np.stack([starts, starts + np.diff(first)], axis=1)

    def logits(self, found: Features) -> np.ndarray:
        """One per text; a text without words has the offset alone."""
        pooled = np.zeros((len(found.first) - 1, len(self.bias)), np.float32)
        if len(found.rows):
            values, places = self.convolved(self.embed(found.rows), found.first)
            full = places[:, 1] > places[:, 0]
            pooled[full] = np.maximum(np.maximum.reduceat(values, places[full].ravel(), axis=1)[:, ::2].T, 0)
        return pooled @ self.weight + self.offset

    def scores(self, found: Features) -> np.ndarray:
        z = self.logits(found).astype(np.float64) - self.thresholds[found.language]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _log_odds(found: Features, toxic: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of a text being toxic for each embedding row, by texts that have it."""
    owner = np.repeat(np.arange(len(toxic)), np.diff(found.first))
    counts = np.zeros((2, ROWS))
    for k in range(found.rows.shape[1]):
        pairs = np.unique(owner * np.int64(ROWS) + found.rows[:, k])
        counts += np.bincount(toxic[pairs // ROWS] * ROWS + pairs % ROWS, minlength=2 * ROWS).reshape(2, ROWS)
    rate = np.clip(toxic.mean(), 0.01, 0.99)
    strength = 4.0
    return np.log((counts[1] + strength * rate) / (counts[0] + strength * (1 - rate))) - np.log(rate / (1 - rate))


def _batch(found: Features, picked: np.ndarray) -> Features:
    sizes = np.diff(found.first)[picked]
    first = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(found.first[:-1][picked] - first[:-1], sizes) + np.arange(first[-1])
    return Features(found.rows[take], first, found.language[picked])


def fit(texts: list[str], toxic: np.ndarray, folds: int = 3, seed: int = 7) -> Model:
    """A classifier of the texts, with thresholds from classifiers that haven't seen the row."""
    random = np.random.default_rng(seed)
    found = features_of(texts)
    fold = random.permutation(len(toxic)) % folds
    unseen = np.zeros(len(toxic))
    for k in range(folds):
        held = np.flatnonzero(fold == k)
        unseen[held] = train(found, toxic, np.flatnonzero(fold != k), random).logits(_batch(found, held))
    model = train(found, toxic, np.arange(len(toxic)), random)
    shared = best_threshold(unseen, toxic)
    for k in range(len(LANGUAGES)):
        own = found.language == k
        enough = min((toxic[own] == 1).sum(), (toxic[own] == 0).sum()) >= LEAST_OF_A_LABEL
        model.thresholds[k] = best_threshold(unseen[own], toxic[own]) if enough else shared
    return model


def train(found: Features, toxic: np.ndarray, used: np.ndarray, random: np.random.Generator, epochs: int = 4,
          batch: int = 64, rate: float = 0.05) -> Model:
    """Filters, embeddings and weights from the rows in ``used``, by adaptive gradient steps."""
    odds = _log_odds(_batch(found, used), toxic[used])
    n_filters = FILTERS * len(WIDTHS)
    embedding = random.normal(0, 0.05, (ROWS, WIDTH)).astype(np.float32)
    embedding[:, 0] = odds
    filters = {w: random.normal(0, 0.1, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][0, 0, 0] = 1.0  # one filter of each width starts from the log-odds
    model = Model(embedding, filters, np.zeros(n_filters, np.float32), random.normal(0, 0.05, n_filters).astype(np.float32))
    model.weight[::FILTERS] = 0.5
    model.offset = -3.0
    state = {"embedding": np.full(ROWS, 1e-3), "weight": np.full(n_filters, 1e-3), "bias": np.full(n_filters, 1e-3),
             "offset": 1e-3} | {w: np.full(filters[w].shape, 1e-3) for w in WIDTHS}
    balance = np.where(toxic == 1, 0.5 / max(toxic[used].mean(), 1e-3), 0.5 / max(1 - toxic[used].mean(), 1e-3))

    def step(name, value, gradient):
        state[name] = state[name] + gradient ** 2
        return value - rate * gradient / np.sqrt(state[name])

    for _ in range(epochs):
        mixed = random.permutation(used)
        for at in range(0, len(mixed), batch):
            picked = mixed[at: at + batch]
            picked = picked[np.diff(found.first)[picked] > 0]
            if not len(picked):
                continue
            part = _batch(found, picked)
            embedded = model.embed(part.rows)
            values, places = model.convolved(embedded, part.first)
            # the word at which each filter has its maximum in each text
            place = np.stack([start + values[:, low:high].argmax(axis=1)
                              for start, (low, high) in zip(part.first, places.tolist())])
            best = np.stack([values[:, low:high].max(axis=1) for low, high in places.tolist()])
            pooled = np.maximum(best, 0)
            z = pooled @ model.weight + model.offset
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic[picked]) * balance[picked] / len(picked)
            back = error[:, None] * model.weight * (best > 0)
            moved = np.zeros_like(embedded)
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                gradient = np.zeros_like(model.filters[width])
                for j in range(width):
                    spot = place[:, cols] + j
                    valid = (spot < part.first[1:, None]) * back[:, cols]
                    spot = np.minimum(spot, len(embedded) - 1)
                    gradient[j] = np.einsum("bf,bfd->df", valid, embedded[spot])
                    np.add.at(moved, spot.ravel(), np.einsum(
                        "bf,df->bfd", valid, model.filters[width][j]).reshape(-1, WIDTH).astype(np.float32))
                model.filters[width] = step(width, model.filters[width], gradient).astype(np.float32)
            model.weight = step("weight", model.weight, pooled.T @ error).astype(np.float32)
            model.bias = step("bias", model.bias, back.sum(axis=0)).astype(np.float32)
            model.offset = float(step("offset", model.offset, error.sum()))
            touched = np.flatnonzero(np.abs(moved).sum(axis=1))
            rows = part.rows[touched].ravel()
            unique, inverse = np.unique(rows, return_inverse=True)
            gradient = np.zeros((len(unique), WIDTH))
            np.add.at(gradient, inverse, np.repeat(moved[touched], part.rows.shape[1], axis=0))
            state["embedding"][unique] += (gradient ** 2).sum(axis=1)
            model.embedding[unique] -= (rate * gradient / np.sqrt(state["embedding"][unique])[:, None]).astype(np.float32)

    return model


def best_threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the fewest errors; the middle of the widest gap among the best."""
    if len(z) == 0 or toxic.min() == toxic.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, toxic = z[order].astype(np.float64), toxic[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gaps = np.where(errors == errors.min(), np.diff(edges), -1)
    k = int(gaps.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, longest: int) -> tuple[list[str], np.ndarray]:
    """At most ``sample_rows`` labelled texts, none longer than ``longest`` characters.

    Of each label at most half are taken, by the hash of the doc_id. Rows for tests
    (crc32 of the doc_id as text, modulo 5, is 0) are left out before anything is learned.
    """
    open_rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    half = sample_rows // 2
    picked = None
    for value in (0, 1):
        part = open_rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rows = (
        docs.select("doc_id", "text").where(F.length("text") <= longest)
        .join(F.broadcast(picked), "doc_id")  # at most sample_rows rows
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))  # repeated ids are one row
        .select("text", "toxic").collect()
    )
    # the order in which tasks answer must not decide the fit
    rows = sorted((r["text"], r["toxic"]) for r in rows)
    return [t for t, _ in rows], np.array([y for _, y in rows], np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, longest: int = 50_000,
                   text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score and predicted.

    The classifier is fitted on the driver on a bounded sample of labelled rows and sent to
    the tasks (fixed size); each whole text is scored. The score sees the text alone. Null
    and empty texts get the score of no evidence. held_out tells rows that are never learned
    from. Without labels of both kinds nothing counts as toxic (score 0). Every row gives one
    row, repeated ones too; columns named like an output are replaced; an empty table
    gives an empty table. The fit takes at most ``sample_rows`` labelled texts of at most ``longest`` characters; longer
    texts are scored whole like all others, alone if above 1 MB, with some tens of bytes per byte. Equal texts have equal scores;
    of rows that repeat a doc_id one is learned from.
    """
    texts, toxic = training_rows(docs.select("doc_id", F.col(text).alias("text")), labels, sample_rows, longest)
    model = fit(texts, toxic) if len(texts) > 1 and toxic.min() != toxic.max() else None
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in cache:
            cache["model"] = pickle.loads(shared.value)
        known = cache["model"]
        for batch in slices(batches, text):
            scores = np.zeros(batch.num_rows) if known is None else known.scores(features(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    schema = T.StructType([docs.schema[c] if c != text else T.StructField(text, T.StringType()) for c in kept]
                          + [T.StructField("score", T.DoubleType())])
    plain = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in kept])
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return map_arrow(plain, run, schema).withColumns({
        "held_out": held, "predicted": (F.col("score") >= 0.5).cast("int")})


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    """Every whole text's toxicity, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
