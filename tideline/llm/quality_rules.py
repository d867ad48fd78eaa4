"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A sample gives each rule's rejection rate and its cost (seconds to compute it); rules are
then tried in descending order of rejection per cost, and a document that one rule
rejects isn't looked at by the next. The order changes the work, never the verdict.
"""

from __future__ import annotations

import math
import statistics
import time

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import checkpointed, free_prefix, query, table

SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def removed(text: Column, characters: str) -> Column:
    """How many of the characters the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of characters other than white space (U+0020, U+0009 to U+000D). All are
    of the whole text; null and empty texts have no words. The words in repeated 3-word
    windows are counted by position, by sorting the windows' hashes within the row.
    """
    text_, words_, inked_, windows_, sorted_, twice_ = (free_prefix(docs.columns) + n for n in "text words inked windows sorted twice".split())
    whole = docs.withColumn(text_, F.coalesce(F.col(text).cast("string"), F.lit("")))
    split = whole.withColumns({
        words_: F.filter(F.split(text_, SPACE), lambda w: w != ""),
        inked_: F.filter(F.split(text_, "\n", -1), lambda line: line.rlike(INK)),
    })
    words = F.col(words_)
    windows = split.withColumns({
        "n_words": F.size(words_).cast("long"),
        windows_: F.when(F.size(words_) >= 3, F.transform(
            F.slice(words_, 1, F.greatest(F.size(words_) - 2, F.lit(1))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))),
    })
    # most texts repeat no window; only the others are sorted
    repeats = F.size(F.array_distinct(windows_)) < F.size(windows_)
    ordered = windows.withColumn(sorted_, F.when(repeats, F.sort_array(
        F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = F.col(sorted_)
    twice = ordered.withColumn(twice_, F.transform(
        F.filter(sorted_, lambda s, i: (s["h"] == F.get(beside, i - 1)["h"]) | (s["h"] == F.get(beside, i + 1)["h"])),
        lambda s: s["i"]))
    covered = F.size(F.array_distinct(F.concat(
        F.col(twice_), F.transform(twice_, lambda i: i + 1), F.transform(twice_, lambda i: i + 2))))
    counted = twice.withColumns({
        "word_chars": (F.length(text_) - removed(F.col(text_), SPACE_CHARS)).cast("long"),
        "n_symbols": removed(F.col(text_), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(inked_) - F.size(F.array_distinct(inked_))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    return counted.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ).drop(text_, words_, inked_, windows_, sorted_, twice_)


def default_rules(text: str = "text") -> dict[str, Column]:
    """Rejecting conditions by name, over the base columns and the text.

    Each compares whole numbers, so SQL and Spark agree to the last row.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "shouting": 10 * removed(body, "!") > F.col("n_words"),
        "capitals": 2 * removed(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") > F.col("word_chars"),
        "repeated_lines": (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * (removed(body, "\n") + 1)),
        "unfinished_lines": 10 * (F.size(F.split(body, "\\.\\.\\.(?:\n|\\z)|…(?:\n|\\z)", -1)) - 1)
        > 3 * (removed(body, "\n") + 1),
    }


def order_rules(sample: DataFrame, rules: dict[str, Column], repeat: int = 20, rounds: int = 3) -> list[str]:
    """Rule names by rejections per second on the sample, most first.

    The sample, with all that the rules read, is bounded by the caller. Each rule is timed alone over the
    sample ``repeat`` times over, turn and turn about with the others, less the time without a rule;
    of ``rounds`` times the median counts, and costs within a factor of about two count alike.
    """
    many = sample.withColumn(free_prefix(sample.columns) + "again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

    def seconds(column: Column) -> float:
        start = time.perf_counter()
        many.select(column.alias("r")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    rates = sample.agg(F.count(F.lit(1)), *[F.count_if(c) for c in rules.values()]).first()
    times: dict[str, list[float]] = {name: [] for name in ["", *rules]}
    for _ in range(rounds + 1):
        for name in times:
            times[name].append(seconds(rules[name] if name else F.lit(1)))
    cost = {name: statistics.median(t[1:]) for name, t in times.items()}  # the first round compiles code
    least = 0.25 * cost[""]  # what can't be told from the time without a rule
    score = {
        name: math.log2((rate + 0.5) / (rates[0] + 1)) - round(math.log2(max(cost[name] - cost[""], least)))
        for name, rate in zip(rules, rates[1:])
    }
    return sorted(rules, key=lambda name: (-score[name], name))


def cascade(docs: DataFrame, text: str = "text", rules: dict[str, Column] | None = None,
            sample_rows: int = 1000) -> DataFrame:
    """``docs`` with the base columns and ``kept``.

    ``kept`` is false if base_failed or any rule rejects; rules run in the order that
    ``order_rules`` finds on about ``sample_rows`` rows drawn from all, within one CASE that stops at the
    first rejection. Null and empty texts fail the base; a text of any length is judged whole, within its row.
    Every row gives one row, repeated ones too; other columns pass through, whatever their names, and may be read by
    rules; columns named like an output are replaced; an empty table gives an empty table.
    """
    rules = default_rules(text) if rules is None else rules
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    plain = docs.drop(*[F.col(f"`{c}`") for c in docs.columns if c.lower() in outputs and c != text])
    share = sample_rows / max(plain.count(), 1)
    sample = checkpointed(base_columns(plain.where(F.rand(11) < 1.2 * share).limit(sample_rows), text))
    based = base_columns(plain, text)
    verdict = F.when(F.col("base_failed"), False)
    for name in order_rules(sample, rules):
        verdict = verdict.when(rules[name], False)
    return based.withColumn("kept", verdict.otherwise(True))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ink
  FROM t),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, text, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ink) - len(list_distinct(ink)))::BIGINT AS n_dup_lines,
         coalesce(c, 0)::BIGINT AS n_repeat_words,
         length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 100 * n_repeat_words > 30 * n_words
         OR 10 * (length(text) - length(replace(text, '!', ''))) > n_words
         OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > word_chars
         OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
         OR 10 * len(regexp_extract_all(text, '(?:\.\.\.|…)(?:\n|\z)')) > 3 * n_lines) AS kept
FROM f
"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark, sf_dir):
    """Base counts of every whole text and the cascade's verdict."""
    return cascade(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
