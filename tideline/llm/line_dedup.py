"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is the sequence of its lines that hold a character other than white space.
Hashes of ``gram`` lines in a row are winnowed: of every ``window`` of them the smallest
(the last of equal ones) is selected. Two places that share ``gram + window - 1`` lines
share the selected one, so no such run is missed. Selected hashes that occur once in
the corpus are dropped; at the others, the match is extended to both sides: every run
of that length around the selected place is compared by digest with its first place.
Where ``alone`` is given, each line of that many words or more is selected as well, as a
run of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import checkpointed, query, shielded, table

#: White space as every operator here sees it: space and U+0009 to U+000D.
INK = r"[^\x20\x09-\x0D]"


def _digests(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: as good as one of 128 bits."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def _long_lines(words: int) -> Column:
    """Places in _lines of the lines of ``words`` words or more."""
    space, ink = r"[\x20\x09-\x0D]", INK
    pattern = rf"^{space}*+(?:{ink}++{space}++){{{words - 1}}}{ink}"
    return F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(pattern), i)), lambda i: i.isNotNull())


def line_windows(docs: DataFrame, doc_id: str, text: str, gram: int, window: int, alone: int | None = None) -> DataFrame:
    """One row per selected place: its hash, the document's order key and the runs around it."""
    run = gram + window - 1
    k1, k2 = _digests(F.col(doc_id), F.col(text))
    lined = docs.where(F.col(text).isNotNull()).select(
        F.struct(F.col(doc_id).alias("id"), k1.alias("k1"), k2.alias("k2")).alias("_doc"),
        F.filter(F.split(F.col(text), "\n", -1), lambda line: line.rlike(INK)).alias("_lines"),
    ).where(F.size("_lines") > 0)
    hashed = lined.select(
        "_doc",
        F.transform("_lines", lambda line: F.xxhash64(F.lit(1), line)).alias("_h1"),
        F.transform("_lines", lambda line: F.xxhash64(F.lit(2), line)).alias("_h2"),
        F.size("_lines").alias("_n"),
        *([] if alone is None else [_long_lines(alone).alias("_long")]),
    )
    last = F.greatest(F.col("_n") - run, F.lit(0))  # start of the last run; a short document is one run
    grams = hashed.withColumn("_grams", F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("_n") - gram, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.slice("_h1", i + 1, gram)).alias("hash"), (-i).alias("back")),
    ))
    runs = grams.withColumn("_runs", F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("start"),
        F.array_min(F.slice("_grams", i + 1, window)).alias("chosen"),
        F.xxhash64(F.slice("_h1", i + 1, run)).alias("w1"),
        F.xxhash64(F.slice("_h2", i + 1, run)).alias("w2"),
    )))
    chosen = F.array_distinct(F.transform("_runs", lambda r: r["chosen"]))
    if alone is not None:
        chosen = F.concat(
            F.transform(chosen, lambda c: F.struct(c["hash"].alias("hash"), c["back"].alias("back"), F.lit(False).alias("alone"))),
            F.transform("_long", lambda i: F.struct(
                F.get(F.col("_h1"), i).alias("hash"), (-i).alias("back"), F.lit(True).alias("alone"))))
    places = runs.select("_doc", "_n", "_runs", *([] if alone is None else ["_h1", "_h2"]), F.explode(chosen).alias("_chosen"))
    first = F.greatest(-F.col("_chosen.back") - (window - 1), F.lit(0))
    around = F.filter(F.slice("_runs", first + 1, window), lambda r: r["chosen"]["back"] == F.col("_chosen.back"))
    length = F.least(F.col("_n"), F.lit(run))
    if alone is not None:
        at = -F.col("_chosen.back")
        one = F.struct(at.alias("start"), F.get(F.col("_h1"), at).alias("w1"), F.get(F.col("_h2"), at).alias("w2"))
        around = F.when(F.col("_chosen.alone"), F.array(one)).otherwise(F.transform(around, lambda r: F.struct(
            r["start"].alias("start"), r["w1"].alias("w1"), r["w2"].alias("w2"))))
        length = F.when(F.col("_chosen.alone"), F.lit(1)).otherwise(length)
    return places.select(F.col("_chosen.hash").alias("_hash"), "_doc", around.alias("_around"), length.alias("_length"))


def later_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               gram: int = 2, window: int = 2, alone: int | None = None) -> DataFrame:
    """(_doc, start, _length): runs of lines that an earlier place of the corpus has already.

    Places are ordered by doc_id (nulls first), a digest of the text, and the line. ``start``
    counts the lines that aren't blank.
    """
    places = line_windows(docs, doc_id, text, gram, window, alone)
    # counts are written before they are joined: both sides then are plain shuffles, which Spark splits
    repeated = checkpointed(
        places.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    around = (
        places.join(repeated, "_hash", "left_semi")
        .select("_doc", "_length", F.explode("_around").alias("_run"))
        .select(F.struct("_doc", F.col("_run.start").alias("start")).alias("_place"),
                F.col("_run.w1").alias("_w1"), F.col("_run.w2").alias("_w2"), "_length")
    )
    same = ["_w1", "_w2", "_length"]
    around = checkpointed(around)
    firsts = checkpointed(
        around.groupBy(*same).agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"))
        .where(F.col("_first") != F.col("_last")).drop("_last")
    )
    return (
        around.join(firsts, same).where(F.col("_place") != F.col("_first"))
        .select("_place._doc", "_place.start", "_length")
    )


@shielded("doc_id", "text")
def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = 2, window: int = 2,
                counts: bool = False, alone: int | None = None) -> DataFrame:
    """``docs`` with the later repeats of runs of ``gram + window - 1`` lines cut out of the text.

    A line goes if it is in such a run that occurs at an earlier place of the corpus, in the
    same document or another; each line that goes has an equal line that stays. A document
    with fewer lines counts as one run and matches such documents only. With ``alone``, a
    line of so many words or more that occurs at an earlier place goes whatever stands around
    it; without it, repeats of fewer lines than a run stay, however long. Blank lines
    belong to no run and stay. A text of which nothing stays is empty; a null text stays
    null; rows equal in doc_id and text are one document and are cut alike. Null doc_ids
    come first. Other columns pass through, whatever their names; with ``counts``, n_lines and n_deleted (without
    blank lines) are added and replace columns of these names. A long text's lines are an array within its
    row, so a task holds a few times the bytes of its longest text. An empty table gives an empty table.
    """
    k1, k2 = _digests(F.col(doc_id), F.col(text))
    gone = (
        later_runs(docs, doc_id, text, gram, window, alone)
        .groupBy(F.col("_doc.k1").alias("_k1"), F.col("_doc.k2").alias("_k2"))
        .agg(F.array_distinct(F.flatten(F.collect_set(
            F.sequence("start", F.col("start") + F.col("_length") - 1)))).alias("_gone"))
    )
    joined = docs.withColumns({"_k1": k1, "_k2": k2}).join(gone, ["_k1", "_k2"], "left")
    lines = joined.withColumn("_lines", F.split(F.col(text), "\n", -1))
    inked = lines.withColumn("_inked", F.when(F.col("_gone").isNotNull() | F.lit(counts), F.filter(
        F.transform("_lines", lambda line, j: F.when(line.rlike(INK), j)), lambda j: j.isNotNull())))
    cut = inked.withColumn("_cut", F.transform(F.array_sort("_gone"), lambda o: F.get(F.col("_inked"), o)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut"))
    kept = F.array_join(F.transform(stay, lambda j: F.get(F.col("_lines"), j)), "\n")
    out = cut.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept))
    new = ["n_lines", "n_deleted"] if counts else []
    if counts:
        out = out.withColumns({
            "n_lines": F.coalesce(F.size("_inked"), F.lit(0)).cast("long"),
            "n_deleted": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        })
    return out.select(*[f"`{c}`" for c in docs.columns if c not in new], *new)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS j
  FROM documents WHERE text IS NOT NULL),
ink AS (
  SELECT doc_id, line, j, row_number() OVER d AS o, count(*) OVER (PARTITION BY doc_id) AS n,
         lead(line, 1) OVER d AS line2, lead(line, 2) OVER d AS line3
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
runs AS (
  SELECT doc_id, o, least(n, 3) AS len,
         row_number() OVER (PARTITION BY least(n, 3), line, coalesce(line2, ''), coalesce(line3, '')
                            ORDER BY doc_id, o) > 1 AS later
  FROM ink WHERE o <= greatest(n - 2, 1)),
gone AS (
  SELECT DISTINCT i.doc_id, i.j FROM ink i JOIN runs r
    ON r.doc_id = i.doc_id AND r.later AND i.o BETWEEN r.o AND r.o + r.len - 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.j) FILTER (WHERE g.j IS NULL) AS text,
         count(g.j) AS n_deleted
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.j = l.j GROUP BY l.doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM ink GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark, sf_dir):
    """Every document's text without later repeats of runs of three lines, and how many lines went."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
