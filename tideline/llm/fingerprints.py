"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame operations only.

Sections are parted by blank lines, paragraphs are lines, and a paragraph's blocks are runs of up to
eight words that end where the content says so: after a word with one of some last characters (in short
paragraphs single words are blocks, too). A paragraph's digest is of its text, a
section's of its paragraphs' digests, the root of the sections' digests, so equal roots
mean equal texts, and walking down the branches that differ tells where two texts differ. Blocks make an edit
within a paragraph a matter of degree: those beyond the next cut stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import query, table
from tideline.operators.materialize import number_rows

#: Hex digits of the digests that a fingerprint holds for a section or paragraph, and for a block.
NODE_HEX, BLOCK_HEX = 16, 6


#: A block: up to seven words that don't end in one of the characters, and the word after them.
BLOCK = r"(?:\S*[^entr.,!?\s]\s+){0,7}\S+\s*"


def _blocks(paragraph: Column) -> Column:
    """The paragraph's runs of words up to the next cut and, if it is short, its single words."""
    found = lambda pattern: F.regexp_extract_all(paragraph, F.lit(pattern), F.lit(0))
    short = F.when(F.length(paragraph) < 240, found(r"\S+\s*")).otherwise(F.array().cast("array<string>"))
    return F.concat(found(BLOCK), short)


def with_tree(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``docs`` with {prefix}fingerprint and {prefix}blocks (the distinct block digests).

    A fingerprint reads root:section(paragraph=blocks,...)|section(...), all in hex.
    """
    tree = f"_{prefix}tree"
    block = lambda b: F.substring(F.hex(F.xxhash64(b)), -BLOCK_HEX, BLOCK_HEX)
    paragraph = lambda p: F.struct(
        F.substring(F.sha2(p, 256), 1, NODE_HEX).alias("digest"), F.transform(_blocks(p), block).alias("blocks"))
    section = lambda s: F.transform(F.split(s, "\n", -1), paragraph)
    branches = docs.withColumn(tree, F.transform(
        F.split(F.col(text), r"\n[\x20\x09-\x0D]*\n", -1), section))
    digest = lambda s: F.sha2(F.array_join(F.transform(s, lambda p: p["digest"]), ""), 256)
    sections = branches.withColumn(f"{tree}_digests", F.transform(tree, digest))
    written = F.zip_with(tree, f"{tree}_digests", lambda s, d: F.concat(
        F.substring(d, 1, NODE_HEX), F.lit("("), F.array_join(F.transform(s, lambda p: F.concat(
            p["digest"], F.lit("="), F.array_join(p["blocks"], ""))), ","), F.lit(")")))
    return (
        sections
        .withColumn(f"{prefix}fingerprint", F.concat(
            # the text's length keeps the roots of differently parted texts apart
            F.sha2(F.concat(F.array_join(f"{tree}_digests", ""), F.length(text).cast("string")), 256),
            F.lit(":"), F.array_join(written, "|")))
        .withColumn(f"{prefix}blocks", F.array_distinct(F.flatten(F.transform(
            F.flatten(tree), lambda p: F.transform(p["blocks"], lambda b: F.conv(b, 16, 10).cast("int"))))))
        .drop(tree, f"{tree}_digests")
    )


def likeness(fingerprint: Column, blocks: Column, other_fingerprint: Column, other_blocks: Column) -> Column:
    """1 for equal fingerprints alone, else the Dice coefficient of their distinct blocks (0 without any), a little less than 1."""
    shared = F.size(F.array_intersect(blocks, other_blocks))
    total = F.size(blocks) + F.size(other_blocks)
    dice = F.least(F.coalesce(F.try_divide(2.0 * shared, total), F.lit(0.0)), F.lit(1.0) - F.lit(1.0) / (total + 2))
    return F.when(fingerprint == other_fingerprint, 1.0).otherwise(dice)


def differing_paragraphs(fingerprint: Column, other: Column) -> Column:
    """(section, paragraph) of each place, from 0, at which the first fingerprint's paragraph isn't the other's.

    The walk goes from the root to the sections and from those that differ to their paragraphs, by position;
    branches with equal digests aren't opened.
    """
    sections = lambda f: F.split(F.substring_index(f, ":", -1), r"\|", -1)
    digest = lambda s: F.substring_index(s, "(", 1)
    paragraphs = lambda s: F.transform(F.split(F.regexp_extract(s, r"\((.*)\)", 1), ",", -1),
                                       lambda p: F.substring_index(p, "=", 1))
    there = sections(other)
    place = "struct<section:int,paragraph:int>"
    opened = F.transform(sections(fingerprint), lambda s, i: F.when(
        digest(s).eqNullSafe(digest(F.get(there, i))), F.array().cast(f"array<{place}>")).otherwise(F.filter(
            F.transform(paragraphs(s), lambda p, j: F.when(
                ~p.eqNullSafe(F.get(paragraphs(F.get(there, i)), j)), F.struct(i.alias("section"), j.alias("paragraph")))),
            lambda x: x.isNotNull())))
    return F.when(fingerprint == other, F.array().cast(f"array<{place}>")).otherwise(F.flatten(opened))


def neighbors(docs: DataFrame, doc_id: str, size: str) -> DataFrame:
    """Each document's key (_k1, _k2) with the next one's and with the previous one's size, in order of doc_id.

    After the last comes the first. Rows with equal keys are one document; ties in doc_id
    go by key; nulls are first.
    """
    keys = docs.groupBy("_k1", "_k2").agg(F.first(doc_id).alias("_id"), F.first(size).alias("_size"))
    order = [F.col("_id").asc_nulls_first(), F.col("_k1"), F.col("_k2")]
    numbered = number_rows(keys, order, "_row")
    total = numbered.agg(F.max("_row").alias("_total"))
    circle = numbered.join(F.broadcast(total))  # one row, by construction
    before = circle.select((F.col("_row") % F.col("_total") + 1).alias("_row"),
                           F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), F.col("_size").alias("_before"))
    return numbered.select("_row", "_k1", "_k2").join(before, "_row").drop("_row")


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id).

    The edited text has its last quarter (rounded down) replaced by as many first code points
    of the next document, or all it has. Null texts are empty; a document alone is its own
    next one; rows equal in doc_id and text are one document and get equal results; every
    row gives one row; further columns are ignored; an empty table gives an empty table. A long text's sections and
    blocks are arrays within its row: a task holds a few times the bytes of its longest text.
    """
    clean = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    keyed = clean.withColumns({f"_k{i}": F.xxhash64(F.lit(i), "doc_id", "_text") for i in (1, 2)})
    places = neighbors(keyed.select("_k1", "_k2", "doc_id", F.length("_text").cast("long").alias("_n")), "doc_id", "_n")
    # what each document lends to the one before it; both sides need the same columns of the
    # documents, so they share one shuffle of the texts
    lent = with_tree(keyed.join(places, ["_k1", "_k2"]), "_text").select(
        F.col("_p1").alias("_k1"), F.col("_p2").alias("_k2"), F.col("doc_id").alias("_next_id"),
        F.substring(F.col("_text"), F.lit(1), F.floor(F.col("_before") / 4).cast("int")).alias("_lent"),
        F.substring(F.col("fingerprint"), 1, 64).alias("_next_root"), F.col("blocks").alias("_next_blocks"))
    once = lent.dropDuplicates(["_k1", "_k2"])
    own = keyed.join(once, ["_k1", "_k2"])
    size = F.length("_text")
    edited = own.withColumn("_edited", F.concat(
        F.substring(F.col("_text"), F.lit(1), size - F.floor(size / 4).cast("int")), F.col("_lent")))
    both = with_tree(with_tree(edited, "_text"), "_edited", "edited_")
    return both.select(
        "doc_id", size.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("blocks"), F.col("edited_fingerprint"), F.col("edited_blocks"))
        .alias("near_edited"),
        likeness(F.substring(F.col("fingerprint"), 1, 64), F.col("blocks"), F.col("_next_root"), F.col("_next_blocks"))
        .alias("near_next"),
        F.col("_next_id").alias("next_doc_id"),
    )


@query("op3_document_fingerprints")
def op3_document_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and their edited texts, and how alike they are."""
    return compare_with_edits(table(spark, sf_dir, "documents"))
