"""A training-data pipeline: what is toxic goes, repeats go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and
returns documents with the columns of the documents table; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm.common import checkpointed, table
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.ngram_join import one_of_each_group
from tideline.llm.packing import pack
from tideline.llm.substring_dedup import dedup_substrings
from tideline.llm.toxicity import score_toxicity


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                           .otherwise(F.col("n_chars")))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of three lines and of single lines of ten words or more."""
    return _measured(dedup_lines(docs, alone=10))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8."""
    return one_of_each_group(docs, n=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier place has."""
    return _measured(dedup_substrings(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_per_group),
    ("substring dedup", without_repeated_passages),
    ("best-fit packing", packed),
]

#: The stages' models and graph searches are beyond SQL; tests hold line dedup and the join against plain
#: Python, toxicity against the operator's verdicts, substring dedup and packing by their properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
