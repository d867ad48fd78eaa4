"""Importing this module registers the queries of every operator of the subpackage."""

from tideline.llm import (  # noqa: F401
    conversation_repair,
    fingerprints,
    hard_negatives,
    html_extract,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    pieces,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filter,
)
from tideline.llm.common import ORACLES, QUERIES  # noqa: F401
