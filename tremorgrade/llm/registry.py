"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tremorgrade.llm import (
    ball_tree,
    chat,
    contamination,
    divergence,
    fingerprints,
    histograms,
    jaccard_join,
    licenses,
    quality,
    suffix_dedup,
    token_files,
    unigram,
    urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontamination": contamination.op3_decontamination,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_fingerprint": fingerprints.op5_fingerprint,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_url_filter": urls.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_sentencepiece": unigram.op9_sentencepiece,
    "op10_token_files": token_files.op10_token_files,
    "op11_divergence": divergence.op11_divergence,
    "op12_quality_rules": histograms.op12_quality_rules,
    "op13_lexical_search": ball_tree.op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_quality_rules": histograms.OP12_SQL,
    "op13_lexical_search": ball_tree.OP13_SQL,
}
