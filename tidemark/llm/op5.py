"""Query op5_token_counts: greedy word-piece counts of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.token_counts import count_tokens, sentencepiece_vocabulary
from tidemark.runtime import table

NAME = "op5_token_counts"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_words", "n_tokens", "n_unknown")
