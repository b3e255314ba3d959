"""Query op6_token_store: every text of documents as ids in a content-addressed store, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.token_store import checked_crc, read_store, write_store
from tidemark.runtime import table

NAME = "op6_token_store"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return checked_crc(read_store(spark, folder))
