"""Query op3_license_scan: license phrases and notices in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.license_scan import scan
from tidemark.runtime import table

NAME = "op3_license_scan"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
