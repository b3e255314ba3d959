"""Query op2_quality_rules: counts and verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.quality_rules import judge, learn
from tidemark.runtime import table

NAME = "op2_quality_rules"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
