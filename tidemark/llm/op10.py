"""Query op10_decontamination: the words of each document that lie in a window of a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_contamination, write_blocks
from tidemark.runtime import table

NAME = "op10_decontamination"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write_blocks(table(spark, sf_dir, "benchmark"))
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), blocks, clean=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))
