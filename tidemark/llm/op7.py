"""Query op7_simhash_dedup: the near-duplicate class of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.simhash_forest import near_duplicates
from tidemark.runtime import table

NAME = "op7_simhash_dedup"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
