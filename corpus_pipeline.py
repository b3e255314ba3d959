"""From documents to token ids: quality rules, near-duplicates, benchmark passages, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. Documents with a null doc_id are judged by the first, third and fourth stage and stay in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminated, find_contamination, write_blocks
from tidemark.llm.op1 import digests
from tidemark.llm.quality_rules import judge, learn
from tidemark.llm.simhash_forest import BROADCAST_IDS, near_duplicates
from tidemark.runtime import table, written

#: A similarity join and the encoding of whole texts are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that a learned rule rejects go."""
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).filter("kept").select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    classes = near_duplicates(docs.select("doc_id", "text"))
    gone = written(classes.filter("doc_id != class_id").select("doc_id").distinct(), "duplicates")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with more of the benchmark than the limits go; what shorter passages the others hold is cut out."""
    blocks = write_blocks(table(spark, sf_dir, "benchmark"))
    found = decontaminated(find_contamination(docs, blocks))
    cut = F.col("n_hit") > 0
    columns = {"text": F.col("clean_text"), "n_chars": F.when(cut, F.length("clean_text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("clean_text")}
    return found.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return digests(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicate), ("decontamination", decontamination), ("byte-level BPE", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
