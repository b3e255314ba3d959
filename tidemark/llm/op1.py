"""Query op1_byte_bpe: every text of documents encoded and decoded again."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import RESULT, ByteBPE, load_ranks
from tidemark.runtime import table

NAME = "op1_byte_bpe"
ORACLE = None


@functools.lru_cache(2)
def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> ByteBPE:
    return ByteBPE(load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def digests(docs: DataFrame) -> DataFrame:
    bpe = tokenizer()
    coded = bpe.encode(docs.select("doc_id", "text"))
    ids = F.when(F.col(RESULT) == "", F.array().cast("array<string>")).otherwise(F.split(RESULT, ","))
    coded = coded.select("doc_id", F.col(RESULT), ids.alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(RESULT, 256).alias("ids_sha256"), F.sha2(bpe.decoded(F.col("ids")), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
