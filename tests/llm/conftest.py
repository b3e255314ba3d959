import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture
def odd_rows(spark):
    """Null, empty and repeated texts, a null id, and columns whose names clash with results."""
    rows = [(1, None), (2, ""), (3, "the same words stand here"), (3, "the same words stand here"), (None, "no id"), (4, "  \n\t "), (5, "é日本 \U0001f642 \x00 x"), (6, "word " * 30_000), (7, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_words", F.lit("clash")).withColumn("labels", F.lit(1)).withColumn("rule", F.lit(0.5)).withColumn("n_tokens", F.lit("x"))
