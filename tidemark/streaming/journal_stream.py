"""Incremental capture, and a store of facts for lineage, with Structured Streaming.

``capture_stream`` appends new events to a Parquet table batch by batch: identity makes a repeated delivery a no-op.
``lineage_stream`` only stores the facts as they arrive, however late, by bucket of lineage; nothing is dropped and nothing is
recomputed in the stream. ``stored_lineages`` reconciles on reading: all stored rows, or those of given lineages, for which
only the buckets that hold them are read.

An epoch that is run again, as it was not committed, writes its own folder anew; what that folder holds doesn't count as known.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.lineage import reconcile

BUCKETS = 64
#: Rows of a file that a stream is fed from.
ROWS_A_FILE = 250_000


def files_each(rows: int, batches: int) -> int:
    """Files of a micro-batch, so that its reading is dealt over more tasks as the input grows, and batches stay as many."""
    return max(1, math.ceil(rows / (batches * ROWS_A_FILE)))


def _stored(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame | None:
    """The rows of all epochs; schema: with the columns of the folders."""
    try:
        return spark.read.schema(schema).parquet(root)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _bucket():
    return F.pmod(F.xxhash64("entity_id", "lineage_key"), F.lit(BUCKETS)).cast("int")


def capture_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Starts a query that appends the events of a stream that the table lacks."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        known = _stored(spark, path, T.StructType([*batch.schema, T.StructField("epoch", T.LongType())]))
        if known is not None:
            new = new.join(known.filter(F.col("epoch") != epoch).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lineage_stream(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that stores facts by bucket of lineage, each epoch in a folder of its own.

    Rows are dealt by bucket first: a bucket is one file of an epoch, however many tasks read the batch.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("bucket", _bucket()).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_lineages(spark: SparkSession, path: str, schema, touched: DataFrame | None = None) -> DataFrame:
    """The reconciled facts of a stored stream; touched: only of these lineages (entity_id, lineage_key)."""
    names = [f.name for f in schema]
    rows = _stored(spark, path, T.StructType([*schema, T.StructField("epoch", T.LongType()), T.StructField("bucket", T.IntegerType())]))
    if rows is None:
        return reconcile(spark.createDataFrame([], schema))
    if touched is not None:
        touched = touched.select("entity_id", "lineage_key").distinct().withColumn("bucket", _bucket())
        held = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS
        rows = rows.filter(F.col("bucket").isin(*held)) if held else rows.filter(F.lit(False))
        rows = rows.join(touched, ["bucket", "entity_id", "lineage_key"], "left_semi")
    return reconcile(rows.select(*names).dropDuplicates(["fact_id"]))
