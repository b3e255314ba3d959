"""Counts over the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import pending, superseded_ids

VERSION = 5


def store_stats(events: DataFrame, edges: DataFrame, cancellations: DataFrame, projections: DataFrame, documents: DataFrame, vectors: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """One row. Each table is counted by itself; the counts are summed from a row of each."""
    names = ("events", "superseded", "pending", "documents", "embeddings", "traces")
    gone = superseded_ids(edges, cancellations)
    parts = {"events": events, "superseded": events.join(gone, "id", "left_semi"), "pending": pending(events, projections), "documents": documents, "embeddings": vectors}
    if traces is not None:
        parts["traces"] = traces
    rows = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(*[(F.col("n") if x == name else F.lit(0).cast("long")).alias(x) for x in names])
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.sum(x).alias(x) for x in names]).withColumn("schema_version", F.lit(VERSION))
