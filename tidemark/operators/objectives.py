"""Objectives and references to external runs, and the registry that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_column
from tidemark.operators.identity import EXTERNAL_ID


def objective_events(rows: DataFrame) -> DataFrame:
    """Rows (objective_id, source, session_id, title, status, detail) as events."""
    title, status = clean_column(F.col("title")), F.coalesce(F.nullif(clean_column(F.col("status")), F.lit("")), F.lit("active"))
    meta = F.to_json(F.struct(F.array().cast("array<string>").alias("constraints"), clean_column(F.col("detail")).alias("detail"), F.col("objective_id"), F.create_map().cast("map<string,string>").alias("provenance"), status.alias("status"), title.alias("title")))
    out = rows.filter(F.col("objective_id").rlike(EXTERNAL_ID)).withColumn("metadata_json", meta).withColumn("content", title)
    identity = F.concat(F.lit('{"metadata":'), F.col("metadata_json"), F.lit(',"sessionId":'), F.to_json(F.array("session_id")), F.lit(',"source":'), F.to_json(F.array("source")), F.lit("}"))
    return out.filter("content <> ''").withColumn("id", F.concat(F.lit("objective_"), F.sha2(identity, 256))).withColumn("event_type", F.lit("objective"))


def run_events(rows: DataFrame) -> DataFrame:
    """Rows (objective_id, executor, run_id, source, session_id) as events."""
    valid = F.col("objective_id").rlike(EXTERNAL_ID) & F.col("executor").rlike(EXTERNAL_ID) & F.col("run_id").rlike(EXTERNAL_ID)
    meta = F.to_json(F.struct(F.lit("executor").alias("authority"), "executor", "objective_id", "run_id"))
    reference = F.concat_ws(":", "executor", "run_id")
    out = rows.filter(valid).withColumn("metadata_json", meta).withColumn("source_ref", reference).withColumn("content", F.concat(F.lit("External run "), reference, F.lit(" for objective "), F.col("objective_id")))
    identity = F.concat(F.lit('{"metadata":'), F.col("metadata_json"), F.lit(',"sessionId":'), F.to_json(F.array("session_id")), F.lit(',"source":'), F.to_json(F.array("source")), F.lit("}"))
    return out.withColumn("id", F.concat(F.lit("run_ref_"), F.sha2(identity, 256))).withColumn("event_type", F.lit("external_run_reference"))


def registry(events: DataFrame) -> DataFrame:
    """objective_id, title, status, source and runs: the last objective event rules; runs are distinct and sorted."""
    # One parse of a row's JSON instead of one for each key, and none again in a filter that moves below.
    keys = ("objective_id", "title", "status", "executor", "run_id")
    rows = events.filter(F.col("event_type").isin("objective", "external_run_reference")).select("event_type", "source", "content", "created_at", "seq", F.json_tuple("metadata_json", *keys).alias(*keys))
    rows = rows.filter(F.col("objective_id").rlike(EXTERNAL_ID))
    order = F.struct("created_at", "seq")
    own = F.col("event_type") == "objective"
    state = F.struct(F.coalesce(F.nullif("title", F.lit("")), F.col("content")).alias("title"), F.coalesce(F.nullif("status", F.lit("")), F.lit("active")).alias("status"), F.col("source").alias("source"))
    run = F.when(~own & F.col("executor").rlike(EXTERNAL_ID) & F.col("run_id").rlike(EXTERNAL_ID), F.concat_ws(":", "executor", "run_id"))
    g = rows.groupBy("objective_id").agg(F.max_by(F.when(own, state), F.when(own, order)).alias("o"), F.min_by("source", order).alias("first"), F.array_sort(F.collect_set(run)).alias("runs"))
    return g.select("objective_id", F.coalesce("o.title", F.lit("")).alias("title"), F.coalesce("o.status", F.lit("unknown")).alias("status"), F.coalesce("o.source", "first").alias("source"), F.array_join("runs", ",").alias("runs"))


