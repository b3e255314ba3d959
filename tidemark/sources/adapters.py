"""The journal and fact tables as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import ISO
from tidemark.operators.identity import content_key, event_id, fact_id
from tidemark.runtime import table

EPOCH = "2026-01-01 00:00:00"


def facts(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """events as fact occurrences: every 11th in conflict, every 13th of the others retracted, a day after it was said.
    parts: events are first dealt over so many tasks."""
    e = table(spark, sf_dir, "events")
    if parts:
        e = e.repartition(parts, "event_id")
    at = F.date_format("ts", ISO)
    status = F.when(F.col("event_id") % 11 == 0, "conflict").when(F.col("event_id") % 13 == 0, "retracted").otherwise("current")
    rows = e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("event_type").alias("kind"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("value"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("source_ref"),
        at.alias("said_at"),
        at.alias("valid_from"),
        at.alias("created_at"),
        F.col("event_type").alias("lineage_key"),
        status.alias("status"),
        F.when(status != "current", F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), ISO)).alias("valid_to"),
    )
    return rows.withColumn("fact_id", fact_id())


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as events of the journal; a minute apart, in the order of conversation and turn."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        F.lit("message").alias("event_type"),
        F.lit("chat").alias("source"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").cast("string").alias("message_id"),
        F.col("role"),
        F.col("text").alias("content"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
    )
    rows = rows.withColumn("created_at", F.date_format(F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(mins=F.col("seq").cast("int")), ISO))
    return rows.withColumn("content_sha256", F.sha2("content", 256)).withColumn("id", event_id()).withColumn("memory_key", content_key())


def bulk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as events of the journal."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.lit("message").alias("event_type"), "source", F.col("lang").alias("session_id"), F.col("doc_id").cast("string").alias("message_id"), F.lit("user").alias("role"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    rows = rows.withColumn("created_at", F.date_format(F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(mins=F.col("seq").cast("int")), ISO))
    return rows.withColumn("content_sha256", F.sha2("content", 256)).withColumn("id", event_id()).withColumn("memory_key", content_key())


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events: each row supersedes the one before it of the same user and type; rows without a time come last."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")))
    return e.select(before.alias("superseded_event_id"), F.col("event_id").alias("superseding_event_id"), F.date_format("ts", ISO).alias("recorded_at")).filter("superseded_event_id IS NOT NULL")


def cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of which the successor is in conflict."""
    return edges(spark, sf_dir).filter("superseding_event_id % 11 = 0").select("superseded_event_id", "superseding_event_id", F.col("superseding_event_id").alias("cancellation_event_id"), "recorded_at")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as plain journal rows; those in conflict or retracted control the lifecycle."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 11 == 0, "fact_conflict").when(F.col("event_id") % 13 == 0, "fact_retraction").otherwise("fact")
    return e.select(F.col("event_id").alias("id"), kind.alias("event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("source"), F.date_format("ts", ISO).alias("created_at"), F.col("event_id").alias("seq"), F.col("props").alias("metadata_json"))


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels of quality 1 as successful projections of events of the same number."""
    return table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("event_id"), F.lit("index").alias("target"), F.lit("success").alias("status"))


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents as items that a session was served already."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(toxic, "doc_id")
    return docs.select(F.concat(F.lit("content:"), F.sha2("text", 256)).alias("memory_key"), F.lit("pack").alias("consumer"), F.lit("s1").alias("session_id")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as those of a store; two of three are linked with the event of the same number."""
    d = table(spark, sf_dir, "documents")
    n, number = F.col("doc_id"), F.col("doc_id").cast("string")
    named = F.when(n % 4 == 0, F.concat(F.lit('{"event_id": "'), number, F.lit('"}'))).when(n % 4 == 1, F.lit('{"a": [{"memoryEventId": "other"}]}')).when(n % 4 == 2, F.lit('{"eventId": ""}'))
    return d.select(
        "doc_id",
        F.col("text").alias("content"),
        F.col("lang").alias("wing"),
        F.col("source").alias("room"),
        F.when(n % 6 == 0, "x").otherwise(F.concat(F.lit("f"), number)).alias("source_file"),
        F.when(n % 3 != 0, n).alias("event_id"),
        F.when(n % 5 == 0, "").otherwise(F.col("source")).alias("event_source"),
        F.when(n % 7 == 0, "").otherwise(F.col("lang")).alias("event_session_id"),
        F.lit("2026").alias("indexed_at"),
        named.alias("metadata_json"),
    )
