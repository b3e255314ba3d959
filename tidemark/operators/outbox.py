"""The durable queue from facts to the journal: payloads, enqueueing, what is missing, and delivery in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.identity import short_id
from tidemark.operators.lineage import TERMINAL

DEFAULT_BATCH, MOST_BATCH = 50, 500


def bounded(limit: object, default: int = DEFAULT_BATCH) -> int:
    return min(MOST_BATCH, limit) if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0 else default


def fact_payload() -> Column:
    """A fact as the JSON of a journal event; superseded_ids is a column."""
    meta = F.struct("entity_id", "kind", "lineage_key", F.coalesce("superseded_ids", F.array().cast("array<string>")).alias("supersedes"), "valid_from")
    return F.to_json(F.struct(F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("value")).alias("content"), F.col("fact_id").alias("event_id"), F.lit("fact").alias("event_type"), meta.alias("metadata"), F.lit("fact-store").alias("producer"), F.struct("source_ref", "said_at").alias("provenance")))


def status_payload(reason: Column | None = None) -> tuple[Column, Column]:
    """(id, JSON) of a transition; columns fact_id, status, valid_to and pairs (only conflicts cancel)."""
    kind = F.when(F.col("status") == "retracted", "fact_retraction").otherwise("fact_conflict")
    tid = short_id("fact_transition_", F.lit("2"), F.col("fact_id"), F.col("status"), F.coalesce("valid_to", F.lit("")), length=32, separator="\0")
    meta = F.struct(F.when(F.col("status") == "conflict", F.col("pairs")).alias("cancels_supersessions"), F.lit(True).alias("lifecycle_control"), F.array("fact_id").alias("supersedes"))
    content = F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("value"), F.when(reason.isNull(), "").otherwise(F.concat(F.lit(": "), reason)) if reason is not None else F.lit(""))
    return tid, F.to_json(F.struct(content.alias("content"), tid.alias("event_id"), kind.alias("event_type"), meta.alias("metadata"), F.lit("fact-store").alias("producer")))


def enqueue(outbox: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entries (event_id, payload_json), and ids that are queued with another payload."""
    fresh = batch.join(outbox.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])
    clash = batch.join(outbox.select("event_id", F.col("payload_json").alias("__p")), "event_id").filter(~F.col("payload_json").eqNullSafe(F.col("__p"))).select("event_id")
    return fresh, clash


def missing(facts: DataFrame, outbox: DataFrame) -> DataFrame:
    """Facts of which the occurrence, or the terminal status, isn't in the queue: seq, fact_id, need_fact, need_status."""
    have = outbox.select(F.col("fact_event_id").alias("fact_id"), "lifecycle_kind").distinct()
    kinds = have.groupBy("fact_id").agg(F.max((F.col("lifecycle_kind") == "fact").cast("int")).alias("f"), F.max(F.col("lifecycle_kind").isin(*TERMINAL).cast("int")).alias("t"))
    rows = facts.select("seq", "fact_id", F.lower("status").alias("status")).join(kinds, "fact_id", "left")
    need_fact, need_status = F.coalesce("f", F.lit(0)) == 0, F.col("status").isin(*TERMINAL) & (F.coalesce("t", F.lit(0)) == 0)
    return rows.select("seq", "fact_id", need_fact.alias("need_fact"), need_status.alias("need_status")).filter("need_fact OR need_status")


def reconcile_batch(facts: DataFrame, outbox: DataFrame, limit: int | None = None) -> DataFrame:
    return missing(facts, outbox).orderBy("seq").limit(bounded(limit))


def attempted_prefix(outbox: DataFrame, limit: int | None = None) -> DataFrame:
    """What a flush does with undelivered entries (seq, ok: whether delivery would succeed): attempted, delivered.

    Entries go in order up to and including the first failure. The queue's head alone is looked at.
    """
    head = outbox.filter("delivered_at IS NULL").orderBy("seq").limit(bounded(limit))
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = head.withColumn("attempted", F.coalesce(F.min(F.col("ok").cast("int")).over(before), F.lit(1)) == 1)
    return rows.withColumn("delivered", F.col("attempted") & F.col("ok"))


def flush(outbox: DataFrame, send: Callable[[str], None], now: str, limit: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Sends the head of the queue, at most MOST_BATCH entries, one by one from the driver; stops at the first failure."""
    spark = outbox.sparkSession
    head = outbox.filter("delivered_at IS NULL").orderBy("seq").limit(bounded(limit)).select("seq", "payload_json").collect()
    done, failed = [], []
    for row in head:
        try:
            send(row["payload_json"])
            done.append((row["seq"], None))
        except Exception as error:
            failed.append((row["seq"], f"delivery:{type(error).__name__}"))
            break
    tried = spark.createDataFrame(done + failed, "seq long, __error string")
    rows = outbox.join(tried.withColumn("__tried", F.lit(True)), "seq", "left")
    ok = F.col("__tried") & F.col("__error").isNull()
    rows = rows.withColumn("attempts", F.col("attempts") + F.when(F.col("__tried"), 1).otherwise(0)).withColumn("last_error", F.when(F.col("__tried"), F.col("__error")).otherwise(F.col("last_error"))).withColumn("delivered_at", F.when(ok, F.lit(now)).otherwise(F.col("delivered_at")))
    left = outbox.filter("delivered_at IS NULL").count() - len(done)
    return rows.drop("__error", "__tried"), {"delivered": len(done), "failed": len(failed), "remaining": left}


def telemetry(rows: DataFrame) -> DataFrame:
    """A row per question: versioned, with counts by lane; texts come hashed (privacy_hash_udf) from the caller."""
    lane = lambda s: F.size(F.filter("statuses", lambda x: x == s))
    return rows.select(F.lit(1).alias("version"), "question_hash", F.slice("entity_hashes", 1, 5).alias("entity_hashes"), F.slice("source_hashes", 1, 6).alias("source_hashes"), F.struct(*[lane(s).alias(s) for s in ("current", "superseded", "retracted", "conflict")]).alias("lanes"))


