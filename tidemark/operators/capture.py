"""Capturing events: normalising, identity, insert-or-verify, turns, edges and projections. Applying a batch twice adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import canonical
from tidemark.functions.text import clean, redact, trimmed
from tidemark.operators.identity import EXTERNAL_ID, SCOPE, content_key, event_id, short_id

DEFAULTS = {"event_type": "message", "role": "unknown", "privacy_scope": "local", "status": "captured"}
LOWERED = ("event_type", "role", "source_platform")
TEXTS = ("event_type", "producer", "source", "source_ref", "session_id", "message_id", "role", "wing", "room", "privacy_scope", "status", *SCOPE)
REQUIRED = ("source", "session_id", "message_id", "content")
IMMUTABLE = ("event_type", "producer", "source", "source_ref", "session_id", "message_id", "role", "wing", "room", "privacy_scope", "status", "content", "content_sha256", "metadata_json", "provenance_json", *SCOPE, "authorization_version")


def normalised(batch: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Events ready to insert, and the rows that lack a required field with the reason. now: where a time is missing."""
    have = set(batch.columns)
    given = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = {}
    for c in TEXTS:
        value = clean(given(c))
        if c in LOWERED:
            value = F.lower(value)
        if c in DEFAULTS:
            value = F.when(given(c).isNull() | (value == ""), F.lit(DEFAULTS[c])).otherwise(value)
        out[c] = value
    content = trimmed(redact(F.replace(F.coalesce(given("content"), F.lit("")), F.lit("\0"), F.lit("�"))))
    rows = batch.select(*[F.col(c) for c in have if c not in out and c not in ("content", "created_at", "captured_at", "authorization_version")], *[v.alias(c) for c, v in out.items()], content.alias("content"), canonical(given("created_at"), F.lit(now)).alias("created_at"), canonical(given("captured_at"), F.lit(now)).alias("captured_at"), F.greatest(F.lit(0), F.coalesce(F.expr("try_cast(authorization_version AS INT)") if "authorization_version" in have else F.lit(0), F.lit(0))).alias("authorization_version"))
    rows = rows.withColumn("producer", F.when(F.col("producer") == "", F.col("source")).otherwise(F.col("producer")))
    rows = rows.withColumn("content_sha256", F.sha2("content", 256))
    rows = rows.withColumn("id", event_id(scoped=True, explicit="event_id" if "event_id" in have else None)).withColumn("memory_key", content_key())
    lacking = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in REQUIRED]))
    rows = rows.withColumn("__lacking", lacking)
    return rows.filter(F.size("__lacking") == 0).drop("__lacking"), rows.filter(F.size("__lacking") > 0).withColumn("reason", F.concat(F.array_join("__lacking", ", "), F.lit(" required"))).drop("__lacking")


def insert_or_verify(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, repeated, collisions): a batch row with a known id must agree in all immutable columns.

    Within a batch the first row of an id (by seq, where there is one) is the new one, and the others are held against it.
    """
    fields = [c for c in IMMUTABLE if c in store.columns and c in batch.columns]
    order = F.col("seq") if "seq" in batch.columns else F.hash(*fields)
    ranked = batch.withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(order)))
    new = ranked.filter("__rank = 1").drop("__rank").join(store.select("id"), "id", "left_anti")
    held = store.select("id", *fields).unionByName(new.select("id", *fields))
    held = held.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    rest = ranked.join(store.select("id").withColumn("__known", F.lit(True)), "id", "left").filter("__rank > 1 OR __known").drop("__rank", "__known")
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in fields]))
    checked = rest.join(held, "id").withColumn("fields", differs)
    return new, checked.filter(F.size("fields") == 0).select(*batch.columns), checked.filter(F.size("fields") > 0).select("id", "fields")


def turn_messages(turns: DataFrame) -> DataFrame:
    """Turns (turn_id, messages: array of structs with message_id, role, content) as messages; ids default to turn:place."""
    rows = turns.select("*", F.posexplode("messages").alias("__i", "__m")).drop("messages")
    turn = F.when(F.coalesce(F.trim("turn_id"), F.lit("")) == "", F.lit("turn")).otherwise(F.col("turn_id"))
    own = F.nullif(F.trim("__m.message_id"), F.lit(""))
    return rows.select(*[c for c in rows.columns if c not in ("__i", "__m")], F.coalesce(own, F.concat_ws(":", turn, (F.col("__i") + 1).cast("string"))).alias("message_id"), F.col("__m.role").alias("role"), F.col("__m.content").alias("content"))


def counts(store: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """requested, inserted and existing rows of a batch."""
    known = store.select(key).distinct().withColumn("__known", F.lit(True))
    rows = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(known, key, "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requested"), F.count_if(F.col("__known").isNull()).alias("inserted"), F.coalesce(F.sum(F.col("n") - F.when(F.col("__known").isNull(), 1).otherwise(0)), F.lit(0)).alias("existing"))


def edges_of(events: DataFrame) -> DataFrame:
    """Supersession edges from metadata_json: $.supersedes and $.extensions.supersedes, text or integer, or lists of them."""
    found = events.select("id", "created_at", F.explode(F.array(F.get_json_object("metadata_json", "$.supersedes"), F.get_json_object("metadata_json", "$.extensions.supersedes"))).alias("v")).filter("v IS NOT NULL")
    many = F.from_json("v", "array<string>")
    flat = found.select("id", "created_at", F.explode(F.when(F.col("v").startswith("["), many).otherwise(F.array("v"))).alias("superseded_event_id"))
    # A list within a list comes as its JSON text.
    inner = F.from_json("superseded_event_id", "array<string>")
    flat = flat.select("id", "created_at", F.explode(F.when(F.col("superseded_event_id").startswith("["), inner).otherwise(F.array("superseded_event_id"))).alias("superseded_event_id"))
    flat = flat.filter(F.col("superseded_event_id").rlike(EXTERNAL_ID) & (F.col("superseded_event_id") != F.col("id")))
    return flat.select("superseded_event_id", F.col("id").alias("superseding_event_id"), F.col("created_at").alias("recorded_at")).dropDuplicates(["superseded_event_id", "superseding_event_id"])


PAIRS = "array<struct<superseded_event_id:string,superseding_event_id:string,supersededEventId:string,supersedingEventId:string>>"


def cancellations_of(events: DataFrame) -> DataFrame:
    """Cancelled pairs from metadata_json, in either spelling, valid, distinct, once each."""
    paths = ("$.cancels_supersessions", "$.cancelsSupersessions", "$.extensions.cancels_supersessions", "$.extensions.cancelsSupersessions")
    found = events.select("id", "created_at", F.explode(F.array(*[F.get_json_object("metadata_json", p) for p in paths])).alias("v")).filter("v IS NOT NULL")
    pairs = found.select("id", "created_at", F.explode(F.from_json(F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.concat(F.lit("["), F.col("v"), F.lit("]"))), PAIRS)).alias("p"))
    rows = pairs.select(F.coalesce("p.superseded_event_id", "p.supersededEventId").alias("superseded_event_id"), F.coalesce("p.superseding_event_id", "p.supersedingEventId").alias("superseding_event_id"), F.col("id").alias("cancellation_event_id"), F.col("created_at").alias("recorded_at"))
    valid = F.col("superseded_event_id").rlike(EXTERNAL_ID) & F.col("superseding_event_id").rlike(EXTERNAL_ID) & (F.col("superseded_event_id") != F.col("superseding_event_id"))
    return rows.filter(valid).dropDuplicates(["superseded_event_id", "superseding_event_id", "cancellation_event_id"])


def mark_projected(projections: DataFrame, events: DataFrame, target: str, at: str) -> DataFrame:
    """New success rows for events (id, and projection_ref if they have one) that have none."""
    ref = F.col("projection_ref") if "projection_ref" in events.columns else F.lit("")
    rows = events.select(F.col("id").cast("string").alias("event_id"), F.coalesce(ref, F.lit("")).alias("projection_ref")).groupBy("event_id").agg(F.max("projection_ref").alias("projection_ref")).withColumn("projection_id", short_id("proj_", F.lit("1"), F.col("event_id"), F.lit(target), F.lit("success")))
    return rows.join(projections.select("projection_id"), "projection_id", "left_anti").select("projection_id", "event_id", F.lit(target).alias("target"), F.lit("success").alias("status"), F.lit(at).alias("projected_at"), "projection_ref")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Replace on key: the last row of each."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def upsert_documents(store: DataFrame, batch: DataFrame, at: str) -> DataFrame:
    """Documents (doc_id, content, wing, room) cleaned, blank ones skipped, replaced by id."""
    content = clean(F.col("content"))
    given = F.nullif(F.trim("doc_id"), F.lit("")) if "doc_id" in batch.columns else F.lit(None).cast("string")
    rows = batch.withColumn("content", content).filter("content <> ''").withColumn("content_sha256", F.sha2("content", 256)).withColumn("doc_id", F.coalesce(given, F.concat(F.lit("doc_"), F.sha2("content", 256)))).withColumn("indexed_at", F.lit(at))
    both = store.withColumn("__o", F.lit(0)).unionByName(rows.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["doc_id"], "__o").drop("__o")


def upsert_embeddings(store: DataFrame, batch: DataFrame, events: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Vectors replaced on (event, model, digest); refused rows with the reason."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    known = events.select(F.col("id").alias("event_id")).distinct().withColumn("__known", F.lit(True))
    rows = batch.join(known, "event_id", "left")
    reason = F.when(F.coalesce(F.trim("model"), F.lit("")) == "", "model required").when(~F.coalesce(F.col("model_digest").rlike("^[a-f0-9]{64}$"), F.lit(False)), "digest required").when(F.size("vector") != F.col("dimensions"), "dimensions differ").when(~finite, "not finite").when(F.col("__known").isNull(), "unknown event")
    rows = rows.withColumn("reason", reason).drop("__known")
    good = rows.filter("reason IS NULL").drop("reason")
    both = store.withColumn("__o", F.lit(None).cast(good.schema[order].dataType) if order not in store.columns else F.col(order)).unionByName(good.withColumn("__o", F.col(order)), allowMissingColumns=True)
    return latest(both, ["event_id", "model", "model_digest"], "__o").drop("__o"), rows.filter("reason IS NOT NULL")


def mark_served(served: DataFrame, items: DataFrame) -> DataFrame:
    """Items (memory_key, consumer, session_id) that weren't served yet."""
    key = ["memory_key", "consumer", "session_id"]
    return items.filter("coalesce(session_id, '') <> ''").select(*key).distinct().join(served.select(*key), key, "left_anti")
