"""Which events are superseded, control the lifecycle, are current, pending or without scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL_TYPES = ("fact_retraction", "fact_conflict")
PAIR = ["superseded_event_id", "superseding_event_id"]


def live_edges(edges: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Edges without a cancellation of the same pair, and with a successor."""
    return edges.filter("superseding_event_id IS NOT NULL").join(cancellations.select(*PAIR), PAIR, "left_anti")


def superseded_ids(edges: DataFrame, cancellations: DataFrame) -> DataFrame:
    return live_edges(edges, cancellations).select(F.col("superseded_event_id").alias("id")).distinct()


def is_control(event_type: str = "event_type", metadata: str | None = "metadata_json") -> Column:
    """By type, or by a true or 1 under lifecycle_control; the strings "1" and "true" don't count."""
    out = F.col(event_type).isin(*CONTROL_TYPES)
    if metadata:
        flag = F.try_variant_get(F.try_parse_json(F.col(metadata)), "$.lifecycle_control", "variant")
        kind = F.schema_of_variant(flag)
        text = flag.cast("string")
        out = out | F.coalesce((kind == "BOOLEAN") & (text == "true"), F.lit(False)) | F.coalesce(kind.isin("BIGINT", "DOUBLE") & (text == "1"), F.lit(False)) | F.coalesce(kind.startswith("DECIMAL") & (text == "1"), F.lit(False))
    return out


def with_superseded(events: DataFrame, edges: DataFrame, cancellations: DataFrame) -> DataFrame:
    flags = superseded_ids(edges, cancellations).withColumn("__s", F.lit(True))
    return events.join(flags, "id", "left").withColumn("superseded", F.coalesce("__s", F.lit(False))).drop("__s")


def current_events(events: DataFrame, edges: DataFrame, cancellations: DataFrame, history: bool = False, metadata: str | None = None) -> DataFrame:
    """Events that are neither superseded nor control the lifecycle; with history, all."""
    if history:
        return events
    return events.filter(~is_control(metadata=metadata)).join(superseded_ids(edges, cancellations), "id", "left_anti")


def pending(events: DataFrame, projections: DataFrame, target: str = "index") -> DataFrame:
    """Events without a successful projection to the target."""
    done = projections.filter((F.col("target") == target) & (F.col("status") == "success")).select(F.col("event_id").alias("id"))
    return events.join(done, "id", "left_anti")


def listed(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy("created_at", "seq").limit(max(1, limit))


SCOPE_COLUMNS = ("source_profile", "source_platform", "source_chat_id", "source_user_id", "source_topic_id", "source_session_id", "scope_kind", "authorization_version")


def unscoped(events: DataFrame, guarded: tuple[str, ...] = (), json_columns: tuple[str, ...] = ("metadata_json", "provenance_json")) -> DataFrame:
    """Events that carry no access scope in any column or, at any depth, in their JSON. In doubt an event stays out."""
    from tidemark.functions.structured import unscoped_udf
    from tidemark.runtime import ship

    ship(events.sparkSession)
    test = F.lit(True)
    for c in ("source", "producer"):
        if c in events.columns:
            test = test & ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*(guarded or ("\0",)))
    if "privacy_scope" in events.columns:
        test = test & (F.col("privacy_scope") == "local")
    if "status" in events.columns:
        test = test & F.col("status").isin("captured", "current")
    for c in SCOPE_COLUMNS:
        if c in events.columns:
            test = test & F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    for c in json_columns:
        if c in events.columns:
            test = test & unscoped_udf(guarded)(F.col(c))
    return events.filter(test)


def located(events: DataFrame, wing: str | None = None, room: str | None = None, without_sessions: tuple[str, ...] = (), without_sources: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    out = events
    for column, value in (("wing", wing), ("room", room)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if without_sessions:
        out = out.filter(~F.col("session_id").isin(*dict.fromkeys(without_sessions)))
    if without_sources:
        out = out.filter(~F.col("source").isin(*dict.fromkeys(without_sources)))
    return out.filter(F.col("event_type").isin(*types)) if types else out


def ledger(events: DataFrame, types: tuple[str, ...] = (), newest_first: bool = False, limit: int | None = None) -> DataFrame:
    order = [F.col("created_at").desc(), F.col("seq").desc()] if newest_first else [F.col("created_at"), F.col("seq")]
    out = located(events, types=types).orderBy(*order)
    return out.limit(limit) if limit else out
