"""Which documents a search may show, by the events that they are linked with; and the search itself.

Documents have doc_id, content, wing, room, source_file, event_id, event_source, event_session_id, indexed_at and
metadata_json. A document without a linked event is judged by its own columns alone.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import is_control, superseded_ids, unscoped
from tidemark.operators.search import bm25
from tidemark.runtime import ship

#: Keys under which a document's metadata may name its event.
EVENT_KEYS = ("event_id", "eventId", "memory_event_id", "memoryEventId")
LIFECYCLE = ("fact", "fact_retraction", "fact_conflict")


def contradicts(metadata: str | None, event_id: str | None) -> bool:
    """Whether, at any depth, a key of EVENT_KEYS has a value other than an empty one or this event's id."""
    try:
        todo = [json.loads(metadata)] if metadata else []
    except ValueError:
        return False
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            for key, value in node.items():
                if key in EVENT_KEYS and value is not None:
                    if isinstance(value, (dict, list)) or str(int(value) if isinstance(value, bool) else value) not in ("", event_id):
                        return True
                todo.append(value)
    return False


def _contradicts_udf():
    @F.pandas_udf("boolean")
    def applied(metadata: pd.Series, event_id: pd.Series) -> pd.Series:
        return pd.Series([contradicts(m, e) for m, e in zip(metadata, event_id, strict=True)], dtype=bool)

    return applied


def linked(documents: DataFrame, events: DataFrame, edges: DataFrame, cancellations: DataFrame, metadata: str | None = None) -> DataFrame:
    """documents with __id, __type, __source, __control and __gone of the event that they are linked with; null without one."""
    rows = events.select(F.col("id").alias("__id"), F.col("event_type").alias("__type"), F.col("source").alias("__source"), is_control(metadata=metadata).alias("__control"))
    gone = superseded_ids(edges, cancellations).select(F.col("id").alias("__id"), F.lit(True).alias("__s"))
    rows = rows.join(gone, "__id", "left").withColumn("__gone", F.coalesce("__s", F.lit(False))).drop("__s")
    return documents.join(rows, F.col("event_id") == F.col("__id"), "left")


LINK = ("__id", "__type", "__source", "__control", "__gone")


def admissible(
    documents: DataFrame,
    events: DataFrame,
    edges: DataFrame,
    cancellations: DataFrame,
    history: bool = False,
    ledger: str | None = None,
    ledger_lifecycle: bool = False,
    control: bool = True,
    wing: str | None = None,
    room: str | None = None,
    without_sessions: tuple[str, ...] = (),
    without_sources: tuple[str, ...] = (),
    metadata: str | None = None,
) -> DataFrame:
    """Documents that a search may show.

    Out go: those linked with a fact of the ledger (a source; with ledger_lifecycle also what changes its facts); without
    history, those linked with a superseded event or (with control) one that controls the lifecycle; those of excluded
    sessions and sources, unless their own column is empty. Null columns count as empty.
    """
    rows = linked(documents, events, edges, cancellations, metadata)
    if ledger is not None:
        kinds = LIFECYCLE if ledger_lifecycle else ("fact",)
        rows = rows.filter(~((F.coalesce("__source", F.lit("")) == ledger) & F.coalesce("__type", F.lit("")).isin(*kinds)))
    if not history:
        hidden = F.col("__gone") | F.col("__control") if control else F.col("__gone")
        rows = rows.filter(F.col("__id").isNull() | ~hidden)
    for column, value in (("wing", wing), ("room", room)):
        if value:
            rows = rows.filter(F.col(column) == value)
    for column, values in (("event_session_id", without_sessions), ("event_source", without_sources)):
        if values:
            own = F.coalesce(column, F.lit(""))
            rows = rows.filter((own == "") | ~own.isin(*dict.fromkeys(values)))
    return rows.drop(*LINK)


def unscoped_documents(documents: DataFrame, events: DataFrame, edges: DataFrame, cancellations: DataFrame, projections: DataFrame, target: str = "index", guarded: tuple[str, ...] = (), metadata: str | None = None) -> DataFrame:
    """Documents that carry no access scope: linked with a current event without one, of the same source, that was projected
    to the document's file, and whose own metadata neither carries a scope nor names another event. In doubt one stays out;
    metadata that are null are those of a document stored without any, "{}", and leave no doubt."""
    ship(documents.sparkSession)
    current = events.filter(~is_control(metadata=metadata)).join(superseded_ids(edges, cancellations), "id", "left_anti")
    current = unscoped(current, guarded).select(F.col("id").alias("__id"), F.col("source").alias("__source"))
    done = projections.filter((F.col("target") == target) & (F.col("status") == "success") & (F.coalesce("projection_ref", F.lit("")) != ""))
    done = done.select(F.col("event_id").alias("__id"), F.col("projection_ref").alias("source_file")).distinct()
    rows = documents.join(current, F.col("event_id") == F.col("__id")).join(done, ["__id", "source_file"], "left_semi")
    rows = rows.filter((F.coalesce("event_source", F.lit("")) == "") | (F.col("event_source") == F.col("__source")))
    rows = rows.drop("__source").withColumn("__metadata", F.coalesce("metadata_json", F.lit("{}")))
    rows = unscoped(rows, guarded, ("__metadata",))
    return rows.filter(~_contradicts_udf()(F.col("metadata_json"), F.col("event_id").cast("string"))).drop("__id", "__metadata")


def documents_top(documents: DataFrame, shown: DataFrame, query: str, limit: int = 20, columns: tuple[str, ...] = ("content", "wing", "room")) -> DataFrame:
    """The best documents for a query among those shown (doc_id), the last indexed first among equals.

    Scores hold over all documents. Texts ride along only for documents that hold a term of the query.
    """
    found = bm25(documents, columns, query).join(shown.select("doc_id"), "doc_id", "left_semi")
    return found.orderBy("rank", F.col("indexed_at").desc(), "doc_id").limit(max(1, limit))
