"""Temporal facts: which occurrence of a lineage holds when, and how retractions and conflicts change that.

A lineage is (entity_id, lineage_key); its facts are ordered by the text of their effective start, then by seq. Facts
without a lineage key never supersede each other; in a window they are dealt by fact, so they don't meet in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import canonical, effective_from, order_text, parsed

LINEAGE = ("entity_id", "lineage_key")
TERMINAL = ("retracted", "conflict")


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("__ord", order_text()).withColumn("__eff", effective_from())


def _next(*partition: str) -> Column:
    """The first later fact of the lineage that isn't in conflict; a retracted one counts."""
    usable = "IF(__status <> 'conflict', struct(fact_id, __eff), NULL)"
    return F.expr(f"lead({usable}) IGNORE NULLS OVER (PARTITION BY {', '.join(partition)} ORDER BY __ord, seq)")


def reconcile(facts: DataFrame) -> DataFrame:
    """facts with status, valid_to and superseded_by as they follow from base statuses; terminal rows keep theirs.

    One pass: facts with and without a key aren't made apart, as facts that are costly to make would be made twice.
    """
    base = _ordered(facts).withColumn("__status", F.when(F.lower("status").isin(*TERMINAL), F.lower("status")).otherwise("current"))
    rows = base.withColumn("__alone", F.when(F.col("lineage_key").isNull(), F.col("fact_id"))).withColumn("__next", _next(*LINEAGE, "__alone"))
    rows = rows.withColumn("__next", F.when(F.col("lineage_key").isNotNull(), F.col("__next")))
    terminal, followed = F.col("__status").isin(*TERMINAL), F.col("__next").isNotNull()
    status = F.when(terminal, F.col("__status")).when(followed, "superseded").otherwise("current")
    valid_to = F.when(terminal, F.col("valid_to")).when(followed, F.nullif(F.col("__next.__eff"), F.lit("")))
    by = F.when(~terminal & followed, F.col("__next.fact_id"))
    out = rows.withColumn("valid_to", valid_to).withColumn("superseded_by", by).withColumn("status", status)
    return out.drop("__ord", "__eff", "__status", "__alone", "__next")


def apply_terminals(facts: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retractions and conflicts (fact_id, status, instant, arrival) on facts; returns facts and refused transitions.

    The first of a fact wins; the same again is ignored; another status, an unreadable instant and one before the fact's
    start are refused. The end in force when it arrives stays: a superseded fact keeps its bound.
    """
    known = reconcile(facts).select("fact_id", F.col("valid_to").alias("__bound"), effective_from().alias("__from"))
    asked = transitions.join(known, "fact_id", "left").withColumn("__at", parsed(F.col("instant")))
    early = F.col("__at") < parsed(F.col("__from"))
    reason = F.when(F.col("__from").isNull(), "unknown fact").when(~F.col("status").isin(*TERMINAL), "unknown status").when(F.col("__at").isNull(), "invalid instant").when(early, "before its start")
    asked = asked.withColumn("reason", reason)
    valid = asked.filter("reason IS NULL").withColumn("__rank", F.row_number().over(Window.partitionBy("fact_id").orderBy("arrival")))
    first = valid.filter("__rank = 1").select("fact_id", F.col("status").alias("__new"), F.coalesce(F.nullif("__bound", F.lit("")), canonical(F.col("instant"))).alias("__to"))
    later = valid.filter("__rank > 1").join(first.select("fact_id", "__new"), "fact_id").filter("status <> __new").withColumn("reason", F.lit("has another terminal status"))
    columns = transitions.columns
    refused = asked.filter("reason IS NOT NULL").select(*columns, "reason").unionByName(later.select(*columns, "reason"))
    joined = facts.join(first, "fact_id", "left")
    fresh = F.col("__new").isNotNull() & ~F.lower("status").isin(*TERMINAL)
    changed = joined.withColumn("valid_to", F.when(fresh, F.col("__to")).otherwise(F.col("valid_to"))).withColumn("status", F.when(fresh, F.col("__new")).otherwise(F.col("status")))
    return changed.drop("__new", "__to"), refused


def is_current() -> Column:
    return (F.lower("status") == "current") & (F.coalesce(F.trim("valid_to"), F.lit("")) == "")


def at_time(facts: DataFrame, mode: str = "current", as_of: str | None = None) -> DataFrame:
    """All facts (historical), those in force now (current), or those in force at an instant (as_of)."""
    if mode == "historical":
        return facts
    if mode == "current":
        return facts.filter(is_current())
    at = parsed(F.lit(as_of))
    start, end = parsed(effective_from()), parsed(F.col("valid_to"))
    inside = (start.isNull() | (start <= at)) & (end.isNull() | (at < end)) & (start.isNotNull() | is_current())
    return facts.filter(at.isNotNull() & (F.lower("status") != "conflict") & inside)


def lane_counts(facts: DataFrame, selected: Column | None = None) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    status = F.lower("status")
    chosen = F.lit(True) if selected is None else selected
    return facts.agg(count(is_current(), "current"), count(~is_current(), "historical"), count(status == "superseded", "superseded"), count(status == "retracted", "retracted"), count(status == "conflict", "conflict"), count(chosen, "selected"))


def materialized(facts: DataFrame) -> DataFrame:
    """The latest occurrence of each (entity_id, kind, value)."""
    latest = Window.partitionBy("entity_id", "kind", "value").orderBy(F.col("__ord").desc(), F.col("seq").desc())
    return facts.withColumn("__ord", order_text()).withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1").drop("__ord", "__rank")


OCCURRENCE = ("entity_id", "kind", "value", "source_ref", "said_at", "valid_from")


def read_merge(events: DataFrame, projection: DataFrame, limit: int | None = None) -> DataFrame:
    """Event rows, and the projection's rows that are neither there by id nor by occurrence; latest start first."""
    same = None
    e = events.select(*[F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in OCCURRENCE]).distinct()
    left = projection.join(events.select("fact_id"), "fact_id", "left_anti")
    for c in OCCURRENCE:
        test = F.coalesce(left[c], F.lit("")) == e[f"__{c}"]
        same = test if same is None else same & test
    merged = events.unionByName(left.join(e, same, "left_anti"))
    ordered = merged.orderBy(parsed(effective_from()).desc_nulls_last(), F.col("seq").desc())
    return ordered.limit(limit) if limit else ordered


def restoration_pairs(facts: DataFrame) -> DataFrame:
    """(superseded, superseding) for each conflict: the facts that it had superseded and that are current again.

    Where there is none, the nearest earlier current fact of the lineage.
    """
    keyed = _ordered(facts.filter("lineage_key IS NOT NULL"))
    by_order = Window.partitionBy(*LINEAGE).orderBy("__ord", "seq")
    terminal = F.lower("status")
    with_conflicts = keyed.withColumn("__status", F.when(terminal.isin(*TERMINAL), terminal).otherwise("current")).withColumn("__next", _next(*LINEAGE))
    # Had the conflict not been declared, the row right after each would have been its successor unless in conflict too.
    seen = with_conflicts.withColumn("__now", F.when(F.col("__status") != "current", F.col("__status")).when(F.col("__next").isNotNull(), "superseded").otherwise("current"))
    seen = seen.withColumn("__after", F.lead(F.struct("fact_id", "__status")).over(by_order))
    direct = seen.filter("__now = 'current' AND __after.__status = 'conflict'").select(F.col("fact_id").alias("superseded_event_id"), F.col("__after.fact_id").alias("superseding_event_id"))
    nearest = F.last(F.when(F.col("__now") == "current", F.col("fact_id")), ignorenulls=True).over(by_order.rowsBetween(Window.unboundedPreceding, -1))
    fallback = seen.withColumn("__near", nearest).filter("__status = 'conflict' AND __near IS NOT NULL").select(F.col("__near").alias("superseded_event_id"), F.col("fact_id").alias("superseding_event_id"))
    return direct.unionByName(fallback.join(direct.select("superseding_event_id"), "superseding_event_id", "left_anti").select("superseded_event_id", "superseding_event_id"))


def snapshots(facts: DataFrame) -> DataFrame:
    """Each fact as it was known when it was inserted: status, valid_to, and the facts that it superseded then.

    Of the lineage only facts with a lower seq count, and a terminal status of another one only if it was in force by
    then. A lineage's work grows with the square of its length.
    """
    rows = _ordered(facts)
    anchors = rows.select(F.col("seq").alias("a_seq"), F.col("fact_id").alias("a_id"), *LINEAGE, F.coalesce(parsed(F.col("created_at")), parsed(F.col("__eff"))).alias("a_at"))
    keyed = anchors.filter("lineage_key IS NOT NULL")
    known = keyed.join(rows, list(LINEAGE)).filter("seq <= a_seq")
    ended = F.lower("status").isin(*TERMINAL) & (F.col("seq") != F.col("a_seq")) & (parsed(F.col("valid_to")) <= F.col("a_at"))
    known = known.withColumn("__status", F.when(ended, F.lower("status")).otherwise("current"))
    known = known.withColumn("__next", _next("a_seq"))
    own = F.col("seq") == F.col("a_seq")
    replaced = (F.col("__status") == "current") & (F.col("__next.fact_id") == F.col("a_id"))
    out = known.groupBy("a_seq", "a_id").agg(
        F.max(F.when(own, F.when(F.col("__next").isNull(), "current").otherwise("superseded"))).alias("status"),
        F.max(F.when(own, F.nullif(F.col("__next.__eff"), F.lit("")))).alias("valid_to"),
        F.array_sort(F.collect_set(F.when(replaced, F.col("fact_id")))).alias("superseded_ids"),
    )
    alone = anchors.filter("lineage_key IS NULL").select("a_seq", "a_id", F.lit("current").alias("status"), F.lit(None).cast("string").alias("valid_to"), F.array().cast("array<string>").alias("superseded_ids"))
    return out.unionByName(alone).select(F.col("a_seq").alias("seq"), F.col("a_id").alias("fact_id"), "status", "valid_to", "superseded_ids")


def insert_facts(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New occurrences of a batch, and those whose id is taken by a row that differs (collisions)."""
    fields = ("entity_id", "kind", "value", "evidence", "source_ref", "said_at", "said_by", "confidence", "lineage_key", "valid_from")
    held = [c for c in fields if c in store.columns and c in batch.columns]
    fresh = batch.join(store.select("fact_id"), "fact_id", "left_anti").dropDuplicates(["fact_id"])
    s = store.select("fact_id", *[F.col(c).alias(f"__{c}") for c in held])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in held]))
    collisions = batch.join(s, "fact_id").withColumn("fields", differs).filter(F.size("fields") > 0).select("fact_id", "fields")
    return fresh, collisions


def lineages(facts: DataFrame) -> DataFrame:
    return facts.filter("lineage_key IS NOT NULL").select(*LINEAGE).distinct()


def mismatched(events: DataFrame, projection: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a projection that differ from the event of their id in one of the columns."""
    p = projection.select("fact_id", *[F.col(c).alias(f"__{c}") for c in columns])
    differs = None
    for c in columns:
        test = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        differs = test if differs is None else differs | test
    return events.join(p, "fact_id").filter(differs).select("fact_id")
