"""Bounded context from ranked candidates: packs, hits against superseded events, and structurally related events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import parsed, proximity
from tidemark.functions.text import clean, clipped, structural_tokens, supports, token_similarity
from tidemark.operators.identity import short_id
from tidemark.operators.lifecycle import is_control, live_edges


class LimitError(ValueError):
    """A request is beyond what the policy allows."""


@dataclass(frozen=True)
class Policy:
    anti_default: int = 3
    anti_most: int = 5
    anti_scan: int = 80
    anti_chars: int = 1200
    structural_default: int = 4
    structural_most: int = 8
    per_anchor: int = 40
    structural_chars: int = 1200
    hops: int = 1
    adapters: tuple[tuple[str, tuple[str, ...]], ...] = (("memory-objectives", ("observe", "local_write")),)

    def allows(self, adapter: str, operation: str) -> bool:
        return operation in dict(self.adapters).get(adapter, ())

    def require(self, adapter: str, operation: str) -> None:
        if not self.allows(adapter, operation):
            raise PermissionError(f"{adapter} may not {operation}")

    @staticmethod
    def bounded(value: object, default: int, most: int, name: str) -> int:
        if value is None:
            return default
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
            raise LimitError(f"{name} must be an integer from 0 to {most}")
        return value

    def limits(self, anti: int | None = None, structural: int | None = None, scan: int | None = None, hops: int | None = None) -> dict[str, int]:
        if self.bounded(hops, 1, self.hops, "hops") != 1:
            raise LimitError("hops must be 1")
        return {
            "anti": self.bounded(anti, self.anti_default, self.anti_most, "anti-hits"),
            "structural": self.bounded(structural, self.structural_default, self.structural_most, "structural hits"),
            "scan": self.bounded(scan, self.anti_scan, self.anti_scan, "scan"),
        }


def pack(candidates: DataFrame, limit: int = 5, max_chars: int = 2000, max_item_chars: int | None = None, served: DataFrame | None = None, query: str | None = None, scan: int = 1000) -> DataFrame:
    """Candidates (place, id, memory_key, content) in order, each clipped to what is left; place, id, text.

    served: memory_keys to leave out. query: with it, only candidates that support it. Only the first ``scan`` candidates by
    place are folded, in one row; a request for more than that is refused.
    """
    if limit > scan:
        raise LimitError("limit is beyond the scan")
    rows = candidates
    if served is not None:
        rows = rows.join(served.select("memory_key"), "memory_key", "left_anti")
    if query is not None:
        rows = rows.filter(supports(F.lit(query), F.col("content"), F.col("similarity") if "similarity" in rows.columns else F.lit(0.0)))
    most = min(max_chars, max_item_chars or max_chars)
    rows = rows.orderBy("place").limit(scan).select("place", "id", "memory_key", clean(F.col("content")).alias("content"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("place", "id", "memory_key", "content"))).alias("c"))
    kind = one.schema["c"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        text = clipped(x["content"], F.least(F.lit(most), F.lit(max_chars) - acc["used"]))
        item = F.struct(x["place"].alias("place"), x["id"].alias("id"), x["memory_key"].alias("memory_key"), text.alias("content"))
        full = (F.size(acc["out"]) >= limit) | (acc["used"] >= max_chars) | (text == "")
        return F.when(full, acc).otherwise(F.struct((acc["used"] + F.length(text)).alias("used"), F.concat(acc["out"], F.array(item)).alias("out")))

    return one.select(F.explode(F.aggregate("c", start, step)["out"]).alias("x")).select("x.place", "x.id", "x.memory_key", F.col("x.content").alias("text"))


def budgeted(items: DataFrame, per_item: int = 900, total: int = 4000, scan: int = 1000) -> DataFrame:
    """Items (place, id, content), each cut with an ellipsis, until fewer than 100 characters of the total are left."""
    rows = items.orderBy("place").limit(scan)
    one = rows.agg(F.array_sort(F.collect_list(F.struct("place", "id", "content"))).alias("c"))
    kind = one.schema["c"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast(kind).alias("out"))
    cut = lambda text, n: F.when(F.length(text) > n, F.concat(F.substring(text, F.lit(1), n - 1), F.lit("…"))).otherwise(text)

    def step(acc, x):
        left = F.lit(total) - acc["used"]
        text = cut(cut(x["content"], F.lit(per_item)), left)
        stop = acc["over"] | ((F.least(F.length(x["content"]), F.lit(per_item)) > left) & (left < 100))
        item = F.struct(x["place"].alias("place"), x["id"].alias("id"), text.alias("content"))
        grown = F.struct((acc["used"] + F.length(text)).alias("used"), F.lit(False).alias("over"), F.concat(acc["out"], F.array(item)).alias("out"))
        return F.when(stop, F.struct(acc["used"].alias("used"), F.lit(True).alias("over"), acc["out"].alias("out"))).otherwise(grown)

    return one.select(F.explode(F.aggregate("c", start, step)["out"]).alias("x")).select("x.place", "x.id", F.col("x.content").alias("text"))


def anti_hits(matched: DataFrame, events: DataFrame, edges: DataFrame, cancellations: DataFrame, limit: int = 3, scan: int = 80, chars: int = 1200) -> DataFrame:
    """Live successors of matched events (id, rank_score), which a search through history found."""
    top = matched.orderBy(F.col("rank_score").desc(), F.col("created_at").desc(), "id").limit(scan).select(F.col("id").alias("anchor_event_id"), "rank_score")
    live = live_edges(edges, cancellations)
    gone = live.select(F.col("superseded_event_id").alias("id")).distinct()
    evidence = events.join(gone, "id", "left_anti")
    rows = top.join(live.select(F.col("superseded_event_id").alias("anchor_event_id"), F.col("superseding_event_id").alias("id")), "anchor_event_id").join(evidence, "id").dropDuplicates(["anchor_event_id", "id"])
    relation = F.when(F.col("event_type") == "fact_retraction", "retracted_by").otherwise("superseded_by")
    rows = rows.withColumn("relation", relation)
    hit = short_id("anti_", F.col("anchor_event_id").cast("string"), F.col("id").cast("string"), F.col("relation"))
    out = rows.select(hit.alias("hit_id"), "anchor_event_id", F.col("id").alias("evidence_event_id"), "relation", clipped(clean(F.col("content")), F.lit(chars)).alias("text"), "created_at", "rank_score")
    return out.orderBy(F.col("rank_score").desc(), F.col("created_at").desc(), "hit_id").limit(limit)


RELATIONS = (("direct_supersession", 1.0), ("same_objective", 0.85), ("same_source_ref", 0.7), ("same_session", 0.55))


def structural_candidates(anchors: DataFrame, events: DataFrame, edges: DataFrame, cancellations: DataFrame, per_anchor: int = 40) -> DataFrame:
    """(anchor_event_id, id, relation_score): a union of equi-joins, the nearest in time per anchor, and direct successors."""
    control = is_control(metadata="metadata_json" if "metadata_json" in events.columns else None)
    live = live_edges(edges, cancellations)
    gone = live.select(F.col("superseded_event_id").alias("id")).distinct()
    usable = events.filter(~control).join(gone, "id", "left_anti")
    columns = ["id", "memory_key", "created_at"]
    a = anchors.select(F.col("id").alias("anchor_event_id"), F.col("created_at").alias("a_at"), F.col("memory_key").alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in ("objective_id", "source_ref", "source", "session_id") if c in anchors.columns])

    def related(keys: tuple[str, ...], score: float) -> DataFrame:
        test = None
        for k in keys:
            one = F.col(f"a_{k}") == F.col(k)
            test = one if test is None else test & one
        left = a
        for k in keys:
            left = left.filter(F.coalesce(F.col(f"a_{k}"), F.lit("")) != "")
        right = usable.select(*dict.fromkeys([*columns, *keys]))
        return left.join(right, test).select("anchor_event_id", "a_at", "a_key", *columns, F.lit(score).alias("relation_score"))

    pools = [related(keys, score) for keys, score in ((("objective_id",), 0.85), (("source_ref",), 0.7), (("source", "session_id"), 0.55)) if all(f"a_{k}" in a.columns for k in keys)]
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionByName(p)
    pool = pool.filter("id <> anchor_event_id").groupBy("anchor_event_id", "a_at", "a_key", *columns).agg(F.max("relation_score").alias("relation_score"))
    gap = F.abs(F.unix_millis(parsed(F.col("created_at"))) - F.unix_millis(parsed(F.col("a_at"))))
    near = Window.partitionBy("anchor_event_id").orderBy(gap.asc_nulls_last(), F.col("created_at").desc(), "id")
    pool = pool.withColumn("__n", F.row_number().over(near)).filter(F.col("__n") <= per_anchor).drop("__n")
    direct = a.select("anchor_event_id", "a_at", "a_key").join(live.select(F.col("superseded_event_id").alias("anchor_event_id"), F.col("superseding_event_id").alias("id")), "anchor_event_id").join(usable.select(*columns), "id")
    newest = Window.partitionBy("anchor_event_id").orderBy(F.col("created_at").desc(), "id")
    direct = direct.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= per_anchor).drop("__n").withColumn("relation_score", F.lit(1.0))
    return pool.unionByName(direct.select(*pool.columns)).groupBy("anchor_event_id", "a_at", "a_key", *columns).agg(F.max("relation_score").alias("relation_score"))


def relation_name(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in RELATIONS:
        out = F.when(score == value, F.lit(name)).otherwise(out)
    return out


def structural_hits(query: str, anchors: DataFrame, events: DataFrame, edges: DataFrame, cancellations: DataFrame, served: DataFrame | None = None, limit: int = 4, per_anchor: int = 40, chars: int = 1200) -> DataFrame:
    """Events related to the anchors, the best relation of each, without the anchors, their copies and served ones."""
    found = structural_candidates(anchors, events, edges, cancellations, per_anchor).filter("memory_key <> a_key")
    found = found.join(anchors.select("id"), "id", "left_anti")
    if served is not None:
        found = found.join(served.select("memory_key"), "memory_key", "left_anti")
    rows = found.join(events.select("id", "content"), "id").join(anchors.select(F.col("id").alias("anchor_event_id"), F.col("content").alias("a_content")), "anchor_event_id")
    context = F.concat_ws(" ", clean(F.lit(query)), clean(F.col("a_content")))
    score = F.col("relation_score") + token_similarity(structural_tokens(context), structural_tokens(F.col("content"))) * 0.09 + proximity(F.col("a_at"), F.col("created_at")) * 0.03
    rows = rows.withColumn("score", F.round(score, 6))
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "anchor_event_id")
    rows = rows.withColumn("__n", F.row_number().over(best)).filter("__n = 1")
    out = rows.select("id", "anchor_event_id", relation_name(F.col("relation_score")).alias("relation"), "score", clipped(clean(F.col("content")), F.lit(chars)).alias("text"), "created_at")
    return out.orderBy(F.col("score").desc(), F.col("created_at").desc(), "id").limit(limit)


