"""Scoped reads and consented writes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.instants import ISO, parsed
from tidemark.operators.identity import short_id
from tidemark.operators.pack import LimitError, budgeted
from tidemark.operators.search import bm25

AUTHORIZATION = 1
KIND = "profile_topic"
LIFETIME_SECONDS = 300
FIVE = ("profile", "platform", "chat_id", "user_id", "topic_id")


class RouteDenied(PermissionError):
    pass


@dataclass(frozen=True)
class Context:
    profile: str
    platform: str
    chat_id: str
    user_id: str
    topic_id: str = ""
    session_key: str = ""
    session_id: str = ""

    @staticmethod
    def checked(profile: str, platform: str, chat_id: object, chat_type: str, user_id: object, topic_id: object = "", session_key: str = "", session_id: str = "") -> Context:
        """A direct chat of one user; topics 0 and 1 are none."""
        chat, user, topic = str(chat_id).strip(), str(user_id).strip(), str(topic_id or "").strip()
        right = platform.strip().lower() == "telegram" and chat_type in ("private", "dm") and re.fullmatch(r"[1-9]\d*", chat) and chat == user and re.fullmatch(r"[A-Za-z0-9._:-]{1,100}", profile.strip()) and len(session_key) <= 1000 and len(session_id) <= 500
        if not right:
            raise RouteDenied("route_denied")
        return Context(profile.strip(), "telegram", chat, user, "" if topic in ("", "0", "1") else topic, session_key, session_id)

    def five(self) -> tuple[str, ...]:
        return self.profile, self.platform, self.chat_id, self.user_id, self.topic_id


def _same(prefix: str, context: Context) -> Column:
    out = F.lit(True)
    for name, value in zip(FIVE, context.five(), strict=True):
        out = out & (F.col(f"{prefix}{name}") == value)
    return out


def authorized(events: DataFrame, grants: DataFrame, context: Context, now: str) -> DataFrame:
    """Scoped events that the context owns or was granted, with grant_kind owner or explicit."""
    filled = F.lit(True)
    for c in ("profile", "platform", "chat_id", "user_id", "session_id"):
        filled = filled & (F.coalesce(F.col(f"source_{c}"), F.lit("")) != "")
    scoped = events.filter((F.col("authorization_version") == AUTHORIZATION) & (F.col("scope_kind") == KIND) & filled)
    valid = (F.col("authorization_version") == AUTHORIZATION) & (F.col("grant_kind") == KIND) & ((F.col("expires_at") == "") | (F.col("expires_at") > now))
    granted = grants.filter(valid & _same("grantee_", context)).select(F.col("event_id").alias("id")).distinct().withColumn("__g", F.lit(True))
    owner = _same("source_", context)
    rows = scoped.join(granted, "id", "left").filter(owner | F.col("__g"))
    return rows.withColumn("grant_kind", F.when(owner, "owner").otherwise("explicit")).drop("__g")


def authorized_search(events: DataFrame, grants: DataFrame, context: Context, query: str, now: str, keep: DataFrame, columns: tuple[str, ...] = ("content",), limit: int = 5, per_item: int = 900, total: int = 4000) -> DataFrame:
    """The best of what the context may read, within the limits; keep: ids of current events."""
    for value, low, high, name in ((limit, 1, 8, "limit"), (per_item, 100, 1200, "per_item"), (total, 1, 6000, "total")):
        if not low <= value <= high:
            raise LimitError(name)
    found = authorized(bm25(events, columns, query), grants, context, now).join(keep.select("id"), "id", "left_semi")
    top = found.orderBy("rank", F.col("created_at").desc(), "id").limit(limit)
    top = top.withColumn("place", F.row_number().over(Window.orderBy("rank", F.col("created_at").desc(), "id")) - 1)
    return budgeted(top.select("place", "id", "content"), per_item, total).join(top.select("id", "grant_kind"), "id").select("place", "id", "grant_kind", "text")


def propose(requests: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Proposals (nonce, payload_json, payload_hash, scope, session_key_hash, created_at, expires_at) and refused requests.

    A request has event_type, content and tags: 1 to 4000 characters, at most 8 tags of at most 64. It lives 300 seconds.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    reason = F.when(~F.length(F.trim(F.coalesce("content", F.lit("")))).between(1, 4000), "content").when(F.size(tags) > 8, "tags").when(F.exists(tags, lambda t: F.length(t) > 64), "tags")
    rows = requests.withColumn("reason", reason)
    good = rows.filter("reason IS NULL").drop("reason")
    payload = F.to_json(F.struct(F.trim("content").alias("content"), F.col("event_type").alias("eventType"), tags.alias("tags")))
    at = parsed(F.lit(now))
    good = good.withColumn("payload_json", payload).withColumn("payload_hash", F.sha2("payload_json", 256)).withColumn("session_key_hash", F.sha2("session_key", 256)).drop("session_key")
    good = good.withColumn("created_at", F.date_format(at, ISO)).withColumn("expires_at", F.date_format(at + F.make_dt_interval(secs=F.lit(LIFETIME_SECONDS)), ISO))
    return good, rows.filter("reason IS NOT NULL")


def confirm(proposals: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, audits, consumed): the first valid confirmation of each unconsumed proposal. All from the same rows.

    A confirmation has nonce, payload_hash, the five scope columns, session_key, session_id, at and arrival.
    """
    p = proposals.filter("consumed_at IS NULL OR consumed_at = ''")
    c = confirmations.select("nonce", F.col("payload_hash").alias("c_hash"), *[F.col(x).alias(f"c_{x}") for x in FIVE], F.sha2("session_key", 256).alias("c_key"), F.col("session_id").alias("c_session"), "at", "arrival")
    same = F.col("c_hash") == F.col("payload_hash")
    for x in FIVE:
        same = same & (F.col(f"c_{x}") == F.col(f"source_{x}"))
    same = same & (F.col("c_key") == F.col("session_key_hash")) & (F.col("c_session") == F.col("source_session_id"))
    valid = same & F.col("c_hash").rlike("^[a-f0-9]{64}$") & (F.col("expires_at") > F.col("at")) & (F.sha2("payload_json", 256) == F.col("payload_hash"))
    rows = p.join(c, "nonce").filter(valid).withColumn("__n", F.row_number().over(Window.partitionBy("nonce").orderBy("arrival"))).filter("__n = 1").drop("__n")
    rows = rows.withColumn("event_id", short_id("confirmed_", F.col("nonce"), length=48))
    payload = F.from_json("payload_json", "content string, eventType string, tags array<string>")
    scope = [f"source_{x}" for x in FIVE]
    events = rows.select(F.col("event_id").alias("id"), payload["eventType"].alias("event_type"), payload["content"].alias("content"), F.to_json(F.struct(F.lit("exact_direct_command").alias("consent"), payload["tags"].alias("tags"))).alias("metadata_json"), *scope, "source_session_id", F.lit(KIND).alias("scope_kind"), F.lit(AUTHORIZATION).alias("authorization_version"), F.lit("confirmed").alias("status"), F.col("at").alias("created_at"))
    audits = rows.select(short_id("audit_", F.col("nonce"), F.col("event_id"), length=48, separator="\0").alias("audit_id"), "nonce", "payload_hash", "event_id", *scope, F.lit("confirm").alias("action"), F.col("at").alias("created_at"))
    consumed = rows.select("nonce", F.col("at").alias("consumed_at"), "event_id")
    return events, audits, consumed


def inconsistent(proposals: DataFrame, audits: DataFrame, events: DataFrame) -> DataFrame:
    """Audits that don't agree with their proposal and event; nothing may be committed while there are any."""
    a = audits.join(proposals.select("nonce", F.col("payload_hash").alias("p_hash"), *[F.col(f"source_{x}").alias(f"p_{x}") for x in FIVE]), "nonce", "left").join(events.select(F.col("id").alias("event_id"), *[F.col(f"source_{x}").alias(f"e_{x}") for x in FIVE]), "event_id", "left")
    agrees = F.col("payload_hash").eqNullSafe(F.col("p_hash"))
    for x in FIVE:
        agrees = agrees & F.col(f"source_{x}").eqNullSafe(F.col(f"p_{x}")) & F.col(f"source_{x}").eqNullSafe(F.col(f"e_{x}"))
    return a.filter(~agrees).select("audit_id", "nonce", "event_id")


def grant(events: DataFrame, requests: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Grants on scoped events with an end to come (or none), and refused requests."""
    e = events.filter((F.col("scope_kind") == KIND) & (F.col("authorization_version") == AUTHORIZATION)).select(F.col("id").alias("event_id")).distinct().withColumn("__e", F.lit(True))
    rows = requests.join(e, "event_id", "left")
    late = (F.col("expires_at") != "") & ~F.coalesce(parsed(F.col("expires_at")) > parsed(F.lit(now)), F.lit(False))
    rows = rows.withColumn("reason", F.when(F.col("__e").isNull(), "not a scoped event").when(late, "expired").when(F.col("grant_kind") != KIND, "unknown kind")).drop("__e")
    good = rows.filter("reason IS NULL").drop("reason")
    parts = [F.col(f"grantee_{x}") for x in FIVE]
    return good.withColumn("grant_id", short_id("grant_", F.col("event_id"), *parts)).withColumn("created_at", F.lit(now)).withColumn("authorization_version", F.lit(AUTHORIZATION)), rows.filter("reason IS NOT NULL")
