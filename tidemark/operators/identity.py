"""Deterministic ids of events and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "1"
SCOPE = ("source_profile", "source_platform", "source_chat_id", "source_user_id", "source_topic_id", "source_session_id", "scope_kind")
EXTERNAL_ID = r"^[A-Za-z0-9._:@/-]{1,200}$"


def event_id(scoped: bool = False, explicit: str | None = None) -> Column:
    """mem_ and the SHA-256 of the parts; scope parts only where one is set. An explicit id that is valid goes first."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [F.lit(VERSION), *map(part, ("event_type", "source", "session_id", "message_id", "role", "content_sha256"))]
    plain = F.concat_ws("\x1f", *parts)
    if scoped:
        scope = [*map(part, SCOPE), F.coalesce(F.col("authorization_version").cast("string"), F.lit("0"))]
        unset = F.concat(*scope) == "0"
        plain = F.when(unset, plain).otherwise(F.concat_ws("\x1f", *parts, *scope))
    out = F.concat(F.lit("mem_"), F.sha2(plain, 256))
    if explicit:
        out = F.when(F.col(explicit).rlike(EXTERNAL_ID), F.col(explicit)).otherwise(out)
    return out


def content_key() -> Column:
    return F.concat(F.lit("content:"), F.col("content_sha256"))


def fact_id(legacy: Column | None = None) -> Column:
    parts = [F.lit(VERSION), F.lit("") if legacy is None else F.coalesce(legacy.cast("string"), F.lit(""))]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("entity_id", "kind", "value", "source_ref", "said_at", "valid_from")]
    return F.concat(F.lit("fact_"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32))


def short_id(prefix: str, *parts: Column, length: int = 64, separator: str = "\x1f") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, length))


LINEAGE_KEY = r"^[a-z0-9][a-z0-9._:-]{0,95}$"


def lineage_key(text: Column) -> Column:
    """Trimmed, lower-cased; null where it isn't a valid key. Compatibility forms are normalised by nfkc_udf before."""
    key = F.lower(F.trim(text))
    return F.when(key.rlike(LINEAGE_KEY), key)
