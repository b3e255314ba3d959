"""Queries over scoped reads and consented writes, on customers as contexts and orders as their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.instants import ISO
from tidemark.operators import access
from tidemark.runtime import table

ME = access.Context("p3", "telegram", "3", "3", "", "k3", "s3")
NOW = "1998-01-01T00:00:00.000Z"


def _events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey") % 50
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.concat_ws(" ", F.lit("order"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("content"), F.date_format("o_orderdate", ISO).alias("created_at"),
        F.concat(F.lit("p"), c.cast("string")).alias("source_profile"), F.lit("telegram").alias("source_platform"), c.cast("string").alias("source_chat_id"), c.cast("string").alias("source_user_id"), F.lit("").alias("source_topic_id"),
        F.concat(F.lit("s"), c.cast("string")).alias("source_session_id"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise("profile_topic").alias("scope_kind"), F.lit(1).alias("authorization_version"),
    )


def _grants(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 101 = 1")
    end = F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1000 DAY"), ISO))
    return o.select(F.col("o_orderkey").cast("string").alias("event_id"), *[F.lit(v).alias(f"grantee_{n}") for n, v in zip(access.FIVE, ME.five(), strict=True)], F.lit("profile_topic").alias("grant_kind"), end.alias("expires_at"), F.lit(1).alias("authorization_version"))


def authorized_search_scope(spark, sf_dir):
    return access.authorized(_events(spark, sf_dir), _grants(spark, sf_dir), ME, NOW).select("id", "grant_kind")


def authorized_top(spark, sf_dir):
    events = _events(spark, sf_dir)
    return access.authorized_search(events, _grants(spark, sf_dir), ME, "urgent high", NOW, events, limit=8, per_item=100).select("place", "id", "grant_kind", "text")


def _proposals(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    u = (F.col("c_custkey") % 50).cast("string")
    requests = c.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("nonce"), F.lit("note").alias("event_type"), F.col("c_name").alias("content"), F.array(F.col("c_mktsegment")).alias("tags"), F.concat(F.lit("p"), u).alias("source_profile"), F.lit("telegram").alias("source_platform"), u.alias("source_chat_id"), u.alias("source_user_id"), F.lit("").alias("source_topic_id"), F.concat(F.lit("k"), u).alias("session_key"), F.concat(F.lit("s"), u).alias("source_session_id"), F.col("c_custkey").alias("seq"))
    good, _ = access.propose(requests, NOW)
    return good.withColumn("consumed_at", F.when(F.col("seq") % 11 == 0, F.lit(NOW)))


def proposals_confirm(spark, sf_dir):
    """Each proposal is confirmed twice; every fifth too late, every seventh by another user, every third with another hash."""
    p = _proposals(spark, sf_dir)
    user = F.when(F.col("seq") % 7 == 0, F.lit("999")).otherwise(F.col("source_user_id"))
    at = F.when(F.col("seq") % 5 == 0, F.lit("1998-01-01T00:05:00.000Z")).otherwise(F.lit("1998-01-01T00:04:59.999Z"))
    digest = F.when(F.col("seq") % 3 == 0, F.sha2("nonce", 256)).otherwise(F.col("payload_hash"))
    one = p.select("nonce", digest.alias("payload_hash"), F.col("source_profile").alias("profile"), F.col("source_platform").alias("platform"), F.col("source_chat_id").alias("chat_id"), user.alias("user_id"), F.col("source_topic_id").alias("topic_id"), F.concat(F.lit("k"), F.col("source_user_id")).alias("session_key"), F.col("source_session_id").alias("session_id"), at.alias("at"), F.lit(1).alias("arrival"))
    events, audits, consumed = access.confirm(p, one.unionByName(one.withColumn("arrival", F.lit(2))))
    return events.select("id", "content", "source_profile").join(audits.select(F.col("event_id").alias("id"), "nonce", "action"), "id").join(consumed.select("nonce", "consumed_at"), "nonce")


def grants_made(spark, sf_dir):
    events = _events(spark, sf_dir)
    requests = _grants(spark, sf_dir).drop("authorization_version").withColumn("expires_at", F.when(F.col("expires_at") == "", "").otherwise(F.col("expires_at")))
    good, refused = access.grant(events, requests, NOW)
    return good.select("event_id", F.lit("").alias("reason")).unionByName(refused.select("event_id", "reason"))


QUERIES = {f.__name__: f for f in (authorized_search_scope, authorized_top, proposals_confirm, grants_made)}

OWN = "o_custkey % 50 = 3"
END = "strftime(o_orderdate + INTERVAL 1000 DAY, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
GRANTED = f"o_orderkey % 101 = 1 AND (o_orderkey % 2 = 0 OR {END} > '{NOW}')"
READABLE = f"r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN {OWN} THEN 'owner' ELSE 'explicit' END AS grant_kind, 'order ' || o_orderpriority || ' ' || o_orderstatus AS content, o_orderdate FROM orders WHERE o_orderkey % 9 <> 0 AND ({OWN} OR ({GRANTED})))"
ORACLES = {
    "authorized_search_scope": f"WITH {READABLE} SELECT id, grant_kind FROM r",
    "authorized_top": f"""WITH {READABLE}, t AS (SELECT *, regexp_extract_all(lower('order ' || o_orderpriority || ' ' || o_orderstatus), '[\\p{{L}}\\p{{N}}]+') AS t FROM orders),
      c AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate, len(t) AS n, CAST(len(list_filter(t, lambda x: x = 'urgent')) AS DOUBLE) AS f0, CAST(len(list_filter(t, lambda x: x = 'high')) AS DOUBLE) AS f1 FROM t),
      s AS (SELECT CAST(count(*) AS DOUBLE) AS nn, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
      k AS (SELECT id, o_orderdate, -(greatest(ln((nn - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(ln((nn - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean))) AS rank FROM c, s WHERE f0 + f1 > 0)
      SELECT row_number() OVER (ORDER BY rank, k.o_orderdate DESC, id) - 1 AS place, id, grant_kind, content AS text FROM k JOIN r USING (id) ORDER BY rank, k.o_orderdate DESC, id LIMIT 8""",
    "proposals_confirm": """SELECT 'n' || c_custkey AS nonce, 'confirmed_' || substr(sha256('n' || c_custkey), 1, 48) AS id, c_name AS content, 'p' || (c_custkey % 50) AS source_profile, 'confirm' AS action, '1998-01-01T00:04:59.999Z' AS consumed_at
      FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0""",
    "grants_made": f"SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CASE WHEN o_orderkey % 9 = 0 THEN 'not a scoped event' WHEN o_orderkey % 2 <> 0 AND {END} <= '{NOW}' THEN 'expired' ELSE '' END AS reason FROM orders WHERE o_orderkey % 101 = 1",
}
