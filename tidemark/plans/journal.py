"""Queries over the event journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.instants import proximity
from tidemark.functions.text import STOP_WORDS, redact, structural_tokens, token_similarity
from tidemark.operators import capture, lifecycle, objectives
from tidemark.operators.stats import store_stats as stats_of
from tidemark.plans.facts import ISO
from tidemark.runtime import fresh_path, spread, table, written
from tidemark.sources import adapters
from tidemark.sources.store import export_before as exported

NOW = "2026-01-01T00:00:00.000Z"
BEFORE = "2026-01-01T05:00:00.000Z"
AT = "strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST({0} AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
JOURNAL = f"""journal AS (SELECT conv_id * 100 + turn AS seq, CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS message_id, role, text AS content, sha256(text) AS content_sha256, {AT.format('conv_id * 100 + turn')} AS created_at,
  'mem_' || sha256(concat_ws(chr(31), '1', 'message', 'chat', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, sha256(text))) AS id FROM conversations)"""
EDGES = f"""edges AS (SELECT * FROM (SELECT lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_event_id, event_id AS superseding_event_id, {ISO.format('ts')} AS recorded_at FROM events) WHERE superseded_event_id IS NOT NULL),
cancels AS (SELECT superseded_event_id, superseding_event_id FROM edges WHERE superseding_event_id % 11 = 0), live AS (SELECT * FROM edges WHERE superseding_event_id % 11 <> 0)"""
CONTROL = "event_id % 11 = 0 OR event_id % 13 = 0"


def event_identity(spark, sf_dir):
    return adapters.journal(spark, sf_dir).select("seq", "id", "memory_key")


def _parts(spark, sf_dir):
    rows = adapters.journal(spark, sf_dir).drop("memory_key")
    return rows.filter("seq % 3 = 0"), rows


def capture_dedupe(spark, sf_dir):
    """A batch of which a third is stored and each row comes twice."""
    store, batch = _parts(spark, sf_dir)
    new, repeated, collisions = capture.insert_or_verify(store, batch.unionByName(batch.withColumn("seq", F.col("seq") + 1_000_000_000)))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
    return count(new, "new").unionByName(count(repeated, "repeated")).unionByName(count(collisions, "collision"))


def capture_collisions(spark, sf_dir):
    """The same ids with another text or source are refused, by the names of the columns."""
    store, batch = _parts(spark, sf_dir)
    other = batch.filter("seq % 3 = 0").withColumn("role", F.when(F.col("seq") % 2 == 0, F.lit("other")).otherwise(F.col("role"))).withColumn("content", F.when(F.col("seq") % 5 == 0, F.lit("other")).otherwise(F.col("content")))
    _, _, collisions = capture.insert_or_verify(store, other)
    return collisions.select("id", F.array_join("fields", ",").alias("fields"))


def capture_normalised(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select(F.lit(" Chat ").alias("source"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("message_id"), F.upper("role").alias("role"), F.when(F.col("turn") % 3 == 2, F.lit("  ")).otherwise(F.concat(F.lit("  a "), "role")).alias("content"))
    good, bad = capture.normalised(raw, NOW)
    g = good.groupBy("source", "event_type", "role", "status", "producer").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("content"))
    b = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", "event_type", "role", "status", "producer", "n", "content").unionByName(b.select(*[F.lit("").alias(c) for c in ("source", "event_type", "role", "status", "producer")], "n", F.col("reason").alias("content")))


def turn_capture_counts(spark, sf_dir):
    """Conversations as turns of messages without ids; how many would be new beside a third that is stored."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("turn_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    turns = turns.select("turn_id", F.transform("m", lambda x: F.struct(F.lit(None).cast("string").alias("message_id"), x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    messages = capture.turn_messages(turns).select(F.col("message_id").alias("id"))
    return capture.counts(messages.filter(F.pmod(F.substring_index("id", ":", 1).cast("long"), F.lit(3)) == 0), messages)


def _with_metadata(spark, sf_dir):
    e, c = adapters.edges(spark, sf_dir), adapters.cancellations(spark, sf_dir)
    meta = F.to_json(F.struct(F.when(F.col("superseding_event_id") % 2 == 0, F.array(F.array(F.col("superseded_event_id").cast("string")))).alias("supersedes"), F.when(F.col("superseding_event_id") % 2 == 1, F.struct(F.col("superseded_event_id").alias("supersedes"))).alias("extensions")))
    cancel = F.to_json(F.struct(F.array(F.struct(F.col("superseded_event_id").cast("string").alias("supersededEventId"), F.col("superseding_event_id").cast("string").alias("supersedingEventId"))).alias("cancels_supersessions")))
    rows = e.select(F.col("superseding_event_id").cast("string").alias("id"), F.col("recorded_at").alias("created_at"), meta.alias("metadata_json"))
    return rows, c.select(F.concat(F.lit("c"), F.col("cancellation_event_id").cast("string")).alias("id"), F.col("recorded_at").alias("created_at"), cancel.alias("metadata_json"))


def supersession_edges(spark, sf_dir):
    rows, _ = _with_metadata(spark, sf_dir)
    return capture.edges_of(rows.unionByName(rows))


def cancellation_edges(spark, sf_dir):
    _, rows = _with_metadata(spark, sf_dir)
    return capture.cancellations_of(rows.unionByName(rows))


def current_events(spark, sf_dir):
    return lifecycle.current_events(adapters.event_rows(spark, sf_dir), adapters.edges(spark, sf_dir), adapters.cancellations(spark, sf_dir)).select("id", "event_type", "session_id")


def superseded_flags(spark, sf_dir):
    return lifecycle.with_superseded(adapters.event_rows(spark, sf_dir), adapters.edges(spark, sf_dir), adapters.cancellations(spark, sf_dir)).select("id", "superseded")


def lifecycle_filter(spark, sf_dir):
    """By type, and by flags of several JSON types of which true and 1 count."""
    flag = F.element_at(F.array(*map(F.lit, ("true", "1", '"1"', '"true"', "0", "false", "null"))), (F.col("id") % 7 + 1).cast("int"))
    rows = adapters.event_rows(spark, sf_dir).withColumn("metadata_json", F.concat(F.lit('{"lifecycle_control":'), flag, F.lit("}")))
    return rows.filter(lifecycle.is_control()).select("id")


def pending_events(spark, sf_dir):
    return lifecycle.listed(lifecycle.pending(adapters.event_rows(spark, sf_dir), adapters.projections(spark, sf_dir)), 1000).select("id", "created_at")


def projections_marked(spark, sf_dir):
    events = adapters.event_rows(spark, sf_dir)
    first = capture.mark_projected(spark.createDataFrame([], "projection_id string"), events.filter("id % 2 = 0"), "index", NOW)
    return capture.mark_projected(first, events, "index", NOW).select("projection_id", "event_id")


def unscoped_events(spark, sf_dir):
    rows = adapters.event_rows(spark, sf_dir)
    meta = F.when(F.col("id") % 4 == 0, F.lit('{"a":[{"scope_kind":"profile"}]}')).when(F.col("id") % 4 == 1, F.lit('{"sourceUserId":"0","b":1}')).when(F.col("id") % 4 == 2, F.lit('{"x":{"source":"Gateway"}}')).otherwise(F.lit("{}"))
    rows = rows.withColumn("metadata_json", meta).withColumn("authorization_version", F.when(F.col("id") % 10 == 3, 1).otherwise(0))
    return lifecycle.unscoped(rows, guarded=("gateway",), json_columns=("metadata_json",)).select("id")


def embeddable_events(spark, sf_dir):
    from tidemark.operators.search import embeddable

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return embeddable(docs, adapters.vectors(spark, sf_dir))


def ledger_listing(spark, sf_dir):
    return lifecycle.ledger(adapters.event_rows(spark, sf_dir), types=("fact_conflict", "fact_retraction"), newest_first=True, limit=100).select("id", "event_type", "created_at")


def export_before(spark, sf_dir):
    return exported(adapters.journal(spark, sf_dir), BEFORE).select("id", "created_at", "role")


def store_stats(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return stats_of(adapters.event_rows(spark, sf_dir), adapters.edges(spark, sf_dir), adapters.cancellations(spark, sf_dir), adapters.projections(spark, sf_dir), documents, adapters.vectors(spark, sf_dir))


def redact_text(spark, sf_dir):
    """Documents, and texts made of their numbers that hold a secret of each kind."""
    n = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    secret = F.element_at(F.array(F.concat(F.lit("a sk-"), n, n, n, F.lit(" b")), F.concat(F.lit("Bearer "), n, n, n), F.concat(n, F.lit(":"), n, n, n, n), F.concat(F.lit('{"token": "'), n, F.lit('"}')), F.concat(F.lit("MY_API_KEY="), n), F.concat(F.lit("plain "), n)), (F.col("doc_id") % 6 + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", redact(secret).alias("made"), F.sha2(redact(F.col("text")), 256).alias("text_sha256"))


def objective_registry(spark, sf_dir):
    """orders as objectives, lines as runs of executors (suppliers), under ids that overlap but for both ends."""
    orders = table(spark, sf_dir, "orders")
    made = objectives.objective_events(orders.select(F.concat(F.lit("o"), (F.col("o_orderkey") % 1009).cast("string")).alias("objective_id"), F.lit("sales").alias("source"), F.col("o_custkey").cast("string").alias("session_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.lower("o_orderstatus").alias("status"), F.lit("").alias("detail"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderkey").alias("seq")))
    lines = table(spark, sf_dir, "lineitem")
    runs = objectives.run_events(lines.select(F.concat(F.lit("o"), (F.col("l_orderkey") % 997 + 100).cast("string")).alias("objective_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("executor"), F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string")).alias("run_id"), F.lit("plant").alias("source"), F.col("l_orderkey").cast("string").alias("session_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))
    return objectives.registry(made.unionByName(runs, allowMissingColumns=True))


def text_similarity(spark, sf_dir):
    """Each document and the next one. Tokens are made once and written, as both sides of the join read them."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    d = written(d.select("doc_id", structural_tokens(F.col("text")).alias("t")), "tokens")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return d.join(n, "doc_id").select("doc_id", F.round(token_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


def temporal_proximity(spark, sf_dir):
    e = adapters.event_rows(spark, sf_dir).select("id", "created_at")
    n = e.select((F.col("id") - 1).alias("id"), F.col("created_at").alias("next_at"))
    return e.join(n, "id").select("id", F.round(proximity(F.col("created_at"), F.col("next_at")), 6).alias("proximity"))


def stream_capture(spark, sf_dir):
    """The journal as a stream in which each file comes twice."""
    from tidemark.streaming.journal_stream import capture_stream, files_each

    batch = adapters.journal(spark, sf_dir)
    each = files_each(table(spark, sf_dir, "conversations").count(), 3)
    source, root = fresh_path(spark, "journal-files"), fresh_path(spark, "journal-stream")
    batch.repartition(3 * each).write.parquet(source)
    batch.repartition(3 * each).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", each).parquet(source)
    capture_stream(stream, root, f"{root}-checkpoint").awaitTermination()
    return spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(root).select("seq", "id")


QUERIES = {f.__name__: f for f in (event_identity, capture_dedupe, capture_collisions, capture_normalised, turn_capture_counts, supersession_edges, cancellation_edges, current_events, superseded_flags, lifecycle_filter, pending_events, projections_marked, unscoped_events, embeddable_events, ledger_listing, export_before, store_stats, redact_text, objective_registry, text_similarity, temporal_proximity, stream_capture)}

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLES = {
    "event_identity": f"WITH {JOURNAL} SELECT seq, id, 'content:' || content_sha256 AS memory_key FROM journal",
    "stream_capture": f"WITH {JOURNAL} SELECT seq, id FROM journal",
    "capture_dedupe": f"WITH {JOURNAL} SELECT 'new' AS outcome, count(*) AS n FROM journal WHERE seq % 3 <> 0 UNION ALL SELECT 'repeated', count(*) + count(*) FILTER (seq % 3 = 0) FROM journal UNION ALL SELECT 'collision', 0",
    "capture_collisions": f"WITH {JOURNAL} SELECT id, CASE WHEN seq % 2 = 0 AND role <> 'other' AND seq % 5 = 0 THEN 'role,content' WHEN seq % 2 = 0 THEN 'role' ELSE 'content' END AS fields FROM journal WHERE seq % 3 = 0 AND (seq % 2 = 0 OR seq % 5 = 0)",
    "capture_normalised": """SELECT 'Chat' AS source, 'message' AS event_type, lower(role) AS role, 'captured' AS status, 'Chat' AS producer, count(*) AS n, 'a ' || min(role) AS content FROM conversations WHERE turn % 3 <> 2 GROUP BY lower(role)
        UNION ALL SELECT '', '', '', '', '', n, 'content required' FROM (SELECT count(*) AS n FROM conversations WHERE turn % 3 = 2) WHERE n > 0""",
    "turn_capture_counts": "SELECT count(*) AS requested, count(*) FILTER (conv_id % 3 <> 0) AS inserted, count(*) FILTER (conv_id % 3 = 0) AS existing FROM conversations",
    "supersession_edges": f"WITH {EDGES} SELECT CAST(superseded_event_id AS VARCHAR) AS superseded_event_id, CAST(superseding_event_id AS VARCHAR) AS superseding_event_id, recorded_at FROM edges",
    "cancellation_edges": f"WITH {EDGES} SELECT CAST(superseded_event_id AS VARCHAR) AS superseded_event_id, CAST(superseding_event_id AS VARCHAR) AS superseding_event_id, 'c' || superseding_event_id AS cancellation_event_id, recorded_at FROM edges WHERE superseding_event_id % 11 = 0",
    "current_events": f"WITH {EDGES} SELECT event_id AS id, 'fact' AS event_type, 'user:' || user_id AS session_id FROM events WHERE NOT ({CONTROL}) AND event_id NOT IN (SELECT superseded_event_id FROM live)",
    "superseded_flags": f"WITH {EDGES} SELECT event_id AS id, event_id IN (SELECT superseded_event_id FROM live) AS superseded FROM events",
    "lifecycle_filter": f"SELECT event_id AS id FROM events WHERE {CONTROL} OR event_id % 7 IN (0, 1)",
    "pending_events": f"SELECT event_id AS id, {ISO.format('ts')} AS created_at FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY 2, 1 LIMIT 1000",
    "projections_marked": "SELECT 'proj_' || sha256(concat_ws(chr(31), '1', CAST(event_id AS VARCHAR), 'index', 'success')) AS projection_id, CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_id % 2 <> 0",
    "unscoped_events": "SELECT event_id AS id FROM events WHERE event_id % 4 IN (1, 3) AND event_id % 10 <> 3",
    "embeddable_events": "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "ledger_listing": f"SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'fact_conflict' ELSE 'fact_retraction' END AS event_type, {ISO.format('ts')} AS created_at FROM events WHERE {CONTROL} ORDER BY 3 DESC, 1 DESC LIMIT 100",
    "export_before": f"WITH {JOURNAL} SELECT id, created_at, role FROM journal WHERE created_at < '{BEFORE}'",
    "store_stats": f"""WITH {EDGES} SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_id IN (SELECT superseded_event_id FROM live)) AS superseded,
        (SELECT count(*) FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS pending, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, 0 AS traces, 5 AS schema_version""",
    "redact_text": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a [REDACTED:api-key] b' WHEN 1 THEN '[REDACTED:bearer-token]' WHEN 2 THEN '[REDACTED:bot-token]' WHEN 3 THEN '{"token": "[REDACTED:secret-field]"}' WHEN 4 THEN 'MY_API_KEY=[REDACTED:secret-assignment]'
        ELSE 'plain ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') END AS made, sha256(text) AS text_sha256 FROM documents""",
    "objective_registry": """WITH o AS (SELECT 'o' || (o_orderkey % 1009) AS objective_id, 'order ' || o_orderkey AS title, lower(o_orderstatus) AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS seq FROM orders),
        r AS (SELECT 'o' || (l_orderkey % 997 + 100) AS objective_id, 's' || (l_suppkey % 7) || ':' || 'r' || (l_partkey % 5) AS run FROM lineitem),
        lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY objective_id ORDER BY day DESC, seq DESC) AS n FROM o) WHERE n = 1),
        lr AS (SELECT objective_id, string_agg(DISTINCT run, ',' ORDER BY run) AS runs FROM r GROUP BY objective_id)
        SELECT coalesce(lo.objective_id, lr.objective_id) AS objective_id, coalesce(title, '') AS title, coalesce(status, 'unknown') AS status, CASE WHEN title IS NULL THEN 'plant' ELSE 'sales' END AS source, coalesce(runs, '') AS runs FROM lo FULL JOIN lr ON lo.objective_id = lr.objective_id""",
    "text_similarity": f"""WITH t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}')), lambda x: x NOT IN ({STOP})) AS t FROM documents)
        SELECT a.doc_id, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE round(len(list_intersect(a.t, b.t)) / sqrt(len(a.t) * len(b.t)), 6) END AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""",
    "temporal_proximity": "SELECT a.event_id AS id, round(1 / (1 + abs(epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000) / 3600000.0), 6) AS proximity FROM events a JOIN events b ON b.event_id = a.event_id + 1",
}
