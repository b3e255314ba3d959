"""Queries over temporal facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lineage, outbox
from tidemark.operators.identity import fact_id
from tidemark.runtime import fresh_path, table
from tidemark.sources import adapters

AS_OF = "2024-01-15T00:00:00.000Z"
#: Micro-batches of stream_lineage.
BATCHES = 4

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
FACTS = f"""facts AS (SELECT event_id AS seq, 'user:' || user_id AS entity_id, event_type AS kind, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value,
  'event:' || event_id AS source_ref, {ISO.format('ts')} AS valid_from, event_type AS lineage_key,
  CASE WHEN event_id % 11 = 0 THEN 'conflict' WHEN event_id % 13 = 0 THEN 'retracted' ELSE 'current' END AS base,
  CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN {ISO.format("(ts + INTERVAL 1 DAY)")} END AS ended FROM events),
ids AS (SELECT *, 'fact_' || substr(sha256('1' || chr(0) || '' || chr(0) || entity_id || chr(0) || kind || chr(0) || value || chr(0) || source_ref || chr(0) || valid_from || chr(0) || valid_from), 1, 32) AS fact_id FROM facts),
nexts AS (SELECT *, lead(CASE WHEN base <> 'conflict' THEN fact_id END IGNORE NULLS) OVER w AS n_id, lead(CASE WHEN base <> 'conflict' THEN valid_from END IGNORE NULLS) OVER w AS n_from
  FROM ids WINDOW w AS (PARTITION BY entity_id, lineage_key ORDER BY valid_from, seq)),
done AS (SELECT *, CASE WHEN base <> 'current' THEN base WHEN n_id IS NOT NULL THEN 'superseded' ELSE 'current' END AS status,
  CASE WHEN base <> 'current' THEN ended ELSE n_from END AS valid_to, CASE WHEN base = 'current' THEN n_id END AS superseded_by FROM nexts)"""


def _reconciled(spark, sf_dir):
    return lineage.reconcile(adapters.facts(spark, sf_dir))


COLUMNS = ["seq", "fact_id", "entity_id", "lineage_key", "value", "status", "valid_from", "valid_to", "superseded_by"]
LIST = ", ".join(COLUMNS)


def lineage_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).select(*COLUMNS)


def lineage_current(spark, sf_dir):
    return lineage.at_time(_reconciled(spark, sf_dir)).select(*COLUMNS)


def lineage_as_of(spark, sf_dir):
    return lineage.at_time(_reconciled(spark, sf_dir), "as_of", AS_OF).select(*COLUMNS)


def lineage_history(spark, sf_dir):
    return lineage.at_time(_reconciled(spark, sf_dir), "historical").select("fact_id", "valid_from", "status")


def lineage_lane_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    return lineage.lane_counts(_reconciled(spark, sf_dir), F.col("seq") % 2 == 0)


def fact_materialized(spark, sf_dir):
    return lineage.materialized(_reconciled(spark, sf_dir)).select("entity_id", "kind", "value", "fact_id", "status")


def fact_read_merge(spark, sf_dir):
    rows = _reconciled(spark, sf_dir)
    return lineage.read_merge(rows.filter("seq % 3 <> 0"), lineage.materialized(rows)).select("fact_id", "valid_from", "status")


def lineage_keys(spark, sf_dir):
    return lineage.lineages(adapters.facts(spark, sf_dir))


def conflict_restoration_pairs(spark, sf_dir):
    return lineage.restoration_pairs(adapters.facts(spark, sf_dir))


def occurrence_snapshot(spark, sf_dir):
    from pyspark.sql import functions as F

    return lineage.snapshots(adapters.facts(spark, sf_dir)).select("seq", "status", "valid_to", F.array_join("superseded_ids", ",").alias("superseded_ids"))


def fact_identity(spark, sf_dir):
    return adapters.facts(spark, sf_dir).withColumn("again", fact_id()).select("seq", "fact_id", (F.col("again") == F.col("fact_id")).alias("stable"))


def projection_mismatch(spark, sf_dir):
    rows = _reconciled(spark, sf_dir)
    other = rows.withColumn("value", F.when(F.col("seq") % 7 == 0, F.concat("value", F.lit("0"))).otherwise(F.col("value")))
    return lineage.mismatched(rows, other, ("value", "status"))


def fact_terminals(spark, sf_dir):
    """Retractions and conflicts that arrive after the facts: the first of each fact wins."""
    facts = adapters.facts(spark, sf_dir).withColumn("status", F.lit("current")).withColumn("valid_to", F.lit(None).cast("string"))
    asked = facts.filter("seq % 5 = 0").select("fact_id", F.when(F.col("seq") % 2 == 0, "retracted").otherwise("conflict").alias("status"), F.lit("2030-01-01T00:00:00.000Z").alias("instant"), F.col("seq").alias("arrival"))
    changed, _ = lineage.apply_terminals(facts, asked)
    return lineage.reconcile(changed).select("seq", "status", "valid_to", "superseded_by")


def _outbox(spark, sf_dir):
    facts = adapters.facts(spark, sf_dir)
    fact = facts.filter("seq % 5 <> 0").select("seq", F.col("fact_id").alias("fact_event_id"), F.lit("fact").alias("lifecycle_kind"))
    ended = facts.filter("status <> 'current' AND seq % 4 <> 0").select("seq", F.col("fact_id").alias("fact_event_id"), F.col("status").alias("lifecycle_kind"))
    return fact.unionByName(ended)


def outbox_missing(spark, sf_dir):
    return outbox.missing(adapters.facts(spark, sf_dir), _outbox(spark, sf_dir))


def outbox_flush_prefix(spark, sf_dir):
    rows = adapters.facts(spark, sf_dir).select("seq", (F.col("seq") % 97 != 96).alias("ok"), F.when(F.col("seq") % 3 == 0, F.lit("2026")).alias("delivered_at"))
    return outbox.attempted_prefix(rows, 500).select("seq", F.col("attempted").cast("int").alias("attempted"), F.col("delivered").cast("int").alias("delivered"))


def fact_payloads(spark, sf_dir):
    snaps = lineage.snapshots(adapters.facts(spark, sf_dir)).select("seq", "superseded_ids")
    rows = adapters.facts(spark, sf_dir).join(snaps, "seq")
    made = rows.withColumn("p", outbox.fact_payload())
    get = lambda path: F.get_json_object("p", path)
    return made.select("seq", get("$.content").alias("content"), get("$.event_id").alias("event_id"), F.coalesce(F.json_array_length(get("$.metadata.supersedes")), F.lit(0)).cast("long").alias("n_supersedes"))


def stream_lineage(spark, sf_dir):
    """The facts of events as a stream, stored as they come and reconciled from what is stored."""
    from tidemark.streaming.journal_stream import files_each, lineage_stream, stored_lineages

    root = fresh_path(spark, "lineage-stream")
    each = files_each(table(spark, sf_dir, "events").count(), BATCHES)
    batch = adapters.facts(spark, sf_dir, BATCHES * each)
    source = fresh_path(spark, "fact-files")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", each).parquet(source)
    lineage_stream(stream, root, f"{root}-checkpoint").awaitTermination()
    return stored_lineages(spark, root, batch.schema).select(*COLUMNS)


QUERIES = {f.__name__: f for f in (lineage_reconcile, lineage_current, lineage_as_of, lineage_history, lineage_lane_counts, lineage_keys, fact_materialized, fact_read_merge, conflict_restoration_pairs, occurrence_snapshot, fact_identity, projection_mismatch, fact_terminals, outbox_missing, outbox_flush_prefix, fact_payloads, stream_lineage)}

MATERIAL = f"WITH {FACTS}, mat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, kind, value ORDER BY valid_from DESC, seq DESC) AS rn FROM done) WHERE rn = 1)"
ORACLES = {
    "lineage_reconcile": f"WITH {FACTS} SELECT {LIST} FROM done",
    "stream_lineage": f"WITH {FACTS} SELECT {LIST} FROM done",
    "lineage_current": f"WITH {FACTS} SELECT {LIST} FROM done WHERE status = 'current' AND coalesce(valid_to, '') = ''",
    "lineage_as_of": f"WITH {FACTS} SELECT {LIST} FROM done WHERE status <> 'conflict' AND valid_from <= '{AS_OF}' AND (valid_to IS NULL OR '{AS_OF}' < valid_to)",
    "lineage_history": f"WITH {FACTS} SELECT fact_id, valid_from, status FROM done",
    "lineage_lane_counts": f"""WITH {FACTS} SELECT count(*) FILTER (status = 'current') AS "current", count(*) FILTER (status <> 'current') AS historical, count(*) FILTER (status = 'superseded') AS superseded,
        count(*) FILTER (status = 'retracted') AS retracted, count(*) FILTER (status = 'conflict') AS conflict, count(*) FILTER (seq % 2 = 0) AS selected FROM done""",
    "lineage_keys": "SELECT DISTINCT 'user:' || user_id AS entity_id, event_type AS lineage_key FROM events",
    "fact_materialized": f"{MATERIAL} SELECT entity_id, kind, value, fact_id, status FROM mat",
    "fact_read_merge": f"{MATERIAL} SELECT fact_id, valid_from, status FROM done WHERE seq % 3 <> 0 UNION ALL SELECT fact_id, valid_from, status FROM mat WHERE seq % 3 = 0",
    "conflict_restoration_pairs": f"""WITH {FACTS}, l AS (SELECT *, lead(fact_id) OVER w AS a_id, lead(base) OVER w AS a_base, last_value(CASE WHEN status = 'current' THEN fact_id END IGNORE NULLS) OVER (PARTITION BY entity_id, lineage_key ORDER BY valid_from, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near
        FROM done WINDOW w AS (PARTITION BY entity_id, lineage_key ORDER BY valid_from, seq)), d AS (SELECT fact_id AS superseded_event_id, a_id AS superseding_event_id FROM l WHERE status = 'current' AND a_base = 'conflict')
        SELECT * FROM d UNION ALL SELECT near, fact_id FROM l WHERE status = 'conflict' AND near IS NOT NULL AND fact_id NOT IN (SELECT superseding_event_id FROM d)""",
    "occurrence_snapshot": f"""WITH {FACTS}, k AS (SELECT a.seq AS a_seq, a.fact_id AS a_id, b.seq, b.fact_id, b.valid_from,
          CASE WHEN b.seq <> a.seq AND b.base <> 'current' AND b.ended <= a.valid_from THEN b.base ELSE 'current' END AS st FROM ids a JOIN ids b ON a.entity_id = b.entity_id AND a.lineage_key = b.lineage_key AND b.seq <= a.seq),
        n AS (SELECT *, lead(CASE WHEN st <> 'conflict' THEN fact_id END IGNORE NULLS) OVER w AS n_id, lead(CASE WHEN st <> 'conflict' THEN valid_from END IGNORE NULLS) OVER w AS n_from FROM k WINDOW w AS (PARTITION BY a_seq ORDER BY valid_from, seq))
        SELECT a_seq AS seq, max(CASE WHEN seq = a_seq THEN CASE WHEN n_id IS NULL THEN 'current' ELSE 'superseded' END END) AS status, max(CASE WHEN seq = a_seq THEN n_from END) AS valid_to,
          coalesce(string_agg(DISTINCT CASE WHEN st = 'current' AND n_id = a_id THEN fact_id END, ',' ORDER BY CASE WHEN st = 'current' AND n_id = a_id THEN fact_id END), '') AS superseded_ids FROM n GROUP BY a_seq""",
    "fact_identity": f"WITH {FACTS} SELECT seq, fact_id, true AS stable FROM ids",
    "projection_mismatch": f"WITH {FACTS} SELECT fact_id FROM ids WHERE seq % 7 = 0",
    "fact_terminals": f"""WITH {FACTS}, all_open AS (SELECT *, lead(fact_id) OVER w AS o_id, lead(valid_from) OVER w AS o_from FROM ids WINDOW w AS (PARTITION BY entity_id, lineage_key ORDER BY valid_from, seq)),
        t AS (SELECT *, CASE WHEN seq % 10 = 0 THEN 'retracted' WHEN seq % 5 = 0 THEN 'conflict' ELSE 'current' END AS st FROM all_open),
        n AS (SELECT *, lead(CASE WHEN st <> 'conflict' THEN fact_id END IGNORE NULLS) OVER w AS q_id, lead(CASE WHEN st <> 'conflict' THEN valid_from END IGNORE NULLS) OVER w AS q_from FROM t WINDOW w AS (PARTITION BY entity_id, lineage_key ORDER BY valid_from, seq))
        SELECT seq, CASE WHEN st <> 'current' THEN st WHEN q_id IS NULL THEN 'current' ELSE 'superseded' END AS status,
          CASE WHEN st <> 'current' THEN coalesce(o_from, '2030-01-01T00:00:00.000Z') ELSE q_from END AS valid_to, CASE WHEN st = 'current' THEN q_id END AS superseded_by FROM n""",
    "outbox_missing": f"""WITH {FACTS}, o AS (SELECT seq, fact_id, seq % 5 = 0 AS need_fact, base <> 'current' AND seq % 4 = 0 AS need_status FROM ids) SELECT * FROM o WHERE need_fact OR need_status""",
    "outbox_flush_prefix": """WITH h AS (SELECT event_id AS seq, event_id % 97 <> 96 AS ok FROM events WHERE event_id % 3 <> 0 ORDER BY seq LIMIT 500),
        a AS (SELECT *, coalesce(min(CAST(ok AS INT)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS attempted FROM h)
        SELECT seq, attempted, CASE WHEN attempted = 1 AND ok THEN 1 ELSE 0 END AS delivered FROM a""",
    "fact_payloads": f"""WITH {FACTS}, k AS (SELECT a.seq AS a_seq, a.fact_id AS a_id, b.seq, b.fact_id, b.valid_from,
          CASE WHEN b.seq <> a.seq AND b.base <> 'current' AND b.ended <= a.valid_from THEN b.base ELSE 'current' END AS st FROM ids a JOIN ids b ON a.entity_id = b.entity_id AND a.lineage_key = b.lineage_key AND b.seq <= a.seq),
        n AS (SELECT *, lead(CASE WHEN st <> 'conflict' THEN fact_id END IGNORE NULLS) OVER (PARTITION BY a_seq ORDER BY valid_from, seq) AS n_id FROM k),
        c AS (SELECT a_seq, count(*) FILTER (st = 'current' AND n_id = a_id) AS n FROM n GROUP BY a_seq)
        SELECT ids.seq, '[' || kind || '] ' || value AS content, fact_id AS event_id, c.n AS n_supersedes FROM ids JOIN c ON ids.seq = c.a_seq""",
}
