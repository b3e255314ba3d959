"""Queries over search, fusion and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import FOLD_FROM, FOLD_TO, STOP_WORDS, lexical_score, query_terms
from tidemark.operators import pack, search
from tidemark.operators.capture import mark_served
from tidemark.runtime import table
from tidemark.sources import adapters

QUERY = "ourethe tion_er und le"
COLUMNS = ("content", "source", "session_id", "message_id", "role")
N = 20


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.col("lang").alias("wing"), F.col("source").alias("room"), F.lit("2026").alias("created_at"))


def fts_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(query_terms(F.col("text")), " ").alias("terms"))


def fts_df(spark, sf_dir):
    return search.term_statistics(table(spark, sf_dir, "documents"), "text")


def bm25_topk_events(spark, sf_dir):
    rows = search.lexical_top(adapters.bulk_events(spark, sf_dir), COLUMNS, QUERY, N)
    return rows.select("seq", F.round("rank", 6).alias("rank"))


def bm25_topk_documents(spark, sf_dir):
    return search.lexical_top(_documents(spark, sf_dir), ("content", "wing", "room"), QUERY, N).select("id", F.round("rank", 6).alias("rank"))


def lexical_scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lexical_score(F.lit(5.0) - F.col("l_quantity").cast("double")).alias("score"))


def _query_vector(spark, sf_dir):
    """One row comes to the driver."""
    return adapters.vectors(spark, sf_dir).filter("event_id = 0").first()["vector"]


def semantic_topk(spark, sf_dir):
    return search.semantic_top(adapters.vectors(spark, sf_dir), _query_vector(spark, sf_dir), N).select("event_id", "similarity")


def _channels(spark, sf_dir):
    events = adapters.bulk_events(spark, sf_dir)
    top = search.semantic_top(adapters.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50)
    semantic = top.join(events, top["event_id"] == events["seq"])
    semantic = search.placed(semantic, F.col("similarity").desc(), "event_id").select("seq", "id", "memory_key", "created_at", "content", "place")
    lexical = search.lexical_top(events, COLUMNS, QUERY, 50)
    lexical = search.placed(lexical, "rank", F.col("created_at").desc(), "seq").select("seq", "id", "memory_key", "created_at", "content", "place")
    return semantic, lexical


def rrf_fusion(spark, sf_dir):
    semantic, lexical = _channels(spark, sf_dir)
    return search.fuse(semantic, lexical).select("memory_key", "id", F.round("rank_score", 9).alias("rank_score"), "channels")


def next_turn_pack(spark, sf_dir):
    """The flagship read: both channels, fused, without what was served, clipped to a budget."""
    semantic, lexical = _channels(spark, sf_dir)
    fused = search.placed(search.fuse(semantic, lexical), *search.fused_order())
    contents = semantic.select("id", "content").unionByName(lexical.select("id", "content")).dropDuplicates(["id"])
    rows = fused.join(contents, "id")
    return pack.pack(rows, 5, 2000, 700, served=adapters.served(spark, sf_dir)).select("place", "id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("chars"))


def served_dedupe(spark, sf_dir):
    events = adapters.bulk_events(spark, sf_dir)
    items = events.select("memory_key", F.lit("pack").alias("consumer"), F.lit("s1").alias("session_id"))
    return mark_served(adapters.served(spark, sf_dir), items)


def _events(spark, sf_dir):
    rows = adapters.event_rows(spark, sf_dir)
    content = F.concat_ws(" ", F.col("source"), F.lit("item"), (F.col("id") % 50).cast("string"))
    key = F.concat(F.lit("content:"), F.sha2(F.concat_ws(" ", content, (F.col("id") % 200).cast("string")), 256))
    return rows.withColumn("content", content).withColumn("memory_key", key).withColumn("objective_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("o"), (F.col("id") % 40).cast("string"))))


def anti_hits(spark, sf_dir):
    events = _events(spark, sf_dir)
    matched = events.filter("id % 37 = 5").select("id", "created_at", (F.lit(1.0) / (F.lit(61) + F.col("id") % 100)).alias("rank_score"))
    rows = pack.anti_hits(matched, events, adapters.edges(spark, sf_dir), adapters.cancellations(spark, sf_dir), limit=5)
    return rows.select("hit_id", "anchor_event_id", "evidence_event_id", "relation", "text")


def structural_hits(spark, sf_dir):
    events = _events(spark, sf_dir)
    anchors = events.filter("id IN (7, 300, 451)")
    rows = pack.structural_hits("the click item", anchors, events, adapters.edges(spark, sf_dir), adapters.cancellations(spark, sf_dir), limit=8)
    return rows.select("id", "anchor_event_id", "relation", "score")


QUERIES = {f.__name__: f for f in (fts_tokens, fts_df, bm25_topk_events, bm25_topk_documents, lexical_scores, semantic_topk, rrf_fusion, next_turn_pack, served_dedupe, anti_hits, structural_hits)}

FOLDED = f"translate(lower({{0}}), '{FOLD_FROM}', '{FOLD_TO}')"


def _bm25(source: str, text: str, phrases: list[list[str]]) -> str:
    counts = ", ".join(f"CAST((length(j) - length(replace(j, ' {'  '.join(p)} ', ''))) / {len('  '.join(p)) + 2} AS DOUBLE) AS f{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(phrases)))
    terms = " + ".join(f"(CASE WHEN ln((nn - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(phrases)))
    any_hit = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""tok AS (SELECT *, regexp_extract_all({FOLDED.format(text)}, '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
      jn AS (SELECT *, len(t) AS n, ' ' || array_to_string(t, '  ') || ' ' AS j FROM tok), cnt AS (SELECT *, {counts} FROM jn),
      st AS (SELECT CAST(count(*) AS DOUBLE) AS nn, avg(n) AS mean, {stats} FROM cnt), found AS (SELECT cnt.*, -({terms}) AS rank FROM cnt, st WHERE {any_hit})"""


from tidemark.functions.text import query_phrases  # noqa: E402
from tidemark.plans.facts import ISO  # noqa: E402
from tidemark.plans.journal import AT, EDGES  # noqa: E402

PHRASES = query_phrases(QUERY)
BULK = f"""bulk AS (SELECT doc_id AS seq, source, lang AS session_id, CAST(doc_id AS VARCHAR) AS message_id, 'user' AS role, text AS content, 'content:' || sha256(text) AS memory_key, {AT.format('doc_id')} AS created_at,
  'mem_' || sha256(concat_ws(chr(31), '1', 'message', source, lang, CAST(doc_id AS VARCHAR), 'user', sha256(text))) AS id FROM documents)"""
EVENT_TEXT = "concat_ws(' ', content, source, session_id, message_id, role)"
COSINE = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
CHANNELS = f"""{BULK}, {_bm25('bulk', EVENT_TEXT, PHRASES)},
 sem AS (SELECT e.vec_id, {COSINE} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY sim DESC, vec_id LIMIT 50),
 c1 AS (SELECT bulk.*, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS place FROM sem JOIN bulk ON bulk.seq = sem.vec_id),
 lx AS (SELECT * FROM found ORDER BY rank, created_at DESC, seq LIMIT 50), c2 AS (SELECT *, row_number() OVER (ORDER BY rank, created_at DESC, seq) - 1 AS place FROM lx),
 u AS (SELECT id, memory_key, created_at, content, 1.0::DOUBLE / (61 + place) AS con, 'event_embedding' AS channel FROM (SELECT *, row_number() OVER (PARTITION BY memory_key ORDER BY place) AS k FROM c1) WHERE k = 1
   UNION ALL SELECT id, memory_key, created_at, content, 1.0::DOUBLE / (61 + place), 'event_fts' FROM (SELECT *, row_number() OVER (PARTITION BY memory_key ORDER BY place) AS k FROM c2) WHERE k = 1),
 agg AS (SELECT memory_key, sum(con) AS rank_score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM u GROUP BY memory_key),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_key ORDER BY con DESC, created_at DESC, channel) AS b FROM u) WHERE b = 1),
 fused AS (SELECT best.memory_key, best.id, best.created_at, best.content, best.con, rank_score, channels FROM best JOIN agg USING (memory_key))"""
EVENTS = f"""ev AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'fact_conflict' WHEN event_id % 13 = 0 THEN 'fact_retraction' ELSE 'fact' END AS event_type, 'user:' || user_id AS session_id, event_type AS source, {ISO.format('ts')} AS created_at, ts,
  event_type || ' item ' || (event_id % 50) AS content, event_type || ' item ' || (event_id % 50) || ' ' || (event_id % 200) AS memory_key, CASE WHEN event_id % 3 = 0 THEN 'o' || (event_id % 40) END AS objective_id FROM events)"""
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{3,}}')), lambda x: x NOT IN (" + STOP + "))"
ORACLES = {
    "fts_tokens": "SELECT item_id, array_to_string(list_slice(list_transform(list_filter(list_transform(t, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position(t, s.x) = s.i), lambda s: s.x), 1, 16), ' ') AS terms FROM (SELECT item_id, regexp_extract_all(lower(trim(text)), '[\\p{L}\\p{N}_]{2,}') AS t FROM benchmark)",
    "fts_df": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({FOLDED.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents) SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, count(*) AS cf FROM t GROUP BY term",
    "bm25_topk_events": f"WITH {BULK}, {_bm25('bulk', EVENT_TEXT, PHRASES)} SELECT seq, round(rank, 6) AS rank FROM found ORDER BY found.rank, created_at DESC, seq LIMIT {N}",
    "bm25_topk_documents": f"WITH d AS (SELECT doc_id AS id, text AS content, lang, source FROM documents), {_bm25('d', EVENT_TEXT.replace('session_id, message_id, role', '').replace('source, ', 'lang, source'), PHRASES)} SELECT id, round(rank, 6) AS rank FROM found ORDER BY found.rank, id LIMIT {N}",
    "lexical_scores": "SELECT l_orderkey, l_linenumber, round(greatest(0.0, l_quantity - 5.0) / (1 + greatest(0.0, l_quantity - 5.0)), 6) AS score FROM lineitem",
    "semantic_topk": f"SELECT vec_id AS event_id, similarity FROM (SELECT e.vec_id, {COSINE} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY similarity DESC, vec_id LIMIT {N}",
    "rrf_fusion": f"WITH {CHANNELS} SELECT memory_key, id, round(rank_score, 9) AS rank_score, channels FROM fused",
    "next_turn_pack": f"""WITH RECURSIVE {CHANNELS}, f AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, con DESC, created_at DESC, id) - 1 AS place FROM fused),
      g AS (SELECT *, trim(content, E' \\n\\t') AS body, row_number() OVER (ORDER BY place) AS k FROM f WHERE memory_key NOT IN (SELECT 'content:' || sha256(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)),
      r(k, used, n, place, id, text) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(-1 AS BIGINT), '', '' UNION ALL
        SELECT g.k, r.used + length(c.t), r.n + CASE WHEN c.t = '' THEN 0 ELSE 1 END, g.place, g.id, c.t FROM r JOIN g ON g.k = r.k + 1,
          LATERAL (SELECT CASE WHEN r.n >= 5 OR r.used >= 2000 THEN '' WHEN length(g.body) <= least(700, 2000 - r.used) THEN g.body
            WHEN rtrim(left(g.body, CAST(greatest(0, least(700, 2000 - r.used) - 21) AS BIGINT)), E' \\n\\t') = '' THEN '' ELSE rtrim(left(g.body, CAST(greatest(0, least(700, 2000 - r.used) - 21) AS BIGINT)), E' \\n\\t') || chr(10) || '[truncated for pack]' END AS t) c)
      SELECT place, id, sha256(text) AS text_sha256, length(text) AS chars FROM r WHERE text <> ''""",
    "served_dedupe": "SELECT DISTINCT 'content:' || sha256(text) AS memory_key, 'pack' AS consumer, 's1' AS session_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)",
    "anti_hits": f"""WITH {EDGES}, {EVENTS}, m AS (SELECT id, created_at, 1.0::DOUBLE / (61 + id % 100) AS rs FROM ev WHERE id % 37 = 5 ORDER BY rs DESC, created_at DESC, id LIMIT 80),
      h AS (SELECT m.id AS anchor_event_id, ev.id AS evidence_event_id, CASE WHEN event_type = 'fact_retraction' THEN 'retracted_by' ELSE 'superseded_by' END AS relation, content AS text, ev.created_at, rs FROM m JOIN live ON live.superseded_event_id = m.id JOIN ev ON ev.id = live.superseding_event_id WHERE ev.id NOT IN (SELECT superseded_event_id FROM live)),
      x AS (SELECT *, 'anti_' || sha256(concat_ws(chr(31), CAST(anchor_event_id AS VARCHAR), CAST(evidence_event_id AS VARCHAR), relation)) AS hit_id FROM h)
      SELECT hit_id, anchor_event_id, evidence_event_id, relation, text FROM x ORDER BY rs DESC, created_at DESC, hit_id LIMIT 5""",
    "structural_hits": f"""WITH {EDGES}, {EVENTS}, gone AS (SELECT DISTINCT superseded_event_id AS id FROM live), us AS (SELECT * FROM ev WHERE event_type = 'fact' AND id NOT IN (SELECT id FROM gone)), a AS (SELECT * FROM ev WHERE id IN (7, 300, 451)),
      p0 AS (SELECT a.id AS aid, us.id, 0.85 AS s FROM a JOIN us ON a.objective_id = us.objective_id UNION ALL SELECT a.id, us.id, 0.55 FROM a JOIN us ON a.source = us.source AND a.session_id = us.session_id),
      p1 AS (SELECT aid, id, max(s) AS s FROM p0 WHERE aid <> id GROUP BY aid, id),
      p2 AS (SELECT aid, id, s FROM (SELECT p1.*, row_number() OVER (PARTITION BY aid ORDER BY abs(epoch_ms(u.ts) - epoch_ms(v.ts)), u.created_at DESC, p1.id) AS n FROM p1 JOIN ev u ON u.id = p1.id JOIN ev v ON v.id = p1.aid) WHERE n <= 40),
      d AS (SELECT a.id AS aid, us.id, 1.0 AS s FROM a JOIN live ON live.superseded_event_id = a.id JOIN us ON us.id = live.superseding_event_id),
      q AS (SELECT aid, id, max(s) AS s FROM (SELECT * FROM p2 UNION ALL SELECT * FROM d) GROUP BY aid, id),
      w AS (SELECT q.*, u.created_at, u.ts AS uts, v.ts AS vts, u.memory_key AS uk, v.memory_key AS vk, {WORDS.format("'the click item ' || v.content")} AS x, {WORDS.format("u.content")} AS y FROM q JOIN ev u ON u.id = q.id JOIN ev v ON v.id = q.aid),
      z AS (SELECT *, round(s + (CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / sqrt(len(x) * len(y)) END) * 0.09 + 0.03 / (1 + abs(epoch_ms(uts) - epoch_ms(vts)) / 3600000.0), 6) AS score FROM w WHERE uk <> vk AND id NOT IN (SELECT id FROM a)),
      b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, aid) AS n FROM z)
      SELECT id, aid AS anchor_event_id, CASE s WHEN 1.0 THEN 'direct_supersession' WHEN 0.85 THEN 'same_objective' WHEN 0.55 THEN 'same_session' END AS relation, score FROM b WHERE n = 1 ORDER BY score DESC, created_at DESC, id LIMIT 8""",
}
