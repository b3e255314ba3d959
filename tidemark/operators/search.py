"""Lexical search by BM25, exact vector search, and their fusion.

Scores of the index hold over the whole table, whatever is filtered later. A search is one pass over the texts: it writes
the rows that hold a term with their counts to the shared folder, and brings the counts of the whole table back as one row.
Only the top rows are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.text import index_tokens, lexical_score, query_phrases
from tidemark.runtime import written

K1, B = 1.2, 0.75


def _occurrences(joined: Column, phrase: list[str]) -> Column:
    text = " " + "  ".join(phrase) + " "
    return ((F.length(joined) - F.length(F.replace(joined, F.lit(text), F.lit("")))) / len(text)).cast("long")


def bm25(table: DataFrame, columns: tuple[str, ...], query: str) -> DataFrame:
    """Rows that hold any term of the query in any of the columns, with rank (the lower the better) and score."""
    phrases = query_phrases(query)
    tokens = index_tokens(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    if not phrases:
        return table.filter(F.lit(False)).withColumn("rank", F.lit(0.0)).withColumn("score", F.lit(0.0))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, "  "), F.lit(" "))
    counts = let(tokens, lambda t: let(spaced(t), lambda j: F.struct(F.size(t).cast("long").alias("n"), *[_occurrences(j, p).alias(f"f{i}") for i, p in enumerate(phrases)])))
    # A generator, as a filter on the counts isn't pushed below it and texts are cut into terms once.
    base = table.select("*", F.explode(F.array(counts)).alias("__c"))
    counted = base.select("*", F.col("__c.n").alias("__n"), *[F.col(f"__c.f{i}").alias(f"__f{i}") for i in range(len(phrases))]).drop("__c")
    hit = reduce(lambda a, b: a | b, [F.col(f"__f{i}") > 0 for i in range(len(phrases))])
    seen = Observation()
    observed = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("__n"), F.lit(0.0)).alias("mean"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"d{i}") for i in range(len(phrases))])
    counted = written(observed.filter(hit), "terms")
    stats = seen.get
    total = F.lit(0.0)
    for i in range(len(phrases)):
        df = F.lit(stats[f"d{i}"]).cast("double")
        idf = F.ln((F.lit(float(stats["n"])) - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = F.col(f"__f{i}").cast("double")
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / F.lit(float(stats["mean"] or 1.0))))
    out = counted.withColumn("rank", -total).drop("__n", *[f"__f{i}" for i in range(len(phrases))])
    return out.withColumn("score", lexical_score(F.col("rank")))


def lexical_top(table: DataFrame, columns: tuple[str, ...], query: str, limit: int = 20, keep: DataFrame | None = None, newest: str = "created_at") -> DataFrame:
    """The best rows, newest first among equals; keep: only ids in it are listed."""
    found = bm25(table, columns, query)
    if keep is not None:
        found = found.join(keep.select("id"), "id", "left_semi")
    return found.orderBy("rank", F.col(newest).desc(), "seq").limit(max(1, limit))


def term_statistics(table: DataFrame, column: str) -> DataFrame:
    """term, df and cf over a table."""
    per_row = table.select(index_tokens(F.coalesce(F.col(column), F.lit(""))).alias("t"))
    every = per_row.select(F.explode("t").alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))
    once = per_row.select(F.explode(F.array_distinct("t")).alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))
    return every.unionByName(once).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length; null where their sizes differ or a value isn't finite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value), value)


def semantic(vectors: DataFrame, query: list[float], model: str | None = None, digest: str | None = None, pool: list[str] | None = None) -> DataFrame:
    """vectors with similarity to the query, 6 places. An empty pool gives nothing; no pool doesn't restrict."""
    rows = vectors
    if model is not None:
        rows = rows.filter((F.col("model") == model) & (F.col("model_digest") == digest))
    if pool is not None:
        chosen = list(dict.fromkeys(pool))[:100]
        rows = rows.filter(F.col("event_id").isin(*chosen)) if chosen else rows.filter(F.lit(False))
    wanted = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.filter(F.size("vector") == len(query))
    return rows.withColumn("similarity", F.round(cosine(F.col("vector"), wanted), 6)).filter("similarity IS NOT NULL")


def semantic_top(vectors: DataFrame, query: list[float], limit: int = 20, **kwargs) -> DataFrame:
    return semantic(vectors, query, **kwargs).orderBy(F.col("similarity").desc(), "event_id").limit(max(1, limit))


def embeddable(events: DataFrame, vectors: DataFrame, model: str | None = None, digest: str | None = None) -> DataFrame:
    """Events without a vector of the model."""
    have = vectors if model is None else vectors.filter((F.col("model") == model) & (F.col("model_digest") == digest))
    return events.join(have.select(F.col("event_id").alias("id")), "id", "left_anti")


RRF = 60


def fuse(semantic_rows: DataFrame, lexical_rows: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion by memory_key. Each has id, memory_key, created_at and place (from 0, over all its rows).

    Of a channel only the first row of a key counts; the row of the greatest contribution, then the newest, stands for it.
    """
    first = lambda df, name: df.withColumn("__first", F.row_number().over(Window.partitionBy("memory_key").orderBy("place"))).filter("__first = 1").select("id", "memory_key", "created_at", (F.lit(1.0) / (F.lit(RRF + 1) + F.col("place"))).alias("con"), F.lit(name).alias("channel"))
    both = first(semantic_rows, "event_embedding").unionByName(first(lexical_rows, "event_fts"))
    key = Window.partitionBy("memory_key")
    best = key.orderBy(F.col("con").desc(), F.col("created_at").desc(), "channel")
    rows = both.withColumn("rank_score", F.sum("con").over(key)).withColumn("channels", F.array_join(F.array_sort(F.collect_set("channel").over(key)), ",")).withColumn("__best", F.row_number().over(best))
    return rows.filter("__best = 1").select("memory_key", "id", "created_at", "rank_score", F.col("con").alias("best"), "channels")


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """place from 0 in the order given; for channels, which are limited."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def fused_order() -> list[Column]:
    return [F.col("rank_score").desc(), F.col("best").desc(), F.col("created_at").desc(), F.col("id").asc()]
