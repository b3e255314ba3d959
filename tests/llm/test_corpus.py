"""Operators across documents, and the pipeline, against brute force."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, decontaminate, op7, op10, quality_rules, simhash_forest
from tidemark.llm.words import words_of
from tidemark.runtime import written


def brute_windows(items, window=8):
    out = collections.defaultdict(set)
    for place, (_, text) in enumerate(items):
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1) if words else ():
            out[tuple(words[i : i + size])].add(place)
    return out


def brute_hits(text, windows):
    words, hit, items = words_of(text), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if found := windows.get(tuple(words[i : i + size])):
                hit |= set(range(i, i + size))
                items |= found
    return len(words), len(hit), items


def test_decontamination_query(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = brute_windows(items)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    hits = 0
    for r in op10.query(spark, sf_dir).collect():
        n, hit, found = brute_hits(texts[r.doc_id], windows)
        ids = ",".join(sorted(str(items[i][0]) for i in found))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(ids.encode()).hexdigest(), len(found) >= 2)
        hits += bool(hit)
    assert hits


@pytest.mark.parametrize("block_words", [1, 40, 10**6])
def test_decontamination_on_random_words(spark, block_words):
    rng = random.Random(block_words)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, make(rng.randint(0, 12))) for i in range(12)] + [(99, None), (3, "a b c"), (None, "c c c")]
    texts = [(i, make(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (101, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, n_hit string")
    blocks = decontaminate.write_blocks(bench, window=4, block_words=block_words)
    found = decontaminate.find_contamination(docs, blocks).collect()
    windows = brute_windows(items, 4)
    expected = collections.Counter()
    for doc_id, text in texts:
        n, hit, places = brute_hits(text, windows)
        expected[doc_id, n, hit, len(places)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found) == expected
    for r in found:
        if r.clean_text is not None:
            assert len(words_of(r.clean_text)) == r.n_words - r.n_hit


def test_decontamination_of_nothing(spark, odd_rows):
    none = decontaminate.write_blocks(spark.createDataFrame([], "item_id long, text string"))
    found = decontaminate.find_contamination(odd_rows, none)
    assert found.filter("n_hit > 0").count() == 0 and found.count() == odd_rows.count()
    assert decontaminate.decontaminated(found).count() == odd_rows.count()
    assert decontaminate.find_contamination(odd_rows.limit(0), none).count() == 0


def shingles(text):
    words = words_of(text)
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_classes(rows, similarity=0.8):
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = collections.Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= similarity:
            links.append((a, b))
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(rows))], links


def test_near_duplicates_recall_and_no_false_links(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    found = {r.doc_id: r.class_id for r in simhash_forest.near_duplicates(documents).collect()}
    classes, links = brute_classes(rows)
    ids = [d for d, _ in rows]
    same = sum(found[ids[a]] == found[ids[b]] for a, b in links)
    assert links and same >= 0.97 * len(links)
    together = collections.defaultdict(set)
    for i, d in enumerate(ids):
        together[found[d]].add(classes[i])
    assert all(len(x) == 1 for x in together.values())
    assert all(c <= d for d, c in found.items())


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(120)]

    def copy():
        words = list(base)
        words[rng.randrange(len(words))] = word()
        return " ".join(words)

    rows = [(i, copy()) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(100)] + [(2000 + i, " ".join(word() for _ in range(80))) for i in range(100)]
    found = {r.doc_id: r.class_id for r in simhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    classes, links = brute_classes(rows)
    assert sum(found[rows[a][0]] == found[rows[b][0]] for a, b in links) == len(links)
    assert all(found[d] == d for d, _ in rows if d >= 2000)


@pytest.mark.parametrize("few", [0, 20_000])
def test_near_duplicates_by_a_link_that_is_not_the_nearest(spark, monkeypatch, few):
    """Two components whose one link is farther in bits than each of its texts' other, false candidates."""
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    a = words(104)
    other_a = words(2) + a[2:]
    c = a[:93] + words(11)
    rows = list(enumerate(map(" ".join, (a, other_a, c, words(2) + c[2:]))))
    assert set(brute_classes(rows)[1]) == {(0, 1), (0, 2), (2, 3)}
    monkeypatch.setattr(simhash_forest, "FEW_PAIRS", few, raising=False)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = simhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {r.class_id for r in found} == {0}


def dense_rows(n, planted):
    """Texts that share about a quarter of their shingles; the first ones have a partner at a similarity of 0.8."""
    rng = random.Random(8)
    words = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    shared = words(44)
    texts = [shared + words(60) for _ in range(n)]
    texts += [t[:-11] + words(11) for t in texts[:planted]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most_leaves", [4096, 200])
def test_near_duplicates_recall_in_a_dense_region(spark, monkeypatch, most_leaves):
    monkeypatch.setattr(simhash_forest, "MOST_LEAVES", most_leaves, raising=False)
    rows = dense_rows(1500, 150)
    found = {r.doc_id: r.class_id for r in simhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(found[1500 + i] == i for i in range(150))
    assert caught >= 147, caught
    assert all(found[i] == i for i in range(1500))


def test_near_duplicates_of_odd_rows(spark, odd_rows):
    extra = odd_rows.unionByName(odd_rows.filter("doc_id = 7").withColumn("doc_id", F.lit(9).cast("long")))
    found = collections.defaultdict(set)
    for r in simhash_forest.near_duplicates(extra).collect():
        found[r.doc_id].add(r.class_id)
    assert found == {1: {1}, 2: {2}, 3: {3}, None: {None}, 4: {4}, 5: {5}, 6: {6}, 7: {7}, 9: {7}}
    assert simhash_forest.near_duplicates(extra.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(words[:30])), (5, " ".join(words[30:])), (2, " ".join(words[30:])), (9, " ".join(words[:30]))]
    found = {(r.doc_id, r.class_id) for r in simhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(5, 2), (2, 2), (9, 2)}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(90)]
    links = [p for p in links if p[0] != p[1]]
    found = {r.v: r.c for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {v: v for p in links for v in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {v: root(v) for v in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tries_grow_with_the_texts():
    assert simhash_forest.tries_for(10**6, 0.8, 0.95, 32) > simhash_forest.tries_for(10**4, 0.8, 0.95, 32) >= 8
    assert simhash_forest.bit_agreement(1.0) == 1.0


def test_dedup_query(spark, sf_dir):
    rows = op7.query(spark, sf_dir)
    assert rows.filter("kept").count() == rows.select("class_id").distinct().count()


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), "test-stage")
        assert after.columns == first.columns and after.schema == docs.schema, name
        assert 0 < after.count() < docs.count()
        docs = after
    windows = brute_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert all(brute_hits(r.text, windows)[1] == 0 for r in docs.collect())
    kept = brute_classes(sorted((r.doc_id, r.text) for r in docs.collect()))[1]
    assert len(kept) <= 1
    ids = sorted(r.doc_id for r in docs.collect())
    assert ids == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())


def test_quality_on_labels_that_were_not_learned_from(spark):
    """Half of the labels of a size with enough of them."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.learn(docs, labels.filter("doc_id % 2 = 0"))
    held = quality_rules.judge(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    shares = {r.quality: r.kept for r in held.collect()}
    assert shares[0] <= 0.05 and shares[1] >= 0.98


def test_pipeline_takes_odd_rows(spark, sf_dir, odd_rows):
    docs = odd_rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, sf_dir).count() == docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).count() == 0


def test_near_duplicates_recall_of_unequal_sets(spark):
    """At sf0.1, against all links of different shingle sets, by prefix filtering over shingles."""
    import math

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in sorted(docs.collect()):
        if words := words_of(r.text):
            sets.setdefault(simhash_forest.shingle_hashes(words).tobytes(), r.doc_id)
    sets = {d: np.frombuffer(s, np.uint64) for s, d in sets.items()}
    values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        n = counts[np.searchsorted(values, s)]
        first = np.lexsort((s, n))[: len(s) - math.ceil(0.8 * len(s) - 1e-9) + 1]
        for h in s[first][n[first] > 1].tolist():
            holders[h].append(d)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    links = [(a, b) for a, b in pairs if simhash_forest.jaccard(sets[a], sets[b]) >= 0.8 - 1e-12]
    found = {r.doc_id: r.class_id for r in simhash_forest.near_duplicates(docs).collect()}
    assert len(links) >= 50 and sum(found[a] == found[b] for a, b in links) >= 0.95 * len(links)


def test_statistics_of_very_long_blank_lines(spark):
    rows = [(1, " " * 1_000_000 + "\nx y\n x y \nx y"), (2, "\n" * 200_000), (3, "a\r\n\na")]
    found = quality_rules.statistics(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_lines, r.n_dup_lines) for r in found] == [(6, 3, 1), (0, 0, 0), (2, 2, 0)]


def test_labelled_rows_of_one_id_are_bounded(spark):
    docs = spark.createDataFrame([(7, f"word{i} " * 60) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0)], "doc_id long, quality int")
    assert isinstance(quality_rules.learn(docs, labels, most=20), quality_rules.Rules)
