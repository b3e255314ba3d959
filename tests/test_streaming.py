"""Streams that are started again after a crash, and lineages read by bucket."""

import os

from pyspark.sql import functions as F

from tidemark.streaming.journal_stream import capture_stream, lineage_stream, stored_lineages

EVENTS = "id string, n long"


def run(spark, source, root):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    capture_stream(stream, root, f"{root}-checkpoint").awaitTermination()
    return sorted((r.id, r.n) for r in spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(root).collect())


def test_a_replayed_epoch_keeps_its_rows(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", 1), ("b", 2)], EVENTS).coalesce(1).write.parquet(source)
    assert run(spark, source, root) == [("a", 1), ("b", 2)]
    os.remove(f"{root}-checkpoint/commits/0")
    for name in os.listdir(f"{root}-checkpoint/commits"):
        if name.startswith(".0"):
            os.remove(f"{root}-checkpoint/commits/{name}")
    assert run(spark, source, root) == [("a", 1), ("b", 2)]
    spark.createDataFrame([("b", 2), ("c", 3)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    assert run(spark, source, root) == [("a", 1), ("b", 2), ("c", 3)]


def test_lineages_by_bucket(spark, sf_dir, tmp_path):
    from tidemark.operators.lineage import reconcile
    from tidemark.sources import adapters

    facts = adapters.facts(spark, sf_dir)
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    facts.coalesce(2).write.parquet(source)
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    lineage_stream(stream, root, f"{root}-checkpoint").awaitTermination()
    rows = lambda df: sorted(map(str, df.select("fact_id", "status", "valid_from", "valid_to").collect()))
    every = reconcile(facts.dropDuplicates(["fact_id"]))
    assert rows(stored_lineages(spark, root, facts.schema)) == rows(every)
    touched = facts.select("entity_id", "lineage_key").distinct().orderBy("entity_id", "lineage_key").limit(3)
    some = stored_lineages(spark, root, facts.schema, touched)
    assert rows(some) == rows(every.join(touched, ["entity_id", "lineage_key"], "left_semi")) and some.count() > 0
    assert stored_lineages(spark, root, facts.schema, touched.limit(0)).count() == 0


def test_a_bucket_is_one_file_of_an_epoch(spark, sf_dir, tmp_path):
    from tidemark.sources import adapters

    facts = adapters.facts(spark, sf_dir)
    facts.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    lineage_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    held = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").glob("epoch=*/bucket=*")]
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 2 and set(held) == {1}


def test_more_rows_come_in_more_files_and_as_many_batches(spark, sf_dir, tmp_path, monkeypatch):
    import oracle
    from tidemark.plans import facts as plans
    from tidemark.streaming import journal_stream

    assert [journal_stream.files_each(n, 4) for n in (0, 1_000_000, 1_000_001, 36_000_000)] == [1, 1, 2, 36]
    monkeypatch.setattr(journal_stream, "ROWS_A_FILE", 50)
    monkeypatch.setattr(plans, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    found = plans.stream_lineage(spark, sf_dir)
    assert len(list((tmp_path / "fact-files").glob("*.parquet"))) == 20
    assert sorted(p.name for p in (tmp_path / "lineage-stream").glob("epoch=*")) == [f"epoch={n}" for n in range(4)]
    oracle.same(found, oracle.connect(sf_dir), plans.ORACLES["stream_lineage"])


def test_stored_facts_are_read_once(spark, sf_dir):
    from tidemark.operators.lineage import reconcile
    from tidemark.sources import adapters

    facts = adapters.facts(spark, sf_dir).dropDuplicates(["fact_id"])
    facts = facts.unionByName(facts.limit(3).withColumn("lineage_key", F.lit(None).cast("string")).withColumn("fact_id", F.concat("fact_id", F.lit("-"))))
    out = reconcile(facts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert out.count() == facts.count() and {r.superseded_by for r in out.filter("lineage_key IS NULL").collect()} == {None}
    one = adapters.facts(spark, sf_dir)
    assert "Union" not in reconcile(one)._jdf.queryExecution().optimizedPlan().toString()
