import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.instants import Intent, detect_intent, strip_qualifier
from tidemark.operators import lineage, outbox
from tidemark.operators.identity import fact_id, lineage_key

SCHEMA = "seq long, fact_id string, entity_id string, kind string, value string, source_ref string, said_at string, valid_from string, created_at string, lineage_key string, status string, valid_to string"


def fact(seq, value, at, status="current", key="preference.color", valid_to=None, entity="alice"):
    return (seq, f"f{seq}", entity, "preference", value, f"note:{seq}", at, at, at, key, status, valid_to)


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def states(df):
    return {r.seq: (r.status, r.valid_to, r.superseded_by) for r in df.collect()}


JAN, FEB, MAR = "2026-01-01T10:00:00.000Z", "2026-02-01T10:00:00.000Z", "2026-03-01T10:00:00.000Z"


def test_pinned_fact_id(spark):
    row = [("entity:alice", "preference", "red", "note:1", "2026-01-01T10:00:00Z", "2026-01-01T10:00:00.000Z")]
    df = spark.createDataFrame(row, "entity_id string, kind string, value string, source_ref string, said_at string, valid_from string")
    ids = {df.select(fact_id().alias("i")).first().i, df.withColumn("said_at", F.lit(JAN)).select(fact_id().alias("i")).first().i, df.withColumn("valid_from", F.col("said_at")).select(fact_id().alias("i")).first().i}
    assert "fact_d45448d308270ff788b128d635dd69d3" in ids


def test_a_later_fact_supersedes_and_as_of_sees_the_earlier_one(spark):
    df = lineage.reconcile(facts(spark, fact(1, "red", JAN), fact(2, "blue", FEB)))
    assert states(df) == {1: ("superseded", FEB, "f2"), 2: ("current", None, None)}
    assert [r.value for r in lineage.at_time(df, "as_of", "2026-01-15T00:00:00Z").collect()] == ["red"]
    assert [r.value for r in lineage.at_time(df).collect()] == ["blue"]
    assert lineage.at_time(df, "as_of", "no instant").count() == 0
    assert lineage.at_time(df, "historical").count() == 2


def test_a_value_that_comes_back_is_an_occurrence_of_its_own(spark):
    df = lineage.reconcile(facts(spark, fact(1, "red", JAN), fact(2, "blue", FEB), fact(3, "red", MAR)))
    assert [r.seq for r in lineage.at_time(df).collect()] == [3]
    assert {r.value: r.seq for r in lineage.materialized(df).collect()} == {"red": 3, "blue": 2}


def test_the_order_of_arrival_does_not_matter(spark):
    rows = [fact(i, f"v{i % 4}", f"2026-01-{(i * 7) % 28 + 1:02d}T00:00:00.000Z", ("current", "conflict", "retracted")[(i % 5 == 0) + (i % 7 == 0)], entity=f"e{i % 3}") for i in range(40)]
    expected = states(lineage.reconcile(facts(spark, *rows)))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        assert states(lineage.reconcile(facts(spark, *rows).repartition(3))) == expected


def test_a_retracted_fact_ends_its_lineage_and_a_conflict_revives(spark):
    red, blue = fact(1, "red", JAN), fact(2, "blue", FEB)
    retracted = lineage.reconcile(facts(spark, red, fact(2, "blue", FEB, "retracted", valid_to=MAR)))
    assert lineage.at_time(retracted).count() == 0
    assert [r.value for r in lineage.at_time(retracted, "as_of", "2026-02-15T00:00:00Z").collect()] == ["blue"]
    conflict = facts(spark, red, fact(2, "blue", FEB, "conflict", valid_to=MAR))
    assert [r.value for r in lineage.at_time(lineage.reconcile(conflict)).collect()] == ["red"]
    assert [tuple(r) for r in lineage.restoration_pairs(conflict).collect()] == [("f1", "f2")]
    assert lineage.restoration_pairs(facts(spark, red, blue)).count() == 0


def test_terminal_transitions(spark):
    base = facts(spark, fact(1, "red", JAN), fact(2, "blue", FEB))
    asked = spark.createDataFrame([("f2", "retracted", MAR, 1), ("f2", "retracted", "2026-04-01T00:00:00Z", 2), ("f2", "conflict", MAR, 3), ("f1", "retracted", "2025-01-01T00:00:00Z", 4), ("f1", "conflict", "soon", 5), ("f9", "conflict", MAR, 6)], "fact_id string, status string, instant string, arrival int")
    changed, refused = lineage.apply_terminals(base, asked)
    assert states(lineage.reconcile(changed))[2] == ("retracted", MAR, None)
    assert sorted(r.reason for r in refused.collect()) == ["before its start", "has another terminal status", "invalid instant", "unknown fact"]


def test_facts_without_a_valid_key_stay_current(spark):
    keys = spark.createDataFrame([("Preference.Color ",), ("Preference Color",), ("value/red",), (None,)], "k string")
    assert [r.k for r in keys.select(lineage_key(F.col("k")).alias("k")).collect()] == ["preference.color", None, None, None]
    df = lineage.reconcile(facts(spark, fact(1, "red", JAN, key=None), fact(2, "blue", FEB, key=None)))
    assert {r.status for r in df.collect()} == {"current"}


def test_text_order_and_an_empty_start(spark):
    late = fact(1, "red", "2026-01-01T10:00:00Z")
    early = fact(2, "blue", JAN)  # .000Z sorts before Z
    assert states(lineage.reconcile(facts(spark, late, early)))[2][0] == "superseded"
    nothing = (3, "f3", "e", "k", "v", "", "", "", None, "k.k", "current", None)
    assert states(lineage.reconcile(facts(spark, nothing)))[3] == ("current", None, None)


def test_read_merge_takes_what_only_the_projection_has(spark):
    both = lineage.reconcile(facts(spark, fact(1, "red", JAN), fact(2, "blue", FEB)))
    merged = lineage.read_merge(both.filter("seq = 2"), lineage.materialized(both))
    assert [r.value for r in merged.collect()] == ["blue", "red"]
    renamed = lineage.materialized(both).withColumn("fact_id", F.concat(F.lit("other"), "fact_id"))
    assert lineage.read_merge(both, renamed).count() == 2


def test_insert_again_is_a_no_op_and_a_changed_row_collides(spark):
    store = facts(spark, fact(1, "red", JAN))
    fresh, collisions = lineage.insert_facts(store, store)
    assert fresh.count() == 0 and collisions.count() == 0
    _, collisions = lineage.insert_facts(store, store.withColumn("source_ref", F.lit("other")))
    assert [r.fields for r in collisions.collect()] == [["source_ref"]]


def test_snapshots_know_only_what_was_there(spark):
    rows = facts(spark, fact(1, "red", JAN), fact(2, "blue", FEB, "conflict", valid_to=MAR), fact(3, "green", "2026-02-15T00:00:00.000Z"))
    found = {r.seq: (r.status, r.superseded_ids) for r in lineage.snapshots(rows).collect()}
    assert found == {1: ("current", []), 2: ("current", ["f1"]), 3: ("current", ["f2"])}


@pytest.mark.parametrize(
    ("text", "intent"),
    [
        ("where does she live", Intent("current")),
        ("where does she live now", Intent("current", None, True)),
        ("where did she live previously", Intent("historical", None, True)),
        ("as of 2026-02-01", Intent("as_of", "2026-02-01T23:59:59.999Z", True)),
        ("as of 2026-02-01T10:20Z", Intent("as_of", "2026-02-01T10:20:00.000Z", True)),
        ("по состоянию на 1 февраля 2026", Intent("as_of", "2026-02-01T23:59:59.999Z", True)),
        ("на дату 31.02.2026", Intent("current")),
        (None, Intent("current")),
    ],
)
def test_intent(text, intent):
    assert detect_intent(text) == intent


def test_strip_qualifier():
    assert strip_qualifier("her color as of 2026-02-01") == "her color"
    assert strip_qualifier("her color --history") == "her color"
    assert strip_qualifier(" сейчас") == "сейчас"


def test_outbox(spark):
    rows = facts(spark, fact(1, "red", JAN), fact(2, "blue", FEB, "conflict", valid_to=MAR))
    empty = spark.createDataFrame([], "seq long, fact_event_id string, lifecycle_kind string")
    assert [(r.fact_id, r.need_fact, r.need_status) for r in outbox.reconcile_batch(rows, empty, 1).collect()] == [("f1", True, False)]
    queue = spark.createDataFrame([(i, f"e{i}", f"p{i}", 0, None, None) for i in range(4)], "seq long, event_id string, payload_json string, attempts int, last_error string, delivered_at string")
    fresh, clash = outbox.enqueue(queue, queue.withColumn("payload_json", F.when(F.col("seq") == 1, "x").otherwise(F.col("payload_json"))))
    assert fresh.count() == 0 and [r.event_id for r in clash.collect()] == ["e1"]
    seen = []

    def send(payload):
        if payload == "p2":
            raise OSError("down")
        seen.append(payload)

    after, result = outbox.flush(queue, send, MAR)
    assert seen == ["p0", "p1"] and result == {"delivered": 2, "failed": 1, "remaining": 2}
    assert {r.seq: (r.attempts, r.last_error) for r in after.collect()} == {0: (1, None), 1: (1, None), 2: (1, "delivery:OSError"), 3: (0, None)}
    assert outbox.bounded(9999) == 500 and outbox.bounded(None) == 50
