"""Documents and their events, at odd values."""

import pytest

from tidemark.operators import documents
from tidemark.sources.store import sync_collection

DOCS = "doc_id string, content string, wing string, room string, source_file string, event_id long, event_source string, event_session_id string, indexed_at string, metadata_json string"
EVENTS = "id long, event_type string, source string"
EDGES = "superseded_event_id long, superseding_event_id long"


@pytest.fixture
def tables(spark):
    docs = [("a", "x", "w", "r", "f", 1, "s", "t", "1", None), ("b", "x", "w", "r", "f", 2, None, None, "1", None), ("c", "x", "v", "r", "f", None, "", "", "1", None), ("d", "x", "w", "r", "f", 99, "s", "u", "1", "bad"), ("e", "x", "w", "q", "f", 3, "s", "t", "1", '{"event_id": 4}')]
    events = spark.createDataFrame([(1, "fact", "led"), (2, "message", "chat"), (3, "fact_conflict", "led")], EVENTS)
    return spark.createDataFrame(docs, DOCS), events, spark.createDataFrame([(2, 3)], EDGES), spark.createDataFrame([], EDGES)


def ids(df):
    return "".join(sorted(r.doc_id for r in df.collect()))


def test_guards(tables):
    assert ids(documents.admissible(*tables)) == "acd"
    assert ids(documents.admissible(*tables, history=True)) == "abcde"
    assert ids(documents.admissible(*tables, control=False)) == "acde"
    assert ids(documents.admissible(*tables, history=True, ledger="led")) == "bcde"
    assert ids(documents.admissible(*tables, history=True, ledger="led", ledger_lifecycle=True)) == "bcd"
    assert ids(documents.admissible(*tables, history=True, without_sessions=("t",), without_sources=("none",))) == "bcd"
    assert ids(documents.admissible(*tables, history=True, wing="w", room="r")) == "abd"
    assert ids(documents.admissible(tables[0].limit(0), *tables[1:])) == ""


def test_unscoped_documents_by_metadata(spark, tables):
    metadata = {"a": None, "b": "", "c": "bad", "d": "{}", "e": '{"scope_kind": "topic"}', "f": '{"a": {"event_id": 2}}', "g": '{"event_id": 1}'}
    docs = spark.createDataFrame([(k, "x", "w", "r", "f", 1, None, None, "1", v) for k, v in metadata.items()], DOCS)
    done = spark.createDataFrame([(1, "index", "success", "f")], "event_id long, target string, status string, projection_ref string")
    shown = documents.unscoped_documents(docs, *tables[1:], done)
    assert ids(shown) == "adg" and sorted(shown.columns) == sorted(docs.columns)
    assert [r.metadata_json for r in shown.filter("doc_id = 'a'").collect()] == [None]


def test_search_lists_only_what_is_shown(tables):
    assert ids(documents.documents_top(tables[0], documents.admissible(*tables), "xx")) == ""
    longer = tables[0].withColumn("content", tables[0]["wing"])
    assert ids(documents.documents_top(longer.replace("w", "word"), documents.admissible(*tables), "word")) == "ad"


@pytest.mark.parametrize(("metadata", "found"), [(None, False), ("", False), ("no json", False), ("[]", False), ('{"event_id": "7"}', False), ('{"event_id": 7}', False), ('{"event_id": ""}', False), ('{"event_id": null}', False), ('{"a": [{"eventId": "8"}]}', True), ('{"memory_event_id": {}}', True), ('{"memoryEventId": true}', True)])
def test_metadata_that_names_another_event(metadata, found):
    assert documents.contradicts(metadata, "7") == found


def test_collection_sync_of_nothing(spark, tables):
    there = tables[0].select("doc_id", "content")
    none = spark.createDataFrame([], "doc_id string, content string, wing string, room string, source_file string")
    projections = spark.createDataFrame([("1", "success", "1", None)], "event_id string, status string, projected_at string, projection_ref string")
    kept, stale = sync_collection(there, none, projections, "2")
    assert kept.count() == 0 and ids(stale) == "abcde"


def test_unscoped_documents_without_metadata_agree_with_sql(spark, tmp_path):
    import duckdb

    from oracle import connect, same
    from tidemark.plans.documents import ORACLES, unscoped_documents

    tables = {
        "documents": "SELECT range AS doc_id, 'x' AS text, 'en' AS lang, 'view' AS source FROM range(60)",
        "labels": "SELECT range AS doc_id, 1 AS quality, 0 AS toxic FROM range(60)",
        "events": "SELECT range AS event_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, range AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(60)",
    }
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    found = unscoped_documents(spark, str(tmp_path))
    assert found.filter("doc_id % 4 = 3").count() > 0  # stored without metadata
    same(found, connect(str(tmp_path)), ORACLES["unscoped_documents"])


DAY = "TIMESTAMP '2024-01-01 00:00:00'"


@pytest.mark.parametrize(("source", "ts", "event_id"), [("CASE WHEN range % 2 = 0 THEN 'view' END", DAY, "range"), ("'view'", f"CASE WHEN range >= 60 THEN {DAY} END", "range"), ("'view'", f"{DAY} + to_minutes(range)", "CASE WHEN range % 40 < 20 THEN range END")], ids=["source", "ts", "event_id"])
@pytest.mark.parametrize("name", ["unscoped_documents", "document_guards"])
def test_queries_on_nulls_agree_with_sql(spark, tmp_path, name, source, ts, event_id):
    import duckdb

    from oracle import connect, same
    from tidemark.plans.documents import ORACLES, QUERIES

    tables = {
        "documents": f"SELECT range AS doc_id, 'x' AS text, 'en' AS lang, {source} AS source FROM range(120)",
        "labels": "SELECT range AS doc_id, 1 AS quality, 0 AS toxic FROM range(120)",
        "events": f"SELECT {event_id} AS event_id, {ts} AS ts, range % 20 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM range(120)",
    }
    for table, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() > 0
    same(found, connect(str(tmp_path)), ORACLES[name])
