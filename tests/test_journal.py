import pytest
from pyspark.sql import functions as F

from tidemark.functions import structured
from tidemark.functions.text import clean, clipped, index_tokens, query_phrases, redact
from tidemark.operators import access, capture, lifecycle, pack, search
from tidemark.sources.store import JournalStore, StoreInvalid, StoreUnavailable, export_before, migrate_embeddings, retrieval_trace

NOW = "2026-01-01T00:00:00.000Z"


def one(spark, expression, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("key sk-abcdefghijklmnopqrstu end", "key [REDACTED:api-key] end"),
        ("AIza" + "a" * 30, "[REDACTED:google-key]"),
        ("eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "[REDACTED:jwt]"),
        ("1234567:" + "a" * 30, "[REDACTED:bot-token]"),
        ("bearer abcdefghijklmnopqrstuv", "[REDACTED:bearer-token]"),
        ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "[REDACTED:private-key]"),
        ('{"api_key": "abcdefgh1"}', '{"api_key": "[REDACTED:secret-field]"}'),
        ('{"token": "[REDACTED:x] abc"}', '{"token": "[REDACTED:x] abc"}'),
        ("MY_TOKEN=abcdefgh1", "MY_TOKEN=[REDACTED:secret-assignment]"),
        ("nothing here", "nothing here"),
    ],
)
def test_redaction(spark, text, expected):
    assert one(spark, redact(F.col("t")), t=text) == expected
    assert one(spark, redact(redact(F.col("t"))), t=text) == expected
    assert structured.sanitized({"a": [text]}) == {"a": [expected]}


def test_text(spark):
    assert one(spark, clean(F.col("t")), t="  a\0b ") == "a�b"
    assert one(spark, index_tokens(F.col("t")), t="Blue_1 Été ß") == ["blue", "1", "ete", "ß"]
    assert query_phrases("blue_1 Blue_1 é x") == [["blue", "1"]]
    assert one(spark, clipped(F.col("t"), F.lit(30)), t="a" * 40) == "a" * 9 + "\n[truncated for pack]"
    assert one(spark, clipped(F.col("t"), F.lit(10)), t="a" * 40) == ""


def test_json_values():
    assert structured.canonical_json({"b": 1.0, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    assert structured.vector_checksum([1.0, 2.0]) == structured.vector_checksum([1, 2])
    assert structured.is_unscoped('{"a": {"sourceUserId": 0}}') and not structured.is_unscoped('{"a": [{"source_user_id": "7"}]}')
    assert not structured.is_unscoped("not json") and not structured.is_unscoped('{"x": {"producer": " Gate "}}', frozenset({"gate"}))
    assert structured.privacy_hash("", b"k") is None and structured.privacy_hash("x", b"k").startswith("hmac256:")


BATCH = "source string, session_id string, message_id string, role string, content string, seq long"


def test_capture_twice_and_collisions(spark):
    raw = spark.createDataFrame([("chat", "s", "1", "User", " hello ", 1), ("chat", "s", "2", None, "MY_TOKEN=abcdefgh1", 2), ("chat", "s", "3", "user", "  ", 3), ("", "s", "4", "user", "x", 4)], BATCH)
    good, bad = capture.normalised(raw, NOW)
    rows = {r.message_id: r for r in good.collect()}
    assert rows["1"].role == "user" and rows["1"].content == "hello" and rows["2"].role == "unknown" and "REDACTED" in rows["2"].content
    assert sorted(r.reason for r in bad.collect()) == ["content required", "source required"]
    new, repeated, collisions = capture.insert_or_verify(good.limit(0), good)
    assert (new.count(), repeated.count(), collisions.count()) == (2, 0, 0)
    new, repeated, collisions = capture.insert_or_verify(good, good)
    assert (new.count(), repeated.count(), collisions.count()) == (0, 2, 0)
    _, _, collisions = capture.insert_or_verify(good, good.withColumn("source_ref", F.lit("z")))
    assert {tuple(r.fields) for r in collisions.collect()} == {("source_ref",)}


def test_scope_is_part_of_the_id_only_where_it_is_set(spark):
    raw = spark.createDataFrame([("chat", "s", "1", "user", "hello", 1)], BATCH)
    plain = capture.normalised(raw, NOW)[0].first().id
    assert plain == capture.normalised(raw.withColumn("source_profile", F.lit("")), NOW)[0].first().id
    assert plain != capture.normalised(raw.withColumn("source_profile", F.lit("p")), NOW)[0].first().id
    assert capture.normalised(raw.withColumn("event_id", F.lit("own:1")), NOW)[0].first().id == "own:1"


EDGES = "superseded_event_id string, superseding_event_id string, recorded_at string"


def test_supersession_chain_and_cancellation(spark):
    events = spark.createDataFrame([(x, "fact") for x in "abcd"], "id string, event_type string")
    edges = spark.createDataFrame([("a", "b", NOW), ("b", "c", NOW)], EDGES)
    none = edges.limit(0)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(lifecycle.current_events(events, edges, none)) == ["c", "d"]
    assert ids(lifecycle.current_events(events, edges, none, history=True)) == list("abcd")
    assert ids(lifecycle.current_events(events, edges, edges.limit(1))) == ["a", "c", "d"]
    more = edges.unionByName(spark.createDataFrame([("a", "d", NOW)], EDGES))
    assert "a" not in ids(lifecycle.current_events(events, more, edges.limit(1)))


def test_two_spellings_of_a_pair_are_one(spark):
    rows = spark.createDataFrame([("c1", NOW, '{"cancels_supersessions":[{"superseded_event_id":"a","superseding_event_id":"b"}],"extensions":{"cancelsSupersessions":[{"supersededEventId":"a","supersedingEventId":"b"}]}}'), ("c2", NOW, '{"cancels_supersessions":[{"superseded_event_id":"a","superseding_event_id":"a"}]}'), ("c3", NOW, "broken")], "id string, created_at string, metadata_json string")
    assert [tuple(r)[:3] for r in capture.cancellations_of(rows).collect()] == [("a", "b", "c1")]
    nested = spark.createDataFrame([("x", NOW, '{"supersedes":["a",["b",7]],"extensions":{"supersedes":"x"}}'), ("y", NOW, None)], "id string, created_at string, metadata_json string")
    assert sorted(r.superseded_event_id for r in capture.edges_of(nested).collect()) == ["7", "a", "b"]


def test_semantic_order_and_pools(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("short", [1.0])], "event_id string, vector array<double>")
    assert [r.event_id for r in search.semantic_top(v, [0.9, 0.1, 0.0]).collect()] == ["a", "b", "z"]
    assert search.semantic(v, [0.9, 0.1, 0.0], pool=[]).count() == 0
    assert [r.event_id for r in search.semantic(v, [0.9, 0.1, 0.0], pool=["b", "b"]).collect()] == ["b"]


def test_bm25_against_its_definition(spark):
    import math

    rows = [(1, "blue red red", 1), (2, "red", 2), (3, "green green", 3), (4, "", 4), (5, None, 5)]
    df = spark.createDataFrame(rows, "id long, content string, seq long")
    found = {r.id: r.rank for r in search.bm25(df, ("content",), "red").collect()}
    mean, idf = 6 / 5, math.log((5 - 2 + 0.5) / (2 + 0.5))
    for i, tf, n in ((1, 2, 3), (2, 1, 1)):
        assert found[i] == pytest.approx(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)))
    assert set(found) == {1, 2}
    assert search.bm25(df, ("content",), "!!").count() == 0


def test_fusion_counts_skipped_copies(spark):
    schema = "id string, memory_key string, created_at string, place int"
    a = spark.createDataFrame([("1", "k1", NOW, 0), ("2", "k1", NOW, 1), ("3", "k2", NOW, 2)], schema)
    b = spark.createDataFrame([("3", "k2", NOW, 0)], schema)
    found = {r.memory_key: r for r in search.fuse(a, b).collect()}
    assert found["k1"].rank_score == pytest.approx(1 / 61) and found["k2"].rank_score == pytest.approx(1 / 63 + 1 / 61)
    assert found["k2"].channels == "event_embedding,event_fts" and found["k2"].best == pytest.approx(1 / 61)


def test_pack_clips_and_skips(spark):
    rows = spark.createDataFrame([(0, "a", "k0", "x" * 50), (1, "b", "k1", "y" * 50), (2, "c", "k2", "z" * 50), (3, "d", "k3", "w")], "place int, id string, memory_key string, content string")
    found = pack.pack(rows, 5, 105, served=rows.filter("id = 'b'")).collect()
    assert [(r.id, len(r.text)) for r in found] == [("a", 50), ("c", 50), ("d", 1)]
    assert pack.pack(rows.limit(0)).count() == 0
    budget = pack.budgeted(rows, per_item=40, total=100).collect()
    assert [len(r.text) for r in budget] == [40, 40]


def test_policy_bounds():
    policy = pack.Policy()
    for wrong in ({"anti": 6}, {"structural": 9}, {"scan": 81}, {"anti": 1.5}, {"hops": 0}):
        with pytest.raises(pack.LimitError):
            policy.limits(**wrong)
    assert policy.limits() == {"anti": 3, "structural": 4, "scan": 80}
    with pytest.raises(PermissionError):
        policy.require("memory-objectives", "delete")


def test_context():
    ok = access.Context.checked("p", "Telegram", 5, "private", "5", "1")
    assert ok.topic_id == "" and ok.platform == "telegram"
    for wrong in (("p", "mail", 5, "private", 5), ("p", "telegram", 5, "group", 5), ("p", "telegram", 5, "private", 6), ("p p", "telegram", 5, "private", 5)):
        with pytest.raises(access.RouteDenied):
            access.Context.checked(*wrong)


def test_confirmation_is_once_and_in_time(spark):
    request = spark.createDataFrame([("n1", "note", "text", ["t"], "p", "telegram", "5", "5", "", "key", "s")], "nonce string, event_type string, content string, tags array<string>, source_profile string, source_platform string, source_chat_id string, source_user_id string, source_topic_id string, session_key string, source_session_id string")
    good, refused = access.propose(request.unionByName(request.withColumn("content", F.lit(" "))), NOW)
    assert refused.count() == 1 and good.first().expires_at == "2026-01-01T00:05:00.000Z"
    good = good.withColumn("consumed_at", F.lit(None).cast("string"))
    ask = good.select("nonce", "payload_hash", *[F.col(f"source_{x}").alias(x) for x in access.FIVE], F.lit("key").alias("session_key"), F.col("source_session_id").alias("session_id"), F.lit("2026-01-01T00:04:59.999Z").alias("at"), F.lit(1).alias("arrival"))
    events, audits, consumed = access.confirm(good, ask.unionByName(ask.withColumn("arrival", F.lit(2))))
    assert (events.count(), audits.count(), consumed.count()) == (1, 1, 1)
    assert access.inconsistent(good, audits, events).count() == 0
    assert access.inconsistent(good, audits.withColumn("payload_hash", F.lit("x")), events).count() == 1
    assert access.confirm(good, ask.withColumn("at", F.lit("2026-01-01T00:05:00.000Z")))[0].count() == 0
    assert access.confirm(good, ask.withColumn("session_key", F.lit("other")))[0].count() == 0
    assert access.confirm(good.withColumn("consumed_at", F.lit(NOW)), ask)[0].count() == 0


def test_store(spark, tmp_path):
    with pytest.raises(StoreUnavailable):
        JournalStore(spark, str(tmp_path / "none"), read_only=True)
    store = JournalStore(spark, str(tmp_path / "a"))
    events = spark.createDataFrame([("a", "fact", NOW, "{}", 1), ("b", "fact", NOW, '{"supersedes":"a"}', 2)], "id string, event_type string, created_at string, metadata_json string, seq long")
    store.write(events=events)
    store.backfill_edges()
    store.backfill_edges()
    again = JournalStore(spark, str(tmp_path / "a"), read_only=True)
    assert again.check()["events"] == 2 and again.read("supersessions").count() == 1
    with pytest.raises(StoreInvalid):
        again.write(events=events)
    copy = store.backup(str(tmp_path / "b"))
    assert copy.check() == store.check()
    with pytest.raises(FileExistsError):
        store.backup(str(tmp_path / "b"))
    assert [r.id for r in export_before(store.read("events"), "2026-01-01T00:00:00.001Z").collect()] == ["a", "b"]
    assert export_before(store.read("events"), NOW).count() == 0
    with pytest.raises(ValueError):
        export_before(store.read("events"), "2026-01-01")
    old = spark.createDataFrame([("e", "d")], "event_id string, digest string")
    assert migrate_embeddings(old).first().model_digest == "0" * 64
    assert retrieval_trace(spark, "t", "what", b"k", "c", "s", "x", ["a"], NOW).first().query_preview == ""
