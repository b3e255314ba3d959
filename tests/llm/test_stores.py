"""Files: WARC archives, the token store and the digest array, by round trips."""

import gzip
import hashlib
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op4, op6, op8, op9, token_store, url_filter, warc
from tidemark.llm.chat_format import events_of_rows, fold_events, format_chats, read_back
from tidemark.runtime import fresh_path


def test_queries_agree_with_their_sql(spark, sf_dir):
    import oracle

    con = oracle.connect(sf_dir)
    for module in (op4, op8, op9):
        oracle.same(module.query(spark, sf_dir), con, module.ORACLE)


PAGES = "id long, url string, payload string, extra int"


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/\r\nb", big, 0), (5, None, big, 0), (3, "u", big, 0), (2, "u", "small", 0), (4, "u", "small", 0), (6, "u", None, 0), (7, "u", "\r\n\r\nContent-Length: 5\r\n\r\nWARC/1.1", 0), (8, "u", "x" * 300_000, 0), (8, "u", "x" * 300_000, 0), (None, "u", big, 0)]
    pages = spark.createDataFrame(rows, PAGES)
    normal = warc.warc_round_trip(pages)
    read = warc.read_archives(normal).collect()
    assert len(read) == len(rows)
    by = {}
    for r in read:
        by.setdefault(r.id, []).append(r)
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    assert {k: [(r.record_type, r.refers_to) for r in v] for k, v in by.items()} == {1: [("revisit", 5)], 3: [("revisit", 5)], None: [("revisit", 5)], 5: [("response", None)], 2: [("response", None)], 4: [("response", None)], 6: [("response", None)], 7: [("response", None)], 8: [("response", None)] * 2}
    assert by[1][0].url == "http://a/%0D%0Ab" and by[1][0].payload_bytes == 1400
    assert warc.read_archives(warc.warc_round_trip(pages.limit(0))).count() == 0


def test_each_record_is_a_member_at_its_offset(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}" * i, 0) for i in range(20)], PAGES).coalesce(1)
    path = warc.warc_round_trip(pages).first().archive
    fs, name = pafs.FileSystem.from_uri(path)
    data = fs.open_input_file(name).read()
    index = [tuple(map(int, x.strip("[]").split(","))) for x in fs.open_input_stream(f"{name}.idx").read().decode().splitlines()]
    assert len(index) == 20 and sum(n for _, n in index) == len(data)
    assert b"".join(zlib.decompress(data[a : a + n], 31) for a, n in index) == gzip.decompress(data)


def test_a_damaged_record_is_found():
    record = warc.warc_record(1, "u", b"text", 4, hashlib.sha1(b"text").hexdigest(), None, "d")
    assert warc.parse_record(record)["payload"] == b"text"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"text", b"tEXt"))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([record[:-1]])))
    assert list(warc.split_records(record[i : i + 7] for i in range(0, len(record), 7))) == [record]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def expected(path, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = token_store.encode_whole(path, text or "") + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store_query(spark, sf_dir, path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op6.query(spark, sf_dir).collect())) == expected(path, rows)


def test_token_store_odd_rows_and_single_chunks(spark, path, odd_rows):
    folder = token_store.write_store(odd_rows, path, 2)
    read = token_store.checked_crc(token_store.read_store(spark, folder)).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in odd_rows.collect()]
    assert [(r.doc_id, r.n_tokens, r.start) for r in read] == [(d, n, s) for d, s, n, _ in expected(path, rows)]
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("name").distinct().count()
    manifest = spark.read.parquet(f"{folder}/manifest").first()
    assert manifest.documents == len(rows) and manifest.ids == sum(r.n_tokens for r in read) and manifest.width == 2
    empty = token_store.write_store(odd_rows.limit(0), path, 2)
    assert token_store.checked_crc(token_store.read_store(spark, empty)).count() == 0


def test_a_changed_chunk_is_found(spark, path, odd_rows):
    folder = token_store.write_store(odd_rows.filter("doc_id = 3").limit(1), path, 2)
    row = token_store.read_store(spark, folder).first().asDict()
    import zstandard

    row["chunks"] = [zstandard.ZstdCompressor().compress(b"\0" * 2 * row["n_tokens"])]
    with pytest.raises(ValueError):
        token_store.ids_bytes(row)


def test_words_apart_are_as_the_whole(path):
    encoder = token_store.WordEncoder(path, most=3)
    texts = ["", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "it's I'm 'll", "<|endoftext|> the", "\x00\x85 ü  é", "日本 語", "a b c", "a\u3000b c d", "a\tb c", "one two one", "x\xa0 y"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == [token_store.encode_whole(path, t) for t in texts]


def test_cuts_follow_the_content():
    gear = token_store.gear_table(1000)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1000, 20_000).astype("<u4")
    ends = token_store.cut(ids, gear)
    assert ends[-1] == len(ids) and all(b - a <= 4096 for a, b in zip([0, *ends], ends))
    slow = [sum(int(gear[ids[p - k]]) << k for k in range(16)) % 2**64 for p in range(100, 120)]
    assert slow == [int(x) for x in token_store.rolling(ids, gear)[100:120]]

    def chunks(x):
        stops = token_store.cut(x, gear)
        return {x[a:b].tobytes() for a, b in zip([0, *stops], stops)}

    shifted = chunks(np.concatenate((rng.integers(0, 1000, 77).astype("<u4"), ids)))
    assert len(chunks(ids) & shifted) >= len(ends) - 4
    assert token_store.cut(np.zeros(9000, "<u4"), gear)[-1] == 9000


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
    tail = rest[len(host) :]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    host = host.translate(url_filter.ASCII_LOWER)
    fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (r.host or host)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://xnet/", "https://www.example.net/en/?q=/de/", "http://example.net#/en/", "http://É.example.com/de/a://b", "http://a.org/fr", "http://a.org/fr/", "x://example.com:80/de/", "http://net?x", "http://.net/"]
    urls = odd + [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [*url_filter.RULES, url_filter.Rule("EXAMPLE.org", "", "block"), url_filter.Rule("a.org", "/fr", "allow")]
    found = url_filter.filter_urls(df, url_filter.write_index(spark, rules)).orderBy("page_id").collect()
    low = [url_filter.Rule(r.host.lower(), r.path, r.verdict) for r in rules]
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [brute_rule(u, low) for u in urls]
    assert url_filter.filter_urls(df.limit(0), url_filter.write_index(spark, [])).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, url_filter.write_index(spark, []), default="block").collect()} == {"block"}


def test_equal_digests_are_no_match(spark, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    index = url_filter.DigestIndex(url_filter.write_index(spark, url_filter.RULES))
    assert [int(i) >= 0 for i in index.find(["net\0/", "com\0/", "org\0/fr/"])] == [True, False, True]


LOG = "conv_id long, seq long, kind string, message_id long, role string, text string"


def test_chat_events(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "Hel"), (1, 3, "delta", 1, None, "lo"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "Bye"), (1, 6, "edit", 0, None, "hey"), (1, 7, "message", 1, "assistant", "again"), (1, 8, "delta", 9, "tool", "late"), (None, 0, "other", 0, None, None)]
    chats = format_chats(fold_events(spark.createDataFrame(log, LOG).repartition(3)))
    rows = {r.conv_id: r for r in chats.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "hey"), ("assistant", "Bye"), ("assistant", "again"), ("tool", "late")]
    assert [rows[1].formatted[s.start : s.start + s.length] for s in rows[1].loss_spans] == ["Bye", "again"]
    assert [tuple(t) for t in rows[None].turns] == [("", "")]
    assert format_chats(fold_events(spark.createDataFrame([], LOG))).count() == 0


def test_chat_control_strings_come_back(spark):
    texts = [op4.TRAP, "\\", "\\b\\l\\h", "<turn>### user: x</turn>\n", "", "a: b", "\\\\l", "é\U0001f642\n\n"]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "a:ssistant", "\\c", "<", "#", "assistant", "", "x"], texts))] + [(1, 0, "user", texts[0])], "conv_id long, turn long, role string, text string")
    one = format_chats(fold_events(events_of_rows(rows))).select(read_back(F.col("formatted")).alias("turns")).first().turns
    assert [t.text for t in one] == [texts[0], *texts] and [t.role for t in one][1:] == ["user", "a:ssistant", "\\c", "<", "#", "assistant", "", "x"]


def test_shared_folder(spark):
    assert fresh_path(spark, "x").startswith("file://")


def test_places_of_many_streams_cut_as_one_by_one(monkeypatch):
    monkeypatch.setattr(token_store, "IDS_AT_ONCE", 3000)
    gear, rng = token_store.gear_table(1000), np.random.default_rng(2)
    streams = [rng.integers(0, 1000, n).astype("<u4") for n in (1, 5000, 64, 65, 900, 1200, 1, 700)]
    found = [token_store.ends_of(len(x), p) for x, p in zip(streams, token_store._places_of([x.tobytes() for x in streams], gear), strict=True)]
    assert found == [token_store.cut(x, gear) for x in streams]


def test_a_recipe_that_is_missing_or_changed_is_found(spark, path, odd_rows):
    from tidemark.runtime import dropped

    folder = token_store.write_store(odd_rows, path, 2, files=2)
    token_store.verify_manifest(spark, folder)
    rows = spark.createDataFrame(spark.read.parquet(f"{folder}/recipes").collect()[1:], spark.read.parquet(f"{folder}/recipes").schema)
    dropped(spark, f"{folder}/recipes")
    rows.write.parquet(f"{folder}/recipes")
    with pytest.raises(ValueError):
        token_store.read_store(spark, folder)


def test_streamed_logs_fold_back(spark):
    texts = [None, "", "a", "é\U0001f642x", "\\<#", "two\nlines"]
    data = [(c, t, r, x) for c in (1, None) for t, x in enumerate(texts) for r in ("user", "assistant", None)] + [(1, 0, "user", "a")] * 2 + [(2, None, "assistant", "z")]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    from tidemark.llm.chat_format import loss_text, streamed

    read = lambda log: {r.conv_id: ([tuple(t) for t in r.t], r.loss) for r in format_chats(fold_events(log)).select("conv_id", read_back(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    found = read(streamed(rows))
    for conv in (1, None, 2):
        # Ties of a turn go by role and text, nulls first.
        own = sorted((t is not None, t or 0, r is not None, r or "", x is not None, x or "") for c, t, r, x in data if c == conv)
        turns = [(x[3], x[5]) for x in own]
        assert found[conv] == (turns, "".join(x for r, x in turns if r == "assistant"))
    assert streamed(rows.limit(0)).count() == 0
