"""Text expressions: the same results as with the bare patterns, and work that grows no faster than the text."""

import time

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans import catalog

K = "abcdefghij0123456789ABCDEFGHIJ"
TEXTS = (
    None, "", " ", "\n", " a \n", "a \r\n", "a \u0085", "  a", "a  b\t ", "plain", "ask-me: 12:30", f"a sk-{K}", f"sk-or-v1-{K} x", f"xsk-{K}", f"sk_{K}", f"AIza{K}", f"eyJ{K}.{K}.{K}", f"1234567:{K}", f"bearer  {K}", f"BeArEr {K}", f"beaKrer {K}",
    f"API_HASH = {'a1' * 16}", f"tg_api_hash\n{'0f' * 16}.", f"-----BEGIN RSA PRIVATE KEY-----\n{K}\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", f'"Access{"Token"}" : "{K}"', f'"api_key":"sk-{K}"', f'"x": "{K}"', f"A_TOKEN = {K}", "MY_PASSWORD=short", f"SECRET=[REDACTED:x] API_KEY={K}", f"TOKEN=sk-{K} bearer {K}\0 ",
    "Été the_thing Абвг x1 ²³¹ 一二三 THE and abc ABC", "İstanbul KKK ΣΣΣ", "a_b __ ___ 12 123",
)


def bare(text):
    for kind, pattern in T.SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    text = F.regexp_replace(text, T.FIELD, "$1[REDACTED:secret-field]$2")
    return F.regexp_replace(text, T.ASSIGNMENT, "$1[REDACTED:secret-assignment]")


def bare_clean(text):
    return F.regexp_replace(bare(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("�"))), r"^\s+|\s+$", "")


def bare_tokens(text):
    return F.array_except(F.regexp_extract_all(F.lower(bare_clean(text)), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)), F.array(*map(F.lit, T.STOP_WORDS)))


def test_anchors_and_ascii_change_nothing(spark):
    texts = [*TEXTS, *(f"{a}{gap}{b}" for a in TEXTS if a for b in TEXTS[10:] if b for gap in (" ", "\n\n", ""))]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.redact(F.col("t")), bare(F.col("t")), T.clean(F.col("t")), bare_clean(F.col("t")), T.structural_tokens(F.col("t")), bare_tokens(F.col("t")))
    for t, a, b, c, d, e, f in df.collect():
        assert (a, c, e) == (b, d, f), t


def test_clean_takes_long_runs_of_spaces_once(spark):
    began = time.time()
    assert spark.range(1).select(T.clean(F.concat(F.lit("a"), F.repeat(F.lit(" "), F.lit(400_000)), F.lit("b "))).alias("t")).first().t.endswith(" b")
    assert time.time() - began < 15


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_similarity_makes_tokens_once(spark, sf_dir):
    assert "regexp_extract_all" not in plan(catalog.QUERIES["text_similarity"](spark, sf_dir))


def test_support_deals_texts_over_tasks(spark, sf_dir):
    assert "Exchange hashpartitioning(doc_id" in plan(catalog.QUERIES["query_support"](spark, sf_dir))


def test_redaction_deals_texts_over_tasks(spark, sf_dir):
    assert "Exchange hashpartitioning(doc_id" in plan(catalog.QUERIES["redact_text"](spark, sf_dir))


def test_clean_of_columns(spark):
    df = spark.createDataFrame([(x,) for x in (*TEXTS, "a\0b", "\0 sk-x ")], "t string").select("t", T.clean_column(F.col("t")), bare_clean(F.col("t")))
    for t, a, b in df.collect():
        assert a == b, t


def test_registry_parses_a_row_once(spark, sf_dir):
    made = plan(catalog.QUERIES["objective_registry"](spark, sf_dir))
    assert "json_tuple" in made and "get_json_object" not in made
