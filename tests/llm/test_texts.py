"""Operators on single texts against brute force."""

import collections
import hashlib
import math
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, license_scan, op1, op2, op3, op5, quality_rules, token_counts
from tidemark.llm.words import words_of


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op1.tokenizer().ranks, special_tokens={})


def expected_bpe(tokenizer, text):
    ids = tokenizer.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_as_the_library(spark, documents, odd_rows, tokenizer):
    rows = documents.select("doc_id", "text").unionByName(odd_rows.select("doc_id", "text"))
    texts = collections.Counter((r.doc_id, expected_bpe(tokenizer, r.text)) for r in rows.collect())
    found = collections.Counter((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in op1.digests(rows).collect())
    assert found == texts
    assert op1.digests(rows.limit(0)).count() == 0


def test_bpe_keeps_columns_and_does_not_need_the_dictionary(spark, odd_rows):
    bpe = op1.tokenizer()
    with_words = bpe.encode(odd_rows).select("doc_id", "labels", byte_bpe.RESULT)
    without = bpe.encode(odd_rows, dictionary_words=0).select("doc_id", "labels", byte_bpe.RESULT)
    assert sorted(map(str, with_words.collect())) == sorted(map(str, without.collect()))


@pytest.mark.parametrize("word", ["a", "hello", " hello", "überall", "日本語", "\U0001f642", "zzzzzzzz", "'s", "\x00"])
def test_bpe_fold_and_merges_agree(spark, tokenizer, word):
    bpe = op1.tokenizer()
    df = spark.createDataFrame([(word,)], "w string")
    ids = [int(x) for x in df.select(bpe.fold(F.col("w")).alias("f")).first().f.split(",")]
    ranks = bpe.ranks
    piece = word.encode()
    assert byte_bpe.merge_by_heap(piece, ranks) == tokenizer._core_bpe.encode_single_piece(piece) == byte_bpe.merge(piece, ranks, byte_bpe.pair_table(ranks))
    if piece not in ranks:
        assert ids == byte_bpe.merge_by_heap(piece, ranks)
    assert bytes(df.select(bpe.decoded(F.array(*map(F.lit, ids))).alias("d")).first().d) == piece


def brute_quality(text):
    words, lines = re.findall("[^\x20\x09-\x0d]+", text or ""), [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    n, repeated = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def test_quality_counts(spark, documents, odd_rows):
    rows = documents.select("doc_id", "text").unionByName(odd_rows.select("doc_id", "text"))
    found = quality_rules.statistics(rows).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(found) == rows.count()
    for r in found:
        assert tuple(r)[2:] == brute_quality(r.text)


def test_quality_query_and_clashes(spark, sf_dir, odd_rows):
    assert op2.query(spark, sf_dir).filter("kept AND base_failed").count() == 0
    judged = quality_rules.judge(odd_rows, quality_rules.Rules(()))
    assert judged.columns.count("n_words") == 1 and dict(judged.dtypes)["n_words"] == "bigint"
    assert judged.count() == odd_rows.count() and judged.filter("kept").count() == 0
    assert str(quality_rules.Rules(())) == "no rules"


def test_rules_find_a_planted_conjunction():
    def row(i):
        values = [100.0 + i, 5.0, (i * 37 % 100) / 100, 0.0, 0.0, 10.0, (i * 53 % 100) / 100, 0.0]
        return (*values, values[2] > 0.5 and values[6] > 0.5, i % 3 == 0)

    rows = [row(i) for i in range(900)]
    rules = quality_rules.cover(rows)
    hit = lambda r: any(all((r[quality_rules.FEATURES.index(x.feature)] > x.threshold) == x.above for x in rule) for rule in rules.rules)
    assert sum(hit(r) != r[8] for r in rows) <= 9
    assert quality_rules.cover([]).rules == ()
    assert quality_rules.cover([(*row(i)[:8], False, i % 3 == 0) for i in range(50)]).rules == ()


def test_learning_takes_nulls_and_other_labels(spark, documents):
    labels = spark.createDataFrame([(None, 0), (1, None), (2, 7), (3, 1), (3, 1)], "doc_id long, quality int")
    assert quality_rules.learn(documents, labels).rules == ()


def brute_license(text):
    words = words_of(text)
    places, base = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    every, score = set(base), 0.0
    for line in (text or "").split("\n"):
        held = set(words_of(line))
        for label, t in license_scan.TEMPLATES:
            wanted = set(words_of(t))
            if len(held & wanted) >= math.ceil(license_scan.THRESHOLD * len(wanted) - 1e-9):
                every.add(label)
                score = max(score, len(held & wanted) / len(wanted))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(every)), 1.0 if places else score


def test_licenses(spark, documents, odd_rows):
    planted = ["Under the MIT license, under the mit-LICENSE.\nx cc by nc. CC BY NC cc by nc2 apache license version 2.0", "éunder the mit license", "GNU lesser general PUBLIC license version 3", "Permission is hereby granted free of charge to any person obtaining a copy of this software"]
    extra = spark.createDataFrame([(-i, t) for i, t in enumerate(planted, 1)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(odd_rows.select("doc_id", "text")).unionByName(extra)
    found = license_scan.scan(rows).select("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert len(found) == rows.count()
    for r in found:
        assert tuple(r)[1:] == brute_license(r.text)
    clash = license_scan.scan(odd_rows)
    assert clash.columns.count("labels") == 1 and clash.filter("score > 0").count() == 0
    assert license_scan.scan(odd_rows, templates=()).count() == odd_rows.count()


def test_wrapped_licenses(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "gpl-2": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
        "mpl-2": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this",
    }
    apart = "Permission is hereby granted, free of charge, to any person\n" + "x " * 60 + "\nobtaining a copy of this software and associated documentation files"
    rows = [(k, f"head\n\n{v}\ntail") for k, v in notices.items()] + [("", apart)]
    for r in license_scan.scan(spark.createDataFrame(rows, "name string, text string")).collect():
        assert r.labels == r.name and (r.score >= license_scan.THRESHOLD) == bool(r.name)
        assert [(m.label, m.block) for m in r.matches] == ([(r.name, 2)] if r.name else [])


def test_license_query(spark, sf_dir):
    rows = op3.query(spark, sf_dir).filter("base_labels <> ''").collect()
    assert rows and all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and r.score == 1.0 for r in rows)


def greedy(word, begin, go_on):
    n, i, pieces = 0, 0, begin
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 0
        n, i, pieces = n + 1, j, go_on
    return n


def test_token_counts(spark, sf_dir, odd_rows):
    vocabulary = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    begin, go_on = map(set, vocabulary)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op5.query(spark, sf_dir).collect():
        counts = [greedy(w, begin, go_on) for w in texts[r.doc_id].split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    odd = token_counts.count_tokens(odd_rows, ([], []))
    assert odd.filter("n_tokens <> n_unknown").count() == 0 and odd.columns.count("n_words") == 1


def test_automaton_on_random_vocabularies():
    import random

    rng = random.Random(5)
    for _ in range(300):
        make = lambda k: {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(k)}
        begin, go_on = make(5), make(5)
        automaton = token_counts.Automaton(begin, go_on)
        for _ in range(30):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
            assert automaton.count(word) == greedy(word, begin, go_on)
