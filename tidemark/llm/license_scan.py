"""License scans: phrases, and an exact set-similarity join of text blocks with templates, with DataFrame functions only.

A template is a label and a text. A block matches it when the block holds at least ``threshold`` of the template's
distinct words. Blocks are the lines of a document, and, as notices are wrapped, all windows of words that run over line
ends, ``WINDOWS`` times as long as the longest template. The join is exact and prunes in four steps:

1. words are ordered by how many documents of the corpus hold them, the rarest first; words that no template holds can't
   count and are dropped;
2. prefix: a block can only match if it holds one of a template's first ``n - need + 1`` words, where ``need`` of its ``n``
   words must be there. One regular expression over these words picks the documents, then the blocks;
3. length: a block needs ``need`` template words;
4. position: from the first common word on, both must have enough words left.

Then the words are intersected. Windows are tried where the whole document holds enough of a template's words, and begin at
one of these; of a template's windows the best (then the first) is a match, with the line that it begins in, unless a line
alone is as good. Templates are a fixed, small table (checked: at most ``MOST_TEMPLATES`` of at most
``MOST_WORDS`` words), and are probed in the row of the document, so no text is shuffled; the only shuffle is of the counts
of template words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Defined results: a null or empty text has no words and
no labels, and score 0; a phrase or block that occurs several times counts each place but gives one label; repeated rows
get the same result each; an empty table gives no rows. Extra columns are kept unless they clash with a result's name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2"),
    ("lgpl-3", "GNU Lesser General Public License, version 3"),
    ("agpl-3", "GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.9
MOST_TEMPLATES, MOST_WORDS = 1000, 2000
WINDOWS = 2

#: One by one, as Java looks single characters of a class up in a table, but asks its ranges one after the other.
SEP = "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{SEP}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PYTHON_WORD = re.compile(WORD)


def words_of(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w.translate(str.maketrans(UPPER, LOWER)) for w in PYTHON_WORD.findall(text)))


def any_of(words) -> str:
    """A pattern for one of these words, whole, in text of any case."""
    return f"(?<![^{SEP}])(?i:{'|'.join(sorted(words))})(?![^{SEP}])"


def phrase_pattern(phrase: str) -> str:
    return f"[{SEP}]+".join(phrase.split(" "))


def word_counts(docs: DataFrame, templates, text: str = "text") -> dict[str, int]:
    """How many documents hold each of the templates' words."""
    vocabulary = sorted({w for _, t in templates for w in _template_words(t)})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.regexp_extract_all(words_of(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the vocabulary
    return {w: 0 for w in vocabulary} | {r["w"]: r["n"] for r in rows}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, text: str = "text", counts: dict[str, int] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, block, share)."""
    if len(templates) > MOST_TEMPLATES or any(len(_template_words(t)) > MOST_WORDS for _, t in templates):
        raise ValueError("more templates or words than the scan holds in a row; deal them into several scans")
    counts = word_counts(docs, templates, text) if counts is None else counts
    order = sorted(counts, key=lambda w: (counts[w], w))
    place = {w: i for i, w in enumerate(order)}
    prepared = []
    for label, t in templates:
        tokens = sorted(_template_words(t), key=place.__getitem__)
        need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        prepared.append((label, tokens, need, tokens[: len(tokens) - need + 1]))
    made = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    t = F.col("__t")
    base = docs.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))

    # Phrases. Their words stand apart by separators only, so each place is one match of this pattern. They share no
    # words at their ends, so no two places overlap.
    either = f"(?<![^{SEP}])(?i:{'|'.join(phrase_pattern(p) for p, _ in phrases)})(?![^{SEP}])"
    n_base = F.regexp_count(t, F.lit(either)).cast("long")
    before = lambda lazy: F.regexp_count(F.regexp_extract(t, f"(?s)^(.*{'?' if lazy else ''}){either}", 1), F.lit(WORD)).cast("long")
    one = [F.when(t.rlike(f"(?<![^{SEP}])(?i:{phrase_pattern(p)})(?![^{SEP}])"), F.lit(label)) for p, label in phrases]
    found = base.select(*keep, "__t", F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"), n_base.alias("n_base"))
    hit = F.col("n_base") > 0
    labels = F.when(hit, F.array_sort(F.array_distinct(F.array_compact(F.array(*one))))).otherwise(F.array().cast("array<string>"))

    # Blocks.
    ordered = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    structs = [F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("tokens"), F.lit(need).alias("need"), F.array(*map(F.lit, prefix)).alias("prefix")) for label, tokens, need, prefix in prepared]

    def probe(block: Column) -> Column:
        def against(held: Column) -> Column:
            def passes(x: Column) -> Column:
                common = F.get(F.array_intersect(x["prefix"], held), F.lit(0))
                left = lambda a: F.size(a) - F.array_position(a, common).cast("int") + 1
                return F.arrays_overlap(x["prefix"], held) & (F.size(held) >= x["need"]) & (F.least(left(x["tokens"]), left(held)) >= x["need"])

            shares = F.transform(F.filter(F.array(*structs), passes), lambda x: F.struct(x["label"].alias("label"), block["n"].alias("block"), (F.size(F.array_intersect(x["tokens"], held)) / F.size(x["tokens"])).alias("share"), x["need"].alias("need"), F.size(F.array_intersect(x["tokens"], held)).alias("n")))
            return F.transform(F.filter(shares, lambda s: s["n"] >= s["need"]), lambda s: F.struct(s["label"].alias("label"), s["block"].alias("block"), s["share"].alias("share")))

        words = F.regexp_extract_all(words_of(block["line"]), F.lit(WORD), F.lit(0))
        return F.get(F.transform(F.array(F.array_intersect(ordered, words)), against), F.lit(0))

    length = WINDOWS * max((len(PYTHON_WORD.findall(t)) for _, t in templates), default=0)

    def across(words: Column) -> Column:
        """The best window over line ends of each template; words: (n, w), the line and the word."""

        def best(x: Column) -> Column:
            def window(i: Column) -> Column:
                part = F.slice(words, i + 1, length)
                return F.struct(F.size(F.array_intersect(x["tokens"], part["w"])).alias("n"), (-part[0]["n"]).alias("first"), F.element_at(part, -1)["n"].alias("last"))

            starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(x["tokens"], F.get(words, i)["w"]))
            found = F.array_max(F.filter(F.transform(starts, window), lambda s: (s["n"] >= x["need"]) & (s["last"] > -s["first"])))
            return F.struct(x["label"].alias("label"), (-found["first"]).alias("block"), (found["n"] / F.size(x["tokens"])).alias("share"))

        held = F.array_intersect(ordered, words["w"])
        wide = lambda held: F.filter(F.array(*structs), lambda x: F.size(F.array_intersect(x["tokens"], held)) >= x["need"])
        return F.filter(F.flatten(F.transform(F.array(held), lambda h: F.transform(wide(h), best))), lambda s: s["share"].isNotNull())

    def with_windows(lines: Column) -> Column:
        words = F.flatten(F.transform(F.split(t, "\n"), lambda line, n: F.transform(F.regexp_extract_all(words_of(line), F.lit(WORD), F.lit(0)), lambda w: F.struct(n.alias("n"), w.alias("w")))))
        new = lambda m: F.filter(F.get(F.transform(F.array(words), across), F.lit(0)), lambda s: ~F.exists(m, lambda x: (x["label"] == s["label"]) & (x["share"] >= s["share"])))
        return F.get(F.transform(F.array(lines), lambda m: F.concat(m, new(m))), F.lit(0))

    empty = F.array().cast("array<struct<label:string,block:int,share:double>>")
    if prepared:
        prefixes = any_of({w for *_, prefix in prepared for w in prefix})
        blocks = F.filter(F.transform(F.split(t, "\n"), lambda line, n: F.struct(n.alias("n"), line.alias("line"))), lambda b: b["line"].rlike(prefixes))
        alone = F.flatten(F.transform(blocks, probe))
        matches = F.when(t.rlike(prefixes), F.when(t.contains("\n"), with_windows(alone)).otherwise(alone)).otherwise(empty)
    else:
        matches = empty
    done = found.select(*keep, "n_words", "n_base", F.when(hit, before(True)).alias("first_word"), F.when(hit, before(False)).alias("last_word"), labels.alias("__b"), matches.alias("matches"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)))
    every = F.array_sort(F.array_distinct(F.concat(F.col("__b"), F.transform("matches", lambda m: m["label"]))))
    return done.select(*keep, "n_words", "n_base", "first_word", "last_word", F.array_join("__b", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "matches")
