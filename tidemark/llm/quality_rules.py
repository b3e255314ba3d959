"""Quality rules: base statistics of a text and a learned decision list, with DataFrame functions only.

``statistics`` adds counts; ``learn`` grows a list of rules from labelled statistics by sequential covering; a rule is a
conjunction of thresholds that rejects. ``Rules.column`` gives the list as one ordered conditional expression.

Learning takes at most ``LABELLED_ROWS`` labelled rows, those whose hashed ids are least, so the driver holds a bounded
number of rows of statistics. Two thirds of them grow a rule, literal by literal at the greatest information gain; the
last third prunes it from its end while its precision there rises, and accepts it at ``PRECISION`` or better with at
least ``SUPPORT`` rows. Rows that a rule covers are taken away before the next one is grown.

Words are runs of characters other than space and U+0009 to U+000D. Defined results: a null or empty text has no words and
fails the base; without usable labels there are no rules; labels other than 0 and 1 are ignored; repeated rows get the
same result each; an empty table gives no rows. Extra columns are kept unless they clash with a result's name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import written

LABELLED_ROWS = 10_000
PRECISION = 0.95
SUPPORT = 3
MOST_RULES = 12
MOST_LITERALS = 4
THRESHOLDS = 48

#: One by one, as Java looks single characters of a class up in a table, but asks its ranges one after the other.
SPACE = r"\x20\x09\x0A\x0B\x0C\x0D"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "words_a_line", "capital_share", "mark_share")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS, base_failed and FEATURES."""
    made = {*COUNTS, *FEATURES, "base_failed"}
    kept = [c for c in docs.columns if c.lower() not in made]
    keep = [F.col(f"`{c}`") for c in kept]
    t = F.col("__t")
    size = lambda c: F.size(c).cast("long")
    first = docs.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t")).select(
        *keep,
        F.regexp_extract_all(t, F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("__w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("__l"),
        F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, f"[^{CAPITALS}!]+", "")).cast("long").alias("__loud"),
        F.length(F.regexp_replace(t, "[^!]+", "")).cast("long").alias("n_marks"),
    )
    w = F.col("__w")
    windows = F.greatest(F.size(w) - 2, F.lit(0))
    # Words hold no spaces, so the text of a struct of three, with ", " between them, stands for these three alone.
    threes = F.arrays_zip(F.slice(w, 1, windows), F.slice(w, 2, windows), F.slice(w, 3, windows)).cast("array<string>")
    second = first.select(*keep, "__w", "__l", "word_chars", "n_symbols", (F.col("__loud") - F.col("n_marks")).alias("n_capitals"), "n_marks", threes.alias("__3"))
    numbered = F.sort_array(F.arrays_zip(F.col("__3").alias("t"), F.sequence(F.lit(0), F.size("__3") - 1).alias("i")))
    third = second.select(
        *keep,
        size("__w").alias("n_words"),
        "word_chars",
        "n_symbols",
        (size("__l") - size(F.array_distinct("__l"))).alias("n_dup_lines"),
        size("__l").alias("n_lines"),
        "n_capitals",
        "n_marks",
        F.when(F.size(F.array_distinct("__3")) < F.size("__3"), numbered).alias("__s"),
    )

    def covered(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(x["t"] == F.get(ordered, j)["t"], F.lit(False))
        repeated = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long")

    # Bound by a lambda: a filter pushed down to here would otherwise sort anew for each element.
    n_repeat_words = F.when(F.col("__s").isNull(), F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array("__s"), covered), F.lit(0)))
    counted = third.select(*keep, *(c for c in COUNTS if c != "n_repeat_words"), n_repeat_words.alias("n_repeat_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.select(
        *keep,
        *COUNTS,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_words", "n_lines").alias("words_a_line"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_marks", "word_chars").alias("mark_share"),
    )


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rules:
    rules: tuple[tuple[Literal, ...], ...]

    def column(self) -> Column:
        """The number of the first rule that rejects, from 1; null where none does."""
        out = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            test = rule[0].column()
            for literal in rule[1:]:
                test = test & literal.column()
            out = F.when(test, F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{n}: reject if {' and '.join(map(str, r))}" for n, r in enumerate(self.rules, 1)) or "no rules"


def _literals(rows: list[tuple]) -> dict[Literal, int]:
    """Every literal of interest with the rows that it covers, as bits."""
    out: dict[Literal, int] = {}
    for f, feature in enumerate(FEATURES):
        values = sorted({r[f] for r in rows})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        if len(cuts) > THRESHOLDS:
            ordered = sorted(r[f] for r in rows)
            picks = {ordered[(k * len(ordered)) // THRESHOLDS] for k in range(1, THRESHOLDS)} | {ordered[-1 - (len(ordered) >> k)] for k in range(4, 12)} | {ordered[len(ordered) >> k] for k in range(4, 12)}
            cuts = sorted(c for c in picks if c < ordered[-1])
        for cut in cuts:
            above = sum(1 << i for i, r in enumerate(rows) if r[f] > cut)
            out[Literal(feature, True, cut)] = above
            out[Literal(feature, False, cut)] = ~above & ((1 << len(rows)) - 1)
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def cover(rows: list[tuple]) -> Rules:
    """rows: the FEATURES, whether the row is to be rejected, and whether it prunes (else it grows)."""
    n = len(FEATURES)
    bits = lambda test: sum(1 << i for i, r in enumerate(rows) if test(r))
    bad, prune = bits(lambda r: r[n]), bits(lambda r: r[n + 1])
    left = (1 << len(rows)) - 1
    literals = _literals(rows)
    rules: list[tuple[Literal, ...]] = []
    while len(rules) < MOST_RULES:
        grow = covered = left & ~prune
        rule: list[Literal] = []
        while len(rule) < MOST_LITERALS and (covered & ~bad):
            p0, n0 = (covered & bad).bit_count(), (covered & ~bad).bit_count()
            if not p0:
                break
            best, gain = None, 1e-9
            for literal, mask in literals.items():
                now = covered & mask
                if now != covered and (g := _gain(p0, n0, (now & bad).bit_count(), (now & ~bad).bit_count())) > gain:
                    best, gain = literal, g
            if best is None:
                break
            rule.append(best)
            covered &= literals[best]
        if not rule or not (grow & bad):
            break
        best_rule, worth = None, 0.0
        for k in range(1, len(rule) + 1):
            part = left & prune
            for literal in rule[:k]:
                part &= literals[literal]
            p, q = (part & bad).bit_count(), (part & ~bad).bit_count()
            if p + q and (p + 0.1) / (p + q + 0.2) > worth + 1e-12:
                best_rule, worth, held = rule[:k], (p + 0.1) / (p + q + 0.2), (p, q)
        if best_rule is None or held[0] < SUPPORT or held[0] / sum(held) < PRECISION:
            break
        rules.append(tuple(best_rule))
        covered = left
        for literal in best_rule:
            covered &= literals[literal]
        left &= ~covered
    return Rules(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", most: int = LABELLED_ROWS) -> Rules:
    """Rules against documents of quality 0, among those that pass the base."""
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Written, so that the statistics are of these texts alone; a filter on them would be pushed below the join.
    rows = statistics(written(given, "labelled")).select(*FEATURES, (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prunes"), "doc_id", "base_failed")
    # An id that stands in very many rows gives as many statistics; only so many rows, by their ids' hashes, come to the driver.
    some = written(rows, "statistics").filter("NOT base_failed").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(most).collect()
    taken = sorted(some, key=lambda r: (r["doc_id"], *r[: len(FEATURES)]))
    return cover([tuple(r)[: len(FEATURES) + 2] for r in taken])


def judge(docs: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """docs with the statistics, rule (which rejects; null: none) and kept."""
    kept = [c for c in docs.columns if c.lower() not in ("rule", "kept")]
    counted = statistics(docs.select(*[F.col(f"`{c}`") for c in kept]), text)
    return counted.withColumn("rule", rules.column()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
