"""Text expressions: redaction, cleaning, search terms, similarity and clipping. All run as Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries, whatever the engine's notion of a word is.
EDGE_BEFORE, EDGE_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: (kind, pattern) in the order in which they apply.
SECRETS = (
    ("api-key", rf"{B}sk-(?:or-v1-)?[\w-]{{20,}}{B}"),
    ("api-key", rf"{B}sk_[\w-]{{20,}}{B}"),
    ("google-key", rf"{B}AIza[\w-]{{25,}}{B}"),
    ("jwt", rf"{B}eyJ[\w-]{{10,}}\.[\w-]{{10,}}\.[\w-]{{10,}}{B}"),
    ("bot-token", rf"{B}[0-9]{{7,}}:[\w-]{{25,}}{B}"),
    ("bearer-token", rf"(?i){B}bearer\s+[\w.~+/=-]{{20,}}{B}"),
    ("telegram-api-hash", rf"(?is){B}(?:tg_)?api_hash{B}.{{0,256}}?{B}[a-f0-9]{{32}}{B}"),
    ("private-key", r"(?s)-{5}BEGIN [A-Z ]*PRIVATE KEY-{5}.*?-{5}END [A-Z ]*PRIVATE KEY-{5}"),
)
FIELD = r'(?i)("(?:(?:access|refresh)?token|secret|api_?key|authorization)"\s*:\s*")(?!(?-i:\[REDACTED:))[^"\r\n]{8,}(")'
ASSIGNMENT = rf"{B}([0-9A-Z_]*(?:PASSWORD|SECRET|TOKEN|API_KEY)[0-9A-Z_]*\s*=\s*)(?!\[REDACTED:)[^\s\"'`]{{8,}}"


def _bound(text: Column, change: Callable[[Column], Column]) -> Column:
    """change(text) with text computed once, however often change names it."""
    return F.element_at(F.transform(F.array(text), change), 1)


def _any(text: Column, *parts: str) -> Column:
    out = text.contains(parts[0])
    for part in parts[1:]:
        out = out | text.contains(part)
    return out


#: What a text has to hold for each pattern to match it, in the same order; plain searches cost a small part of the patterns.
#: A lower-cased text holds whatever a pattern finds in both cases.
ANCHORS: tuple[Callable[[Column], Column], ...] = (
    lambda t: _any(t, "sk-"),
    lambda t: _any(t, "sk_"),
    lambda t: _any(t, "AIza"),
    lambda t: _any(t, "eyJ"),
    lambda t: _any(t, ":") & t.rlike("[0-9]{7}:"),
    lambda t: _any(F.lower(t), "bearer"),
    lambda t: _any(F.lower(t), "api_hash"),
    lambda t: _any(t, "PRIVATE KEY-----"),
)


def _replaced(text: Column, anchor: Callable[[Column], Column], pattern: str, by: str) -> Column:
    return _bound(text, lambda t: F.when(anchor(t), F.regexp_replace(t, pattern, by)).otherwise(t))


def _field(t: Column) -> Column:
    return _any(t, '"') & t.rlike(r'"\s*:\s*"')


def _assignment(t: Column) -> Column:
    return _any(t, "=") & _any(t, "PASSWORD", "SECRET", "TOKEN", "API_KEY")


def redact(text: Column) -> Column:
    """Secrets replaced by [REDACTED:kind]; what is redacted already stays."""
    for (kind, pattern), anchor in zip(SECRETS, ANCHORS, strict=True):
        text = _replaced(text, anchor, pattern, f"[REDACTED:{kind}]")
    text = _replaced(text, _field, FIELD, "$1[REDACTED:secret-field]$2")
    return _replaced(text, _assignment, ASSIGNMENT, "$1[REDACTED:secret-assignment]")


def _ends(t: Column) -> Column:
    return F.substring(t, 1, 1).rlike(r"\s") | F.substring(t, -3, 3).rlike(r"\s$")


def trimmed(text: Column) -> Column:
    """The pattern starts once in a run of spaces and only where an end has one; $ may stand before a last line end of two characters."""
    return _replaced(text, _ends, r"^\s+|(?<!\s)\s+$", "")


def clean(text: Column) -> Column:
    """Null to empty, NUL to U+FFFD, redacted, trimmed."""
    return trimmed(redact(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\0"), F.lit("\ufffd"))))


def clean_column(text: Column) -> Column:
    """clean() of a plain column of short texts: one compiled test finds those that need nothing. It names the column many times.

    No replacement makes an anchor of another pattern, so the test on the text as it comes is enough."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    needs = _any(raw, "\0") | _ends(raw) | _field(raw) | _assignment(raw)
    for anchor in ANCHORS:
        needs = needs | anchor(raw)
    return F.when(needs, clean(raw)).otherwise(raw)


#: Latin letters with marks, and what is left without them. Other scripts stay as they are.
_MARKED = (
    "áàâäãåāăąǎ a éèêëēĕėęě e íìîïĩīĭįǐ i óòôöõōŏőǒ o úùûüũūŭůűųǔ u ýÿŷ y çćĉċč c ñńņň n śŝşš s źżž z ĝğġģ g ďđ d ĺļľ l ŕŗř r ţťț t ĥ h ĵ j ķ k ŵ w"
).split()
FOLD_FROM = "".join(_MARKED[::2])
FOLD_TO = "".join(plain * len(marked) for marked, plain in zip(_MARKED[::2], _MARKED[1::2], strict=True))


def folded(text: Column) -> Column:
    """Lower-cased, Latin letters without marks."""
    return _bound(F.lower(text), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO)))


def index_tokens(text: Column) -> Column:
    """The terms that the index holds, in order: folded runs of letters and digits."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Up to 16 distinct terms of two letters, digits or underscores at least, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(clean(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))), 1, 16)


def query_phrases(text: str) -> list[list[str]]:
    """The same for a query in hand, each term as the phrase of index terms that it stands for."""
    out: list[list[str]] = []
    seen = list(dict.fromkeys(re.findall(r"\w{2,}", text.strip().lower())))[:16]
    for term in seen:
        plain = term.translate(str.maketrans(FOLD_FROM, FOLD_TO))
        if phrase := re.findall(r"[^\W_]+", plain):
            out.append(phrase)
    return out


STOP_WORDS = tuple("with this the that from for are and это что при как или для без".split())


def structural_tokens(text: Column) -> Column:
    """Distinct terms of three letters at least without the commonest."""
    every = lambda low, pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    # In ASCII both patterns are the same, and the first is several times as fast.
    found = _bound(F.lower(clean(text)), lambda low: F.when(F.octet_length(low) == F.length(low), every(low, "[a-z0-9_]{3,}")).otherwise(every(low, r"[\p{L}\p{N}_]{3,}")))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def token_similarity(a: Column, b: Column) -> Column:
    """Common tokens over the geometric mean of both counts; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.sqrt((F.size(a) * F.size(b)).cast("double")))


def lexical_score(rank: Column) -> Column:
    """A rank of BM25 (the lower the better) as a score from 0 to 1."""
    quality = F.greatest(F.lit(0.0), -rank)
    return F.round(quality / (1 + quality), 6)


MARK = "\n[truncated for pack]"


def clipped(text: Column, most: Column) -> Column:
    """The text if it fits, else a prefix and a mark; empty if no prefix fits. The text is cleaned already."""
    prefix = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(F.lit(0), most - len(MARK))), r"\s+$", "")
    return F.when(F.length(text) <= most, text).when(prefix != "", F.concat(prefix, F.lit(MARK))).otherwise("")


def supports(query: Column, content: Column, similarity: Column) -> Column:
    """Whether a candidate shares two of the query's tokens (or all of fewer), or is very similar."""
    wanted, present = structural_tokens(folded(query)), structural_tokens(folded(content))
    overlap = F.size(F.array_intersect(wanted, present))
    return (F.size(wanted) == 0) | (overlap >= F.least(F.lit(2), F.size(wanted))) | (F.coalesce(similarity, F.lit(0.0)) >= 0.88)
