"""Instants as ISO text: canonical form, effective start of a fact, proximity, and intent of a question."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def parsed(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def iso(at: Column) -> Column:
    return F.date_format(at, ISO)


def canonical(text: Column, fallback: Column | None = None) -> Column:
    """ISO with milliseconds and Z; else the fallback's; else empty."""
    out = iso(parsed(text))
    return F.coalesce(out, iso(parsed(fallback)), F.lit("")) if fallback is not None else F.coalesce(out, F.lit(""))


def first_text(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def order_text() -> Column:
    """What facts of a lineage are ordered by, as text."""
    return F.coalesce(F.nullif("valid_from", F.lit("")), F.nullif("said_at", F.lit("")), F.col("created_at"), F.lit(""))


def effective_from() -> Column:
    """The first that isn't empty, canonical; empty if it can't be read."""
    return canonical(order_text())


def proximity(a: Column, b: Column) -> Column:
    """1 / (1 + hours between); 0 where either can't be read."""
    hours = F.abs(F.unix_millis(parsed(a)) - F.unix_millis(parsed(b))) / F.lit(3_600_000.0)
    return F.coalesce(1 / (1 + hours), F.lit(0.0))


@dataclass(frozen=True)
class Intent:
    mode: str  # current, historical, as_of
    as_of: str | None = None
    explicit: bool = False


MONTHS = {name: i for i, name in enumerate("января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(), 1)}
_CUE = re.compile(r"as\s+of|--as-of|на\s+дату|что\s+было\s+на|по\s+состоянию\s+на|каким(?:а|и)?\s+был(?:и|а)?\s+на")
_PAST = re.compile(r"--history|--all|(?:^|\s)(?:за\s+вс[её]\s+время|в\s+прошлом|раньше|истори[яию])(?:\s|$)|(?:^|\s)(?:прежд[еян]|менял)|\b(?:history|historical|previously|formerly)\b")
_NOW = re.compile(r"--current|(?:^|\s)(?:сейчас|теперь|на\s+сегодня)(?:\s|$)|(?:^|\s)(?:текущ|актуальн)|\b(?:current|currently|now)\b")
_D = "[0-9]"
_DATE = rf"(?:{_D}{{1,2}}\s+[^\W\d_]+\s+{_D}{{4}}|{_D}{{1,2}}\.{_D}{{1,2}}\.{_D}{{4}}|{_D}{{4}}-{_D}{{2}}-{_D}{{2}}(?:t\S+)?)"
_TAILS = (
    re.compile(r"\s+--(?:current|all|history)\s*$", re.I),
    re.compile(rf"\s+--as-of\s+{_DATE}\s*$", re.I),
    re.compile(rf"\s+(?:as\s+of|на\s+дату|по\s+состоянию\s+на)\s+{_DATE}\s*$", re.I),
    re.compile(r"\s+(?:история|раньше|теперь|сейчас|за\s+вс[её]\s+время|в\s+прошлом|на\s+сегодня)\s*$", re.I),
)


def _end_of_day(year: int, month: int, day: int) -> str | None:
    try:
        return datetime(year, month, day).strftime("%Y-%m-%dT23:59:59.999Z")
    except ValueError:
        return None


def _as_of(text: str) -> str | None:
    if not _CUE.search(text):
        return None
    if m := re.search(rf"\b({_D}{{4}}-{_D}{{2}}-{_D}{{2}})t({_D}{{2}}:{_D}{{2}})(:{_D}{{2}})?(\.{_D}+)?z?\b", text):
        try:
            at = datetime.fromisoformat(f"{m[1]}T{m[2]}{m[3] or ':00'}").replace(tzinfo=timezone.utc)
        except ValueError:
            return None
        at += timedelta(milliseconds=int(f"{(m[4] or '.0')[1:]:0<3}"[:3]))
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    if m := re.search(rf"\b({_D}{{4}})-({_D}{{2}})-({_D}{{2}})\b", text):
        return _end_of_day(int(m[1]), int(m[2]), int(m[3]))
    if m := re.search(rf"\b({_D}{{1,2}})\.({_D}{{1,2}})\.({_D}{{4}})\b", text):
        return _end_of_day(int(m[3]), int(m[2]), int(m[1]))
    if m := re.search(rf"\b(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})\b", text):
        return _end_of_day(int(m[3]), MONTHS[m[2]], int(m[1]))
    return None


def detect_intent(text: str | None) -> Intent:
    """Whether a question is about a day, about history, or about now."""
    value = unicodedata.normalize("NFKC", text or "").lower()
    if as_of := _as_of(value):
        return Intent("as_of", as_of, True)
    plain = re.sub(r"[^\w.:-]+", " ", value).strip()
    if _PAST.search(plain):
        return Intent("historical", None, True)
    return Intent("current", None, bool(_NOW.search(plain)))


def strip_qualifier(text: str | None, intent: Intent | None = None) -> str:
    """The question without a trailing flag or phrase of time."""
    intent = intent or detect_intent(text)
    value = (text or "").strip()
    for tail in _TAILS:
        value = tail.sub("", value)
    value = value.strip()
    return value or ((text or "").strip() if intent.mode == "current" else "")
