"""JSON values and keyed digests, which Spark has no expressions for: Arrow-batched UDFs and the plain functions in them."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F

DEEPEST = 8


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, other letters kept; whole floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and math.isfinite(x) and x == int(x) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _python_redact(text: str) -> str:
    import re

    from tidemark.functions.text import ASSIGNMENT, FIELD, SECRETS

    for kind, pattern in SECRETS:
        text = re.sub(pattern, f"[REDACTED:{kind}]", text, flags=re.ASCII)
    text = re.sub(FIELD.replace("(?!(?-i:\\[REDACTED:))", "(?!\\[REDACTED:)"), r"\1[REDACTED:secret-field]\2", text, flags=re.ASCII)
    return re.sub(ASSIGNMENT, r"\1[REDACTED:secret-assignment]", text, flags=re.ASCII)


def sanitized(value: object, depth: int = 0) -> object:
    """Strings redacted, keys cleaned too, down to a depth of 8; what lies deeper stays."""
    if depth > DEEPEST:
        return value
    if isinstance(value, str):
        return _python_redact(value.replace("\0", "\ufffd"))
    if isinstance(value, list):
        return [sanitized(x, depth + 1) for x in value]
    if isinstance(value, dict):
        return {_python_redact(str(k).replace("\0", "\ufffd")).strip(): sanitized(v, depth + 1) for k, v in value.items()}
    return value


def tree(value: object) -> Iterator[tuple[str, object]]:
    """Every key at any depth, with its value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield k, v
            yield from tree(v)
    elif isinstance(value, list):
        for v in value:
            yield from tree(v)


_SCOPES = ("source_profile", "source_platform", "source_chat_id", "source_user_id", "source_topic_id", "source_session_id", "scope_kind", "authorization_version")
SCOPE_KEYS = frozenset(_SCOPES) | frozenset(x.replace("_", "") for x in _SCOPES)


def is_unscoped(text: str | None, guarded: frozenset[str] = frozenset()) -> bool:
    """Whether a JSON text is valid and holds, at any depth, no scope that is set and no source of those guarded."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return False
    for key, v in tree(value):
        k = str(key).lower()
        if k in SCOPE_KEYS and v not in (None, False, 0, "0", ""):
            return False
        if k in ("source", "producer", "event_source", "eventsource") and isinstance(v, str) and v.strip().lower() in guarded:
            return False
    return True


def vector_checksum(vector: Iterable[float]) -> str:
    """SHA-256 of the big-endian doubles."""
    values = [float(x) for x in vector]
    return hashlib.sha256(struct.pack(f">{len(values)}d", *values)).hexdigest()


def keyed_digest(text: str, key: bytes) -> str:
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def privacy_hash(value: str | None, salt: bytes, namespace: str = "value") -> str | None:
    return f"hmac256:{keyed_digest(f'{namespace}\0{value}', salt)[:24]}" if value else None


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else {}
    except ValueError:
        return {}


def _of_texts(function):
    """A UDF over texts. Made on call, as there may be no session when this module is imported."""

    @F.pandas_udf("string")
    def applied(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return applied


def canonical_json_udf():
    return _of_texts(lambda t: canonical_json(_parsed(t)))


def sanitized_json_udf():
    return _of_texts(lambda t: canonical_json(sanitized(_parsed(t))))


def vector_checksum_udf():
    return _of_texts(lambda v: None if v is None else vector_checksum(v))


def nfkc_udf():
    return _of_texts(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def unscoped_udf(guarded: Iterable[str] = ()):
    names = frozenset(x.lower() for x in guarded)

    @F.pandas_udf("boolean")
    def unscoped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: is_unscoped(t, names))

    return unscoped


def keyed_digest_udf(key: bytes):
    return _of_texts(lambda t: None if t is None else keyed_digest(t, key))


def privacy_hash_udf(salt: bytes, namespace: str = "value"):
    return _of_texts(lambda t: privacy_hash(t, salt, namespace))
