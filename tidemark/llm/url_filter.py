"""URL filters by a sorted array of 64-bit digests.

Rules are (host, path prefix, verdict). Their keys are hashed with xxhash64 into one sorted array of digests, written
as a file together with the full strings. Executors memory-map the digests, probe them with a vectorised binary
search and compare the stored string of each hit, so that a collision of digests never counts as a match.

The index lies in the shared folder and is read by each Python worker once, whatever its size; nothing is broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule. Only A-Z of the host are
lower-cased. A rule for an empty host fits every url. Repeated urls get the same row each; repeated rules count once, a
block winning over an allow of the same key; an empty table gives no rows. Extra columns of the input are kept unless
they clash with a result's name, in which case the result's column replaces them.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import fresh_path, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def write_index(spark: SparkSession, rules, path: str | None = None) -> str:
    """Writes the digest file: keys (u64, ascending), the offsets of the strings, verdicts, and the strings."""
    chosen: dict[tuple[str, str], Rule] = {}
    for rule in rules:
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {rule.verdict!r}")
        key = (rule.host.translate(ASCII_LOWER), rule.path)
        if key not in chosen or rule.verdict == "block":
            chosen[key] = Rule(key[0], key[1], rule.verdict)
    # The host's length is part of the key: a.b + c/ and a.bc + / differ.
    entries = sorted((xxhash.xxh64_intdigest(f"{host}\0{p}".encode("utf-8", "surrogatepass")), host, p, rule.verdict) for (host, p), rule in chosen.items())
    texts = [f"{host}\0{p}".encode("utf-8", "surrogatepass") for _, host, p, _ in entries]
    ends = np.cumsum([0] + [len(t) for t in texts]).astype("<u8")
    lengths = np.array(sorted({len(p) for _, _, p, _ in entries}), "<u8")
    head = np.array([len(entries), len(lengths)], "<u8")
    body = b"".join(
        (
            head.tobytes(),
            lengths.tobytes(),
            np.array([e[0] for e in entries], "<u8").tobytes(),
            ends.tobytes(),
            b"".join(texts),
            bytes(e[3] == "block" for e in entries),
        )
    )
    path = path or fresh_path(spark, "url-digests")
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(name) as out:
        out.write(body)
    return path


class DigestIndex:
    """The file, memory-mapped. The local copy has no name, so that nothing of it stays behind."""

    def __init__(self, uri: str):
        fs, name = pafs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as local, fs.open_input_stream(name) as source:
            while part := source.read(1 << 20):
                local.write(part)
            local.flush()
            self.data = np.memmap(local, np.uint8, "r") if local.tell() else np.zeros(0, np.uint8)
        n, k = (int(x) for x in self.data[:16].view("<u8"))
        self.lengths = [int(x) for x in self.data[16 : 16 + 8 * k].view("<u8")]
        at = 16 + 8 * k
        self.keys = self.data[at : at + 8 * n].view("<u8")
        self.ends = self.data[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.texts = at + 16 * n + 8
        self.verdicts = self.texts + int(self.ends[n])
        self.n = n

    def text(self, i: int) -> str:
        a, b = int(self.ends[i]), int(self.ends[i + 1])
        return bytes(self.data[self.texts + a : self.texts + b]).decode("utf-8", "surrogatepass")

    def find(self, strings: list[str]) -> np.ndarray:
        """For each string the place of its entry, or -1."""
        found = np.full(len(strings), -1, np.int64)
        if not self.n or not strings:
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), "<u8", len(strings))
        places = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero((places < self.n) & (self.keys[np.minimum(places, self.n - 1)] == digests))
        for i in hits:
            j = int(places[i])
            while j < self.n and self.keys[j] == digests[i]:
                if self.text(j) == strings[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest rule that fits each url, and its verdict."""
        probes, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffixes, at = [host], host.find(".")
            while at >= 0:
                suffixes.append(host[at + 1 :])
                at = host.find(".", at + 1)
            if host:
                suffixes.append("")
            for length in self.lengths:
                if length <= len(path):
                    for suffix in suffixes:
                        probes.append(f"{suffix}\0{path[:length]}")
                        owners.append(i)
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        places = self.find(probes)
        for p in np.flatnonzero(places >= 0):
            i, key = owners[p], probes[p].replace("\0", "", 1)
            if rules[i] is None or len(key) > len(rules[i]):
                rules[i] = key
                verdicts[i] = "block" if self.data[self.verdicts + int(places[p])] else "allow"
        return rules, verdicts


_open: dict[str, DigestIndex] = {}


def _index(uri: str) -> DigestIndex:
    if uri not in _open:
        _open.clear()
        _open[uri] = DigestIndex(uri)
    return _open[uri]


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(df: DataFrame, index: str, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict. index: what write_index() returned. default: the verdict without a rule."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "__url")]
    base = df.withColumn("__url", F.col(f"`{url}`").cast("string"))
    host, path = host_and_path(F.col("__url"))
    base = base.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))

    @F.pandas_udf("rule string, verdict string")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rules, verdicts = _index(index).judge(list(hosts), list(paths))
        return pd.DataFrame({"rule": pd.Series(rules, dtype=object), "verdict": pd.Series(verdicts, dtype=object)})

    out = base.withColumn("__j", judged("host", "path"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__j.rule").alias("rule"), F.coalesce(F.col("__j.verdict"), F.lit(default)).alias("verdict"))
