"""Byte-level BPE: distinct words are folded with Spark's higher-order functions.

A text is cut into words by the tokenizer's pattern. A word that is a token itself has that id. Any other becomes an array
of its bytes, over which ``aggregate`` folds the ranked merges: at each step the adjacent pair of the lowest rank, the
leftmost of equals, is joined. Ranks come from a literal, an array of small maps that is indexed by hash.

The fold takes about 100 microseconds for a word, far too long for each word where it stands, and a corpus has more
distinct words than a worker can hold. So the distinct words between spaces are counted over all texts, and those that
occur most are folded once: at most ``dictionary_words`` of at most ``WORD_BYTES`` bytes. This dictionary is a table in the
shared folder; it never comes to the driver, and each worker loads it once. An Arrow function then writes the ids of each
text from it. Words that are too rare or too long for the dictionary get the same merges there, the long ones with a heap
in n log n steps. No text is shuffled, and the result doesn't depend on what the dictionary holds.

Bytes are held as strings of code points 0 to 255. Decoding looks every id up in an array of such pieces, joins them and
encodes the whole as Latin-1, which gives the bytes.

Defined results: a null or empty text has no ids; special tokens' strings are plain text; repeated rows get the same ids
each; an empty table gives no rows; columns other than the text are kept.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import IRREGULAR_SPACE
from tidemark.runtime import fresh_path, ship, written

SPACE, NO_SPACE = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"
NONE = 2**31 - 1
WORD_BYTES = 64
DICTIONARY_WORDS = 262_144
RARE_WORDS = 200_000
TEXTS_AT_ONCE = 256
RESULT = "ids_text"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as source:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bucketed(entries: dict[str, object], kind: str) -> tuple[Column, int]:
    """A literal array of maps, in which a key's map is at its hash."""
    mask = (1 << max(4, (len(entries) // 2).bit_length())) - 1
    buckets: list[dict] = [{} for _ in range(mask + 1)]
    for key, value in entries.items():
        buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) & mask][key] = value
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), f"array<map<string,{kind}>>"), mask


def _found(table: Column, mask: int, key: Column) -> Column:
    return F.element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(mask)).cast("int")), key)


class ByteBPE:
    """ranks: bytes to rank, which is the id. pattern: with \\s and \\S as white space of Unicode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        inside, java, i = False, "", 0
        while i < len(pattern):
            two = pattern[i : i + 2]
            if two in (r"\s", r"\S"):
                java, i = java + (SPACE if two == r"\s" else NO_SPACE), i + 2
            elif two[0] == "\\":
                java, i = java + two, i + 2
            else:
                java, i = java + two[0], i + 1
        self.java_pattern = java
        self.rank_table, self.rank_mask = _bucketed({k.decode("latin-1"): v for k, v in ranks.items()}, "int")
        pieces = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.decode("latin-1")
        self.pieces = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")

    # -- native expressions

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.java_pattern), F.lit(0))

    def _fold(self, word: Column, table: Column) -> Column:
        """The ids of a piece, comma-joined."""

        def rank(key: Column) -> Column:
            return F.coalesce(_found(table, self.rank_mask, key), F.lit(NONE))

        def merged(acc: Column, lowest: Column) -> Column:
            parts, ranks = acc["parts"], acc["ranks"]

            def at(i: Column) -> Column:
                def joined(pair: Column) -> Column:
                    left = F.when(i > 1, F.array(rank(F.concat(F.get(parts, i - 2), pair)))).otherwise(F.array().cast("array<int>"))
                    right = F.when(i < F.size(ranks), F.array(rank(F.concat(pair, F.get(parts, i + 1))))).otherwise(F.array().cast("array<int>"))
                    new_parts = F.concat(F.slice(parts, 1, i - 1), F.array(pair), F.slice(parts, i + 2, F.size(parts)))
                    new_ranks = F.concat(F.slice(ranks, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(ranks, i + 2, F.size(parts)))
                    return F.struct(new_parts.alias("parts"), new_ranks.alias("ranks"))

                return _let(F.concat(F.get(parts, i - 1), F.get(parts, i)), joined)

            return _let(F.array_position(ranks, lowest).cast("int"), at)

        def step(acc: Column, _: Column) -> Column:
            return _let(F.array_min(acc["ranks"]), lambda lowest: F.when(lowest.isNull() | (lowest == NONE), acc).otherwise(merged(acc, lowest)))

        def folded(chars: Column) -> Column:
            ranks = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)), lambda a, b: rank(F.concat(a, b)))
            start = F.struct(chars.alias("parts"), ranks.alias("ranks"))
            return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda acc: F.array_join(F.transform(acc["parts"], lambda p: rank(p).cast("string")), ","))

        return _let(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), folded)

    def fold(self, word: Column) -> Column:
        return _let(self.rank_table, lambda table: self._fold(word, table))

    def fold_all(self, words: Column) -> Column:
        """The ids of the words of an array, comma-joined; a word that is a token has that id."""

        def one(word: Column, table: Column) -> Column:
            whole = _found(table, self.rank_mask, F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"))
            return F.coalesce(whole.cast("string"), self._fold(word, table))

        return _let(self.rank_table, lambda table: F.array_join(F.transform(words, lambda w: one(w, table)), ","))

    def decoded(self, ids: Column) -> Column:
        """The bytes of an array of ids (as numbers or their decimal strings)."""
        text = _let(self.pieces, lambda pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), ""))
        return F.encode(text, "ISO-8859-1")

    # -- tables

    def dictionary(self, docs: DataFrame, text: str, most: int) -> str:
        """The folder of a table (s, ids) of the distinct words that occur most, folded.

        Words are what stands between spaces, as the pattern cuts at nearly all spaces; s is cut by it and folded as it
        stands behind a space. They are chosen by ranges of counts; of the last range, by a hash, as many as there is room for.
        """
        spark = docs.sparkSession
        spaced = docs.select(F.explode(F.split(F.col(text), " ")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
        # Characters that this Java doesn't know yet might be cut otherwise than by the newer tables of the workers.
        spaced = spaced.filter((F.col("n") > 1) & (F.octet_length("s") < WORD_BYTES) & (F.octet_length("s") > 0) & ~F.col("s").rlike(r"\p{Cn}"))
        counts = written(spaced.select("s", F.floor(F.log2("n") * 8).cast("int").alias("level")), "bpe-words")
        levels = sorted(((r["level"], r["k"]) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
        left, chosen = most, F.lit(False)
        for level, k in levels:
            last = F.col("level") == level
            chosen = chosen | (last if k <= left else last & (F.pmod(F.xxhash64("s"), F.lit(k)) < left))
            if (left := left - k) <= 0:
                break
        tasks = max(1, min(most // 2048, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        some = written(counts.filter(chosen).select("s").repartition(tasks), "bpe-chosen")
        path = fresh_path(spark, "bpe-dictionary")
        some.select("s", self.fold_all(self.split(F.concat(F.lit(" "), F.col("s")))).alias("ids")).write.parquet(path)
        return path

    def encode(self, docs: DataFrame, text: str = "text", dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
        """docs with ids_text, the decimal ids joined by commas."""
        spark = docs.sparkSession
        ship(spark)
        base = docs.withColumn("__t", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
        kept = [c for c in docs.columns if c.lower() not in (RESULT, "__t")]
        given = base.select(*[F.col(f"`{c}`") for c in kept], "__t")
        path = self.dictionary(base, "__t", dictionary_words)
        shared = spark.sparkContext.broadcast((self.pattern, self.ranks))

        def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _encoder(path, shared).encode
            for whole in batches:
                for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                    batch = whole.slice(at, TEXTS_AT_ONCE)
                    ids = pa.array([encode(t) for t in batch.column("__t").to_pylist()], pa.string())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, RESULT])

        schema = T.StructType([given.schema[c] for c in kept] + [T.StructField(RESULT, T.StringType())])
        return given.mapInArrow(ids_of, schema)


def merge_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one piece, in n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """The ranks of all pairs of bytes."""
    return [ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs_of_bytes: list[int]) -> list[int]:
    """The same merges for one piece: by lists where it is short, else with a heap."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n > WORD_BYTES:
        return merge_by_heap(piece, ranks)
    get = ranks.get
    ends = list(range(n + 1))
    pairs = [pairs_of_bytes[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    while pairs and (lowest := min(pairs)) != NONE:
        i = pairs.index(lowest)
        del ends[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[ends[i] : ends[i + 2]], NONE)
        if i:
            pairs[i - 1] = get(piece[ends[i - 1] : ends[i + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


class TextEncoder:
    """The ids of texts, comma-joined: by the dictionary of words behind a space, and by merging where it has no such word."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], spaced: dict[str, str]):
        import regex

        self.cut, self.ranks, self.spaced = regex.compile(pattern).findall, ranks, spaced
        self.pairs = pair_table(ranks)
        # A space and plain letters are one word of the pattern; so is a mark after them.
        self.lettered = self.cut(" abc, de\u00e9.") == [" abc", ",", " de\u00e9", "."]
        self.rare: dict[str, str] = {}

    def pieces(self, text: str) -> str:
        return ",".join(map(self.word, self.cut(text)))

    def word(self, word: str) -> str:
        return ",".join(map(str, merge(word.encode(), self.ranks, self.pairs)))

    def spaced_word(self, word: str) -> str:
        """The ids of a space and a word without white space at its ends."""
        if self.lettered and max(word) < "\u0250":
            if word.isalpha():
                return self.word(f" {word}")
            if word[-1] in ".,;" and word[:-1].isalpha():
                return f"{self.word(f' {word[:-1]}')},{self.word(word[-1])}"
        return self.pieces(f" {word}")

    def encode(self, text: str) -> str:
        if not text or IRREGULAR_SPACE.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        found = list(map(self.spaced.get, rest))
        if None in found:
            rare = self.rare
            for i, ids in enumerate(found):
                if ids is None:
                    word = rest[i]
                    if (ids := rare.get(word)) is None:
                        ids = self.spaced_word(word)
                        if len(word) <= WORD_BYTES:
                            if len(rare) >= RARE_WORDS:
                                rare.clear()
                            rare[word] = ids
                    found[i] = ids
        return ",".join((self.pieces(first), *found))


_encoders: dict[str, TextEncoder] = {}


def _encoder(path: str, shared) -> TextEncoder:
    """One encoder for each worker, kept over tasks."""
    if path not in _encoders:
        _encoders.clear()
        fs, name = pafs.FileSystem.from_uri(path)
        table = pq.read_table(name, filesystem=fs, columns=["s", "ids"])
        _encoders[path] = TextEncoder(*shared.value, dict(zip(table["s"].to_pylist(), table["ids"].to_pylist(), strict=True)))
    return _encoders[path]
