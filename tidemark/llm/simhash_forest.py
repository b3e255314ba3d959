"""Near-duplicate classes by an LSH forest over SimHash.

1. Equal word sequences fall into one text, grouped by digest (partly before the shuffle).
2. Each text has 128 SimHash bits over its distinct five-word shingles. The forest is several tries, each over its own
   random permutation of the bits.
3. In each trie a text climbs from its leaf to the longest prefix at which the tries together reach the target recall
   (``depth_for``, ``tries_for``) and meets all leaves that share it, however many they are and wherever they lie. The
   target follows from the prefix's length alone, so it holds in dense regions too; what adapts to density is how a
   prefix is dealt: one of more than ``MOST_LEAVES`` leaves goes to several tasks (``dealt``).
4. Two leaves are candidates if they are within a Hamming distance and of lengths that allow the similarity, in the first
   trie in which they meet. No pair leaves a task: it names the leaves that have a candidate, these get their shingle
   sets, and the same leaves meet once more, are compared exactly, and give at most one link per leaf that is new to its
   component there. So rows grow with leaves, not with the pairs of a group, and every candidate is verified.
5. Links give components.

Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. A text of 1 to 4 words is one
shingle. Defined results: a null or empty text, or one without words, is a class of its own; rows that share a doc_id
count as one document, whose texts' classes join; a null doc_id has a null class; an empty table gives no rows. The class
id is the least doc_id of the class. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.words import words_of
from tidemark.runtime import ship, written

SHINGLE = 5
BITS = 128
FLIP = np.uint64(1 << 63)
#: Ids to verify are broadcast up to so many (8 bytes each); beyond that they are joined by a shuffle.
BROADCAST_IDS = 4_000_000
FIRST_TRIES = 4
KEPT_WORDS = 150_000
PAIRS_AT_ONCE = 128

#: Leaves, and shingles of leaves, of one prefix that meet in a task; more are dealt into parts.
MOST_LEAVES, MOST_SHINGLES = 4096, 8_000_000
TILE, TILE_ACROSS = 128, 4096
LEAF = ("trie", "rep", "s1", "s2", "shingles", "c")
UNIT = ("trie", "prefix", "x", "y")
UNIT_SQL = "trie int, prefix long, x int, y int"
PAIRS = pa.schema([(n, pa.int64()) for n in ("a", "b", "d")])

_word_hashes: dict[str, int] = {}
_multipliers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str]) -> np.ndarray:
    """The distinct shingles, hashed to 64 bits, ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    get = _word_hashes.get
    found = list(map(get, words))
    if None in found:
        if len(_word_hashes) > KEPT_WORDS:
            _word_hashes.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = _word_hashes[words[i]] = xxhash.xxh64_intdigest(words[i].encode("utf-8", "surrogatepass"))
    w = np.array(found, np.uint64)
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += _mix(w[k : k + n] ^ _multipliers[k]) * _multipliers[k]
    return np.unique(_mix(total))


def simhash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits: each is the majority of that bit over the shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        h = shingles[at : at + (1 << 14)]
        wide = np.stack((h, _mix(h + np.uint64(0x9E3779B97F4A7C15))), 1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(h), 16), axis=1).sum(0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(shingles)).view(np.int64)
    return int(packed[0]), int(packed[1])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) and len(b) else 0.0


def bit_agreement(similarity: float) -> float:
    """How likely two sets of this Jaccard similarity, of about equal size, agree in a bit."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def depth_for(texts: int, reach: int) -> int:
    """The length of the prefix that a text climbs to; if sketches were uniform, about 2 to 4 times ``reach`` leaves share it."""
    return max(0, math.floor(math.log2(max(1, texts) / (2 * reach)))) if texts else 0


def tries_for(texts: int, similarity: float, recall: float, reach: int) -> int:
    """So many tries that a pair of this similarity shares the prefix in one of them with this probability."""
    meets = bit_agreement(similarity) ** depth_for(texts, reach)
    return 8 if meets > 0.9999 else max(8, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def distance_for(similarity: float, sigmas: float = 4.0) -> int:
    p = 1 - bit_agreement(similarity)
    return min(BITS, math.ceil(BITS * p + sigmas * math.sqrt(BITS * p * (1 - p))))


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, key (16 bytes; null without words), s1, s2, shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.int64())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(t.as_py())
                if not words:
                    rows.append((doc_id, None, None, None, None))
                    continue
                shingles = shingle_hashes(words)
                key = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                rows.append((doc_id, key, *simhash(shingles), len(shingles)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(sketch, "doc_id long, key binary, s1 long, s2 long, shingles long")


def permutation(trie: int) -> np.ndarray:
    return np.random.default_rng(1000 + trie).permutation(BITS)[:64]


def prefix_masks(tries: int, depth: int) -> np.ndarray:
    """For each trie the bits of both halves of a sketch that its prefix holds."""
    held = np.zeros((tries, BITS), np.uint8)
    for t in range(tries):
        held[t, permutation(t)[:depth]] = 1
    return np.packbits(held, axis=1).view(np.int64)


def grown(texts: DataFrame, tries: int) -> DataFrame:
    """The forest: a row per text and trie."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [permutation(t) for t in range(tries)]
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.stack((batch.column("s1").to_numpy(), batch.column("s2").to_numpy()), 1)
            bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(len(s), 16), axis=1)
            for t, order in enumerate(orders):
                leaf = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").ravel().astype(np.uint64) ^ FLIP
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), t, np.int32)), pa.array(leaf.view(np.int64)), *(batch.column(c) for c in ("rep", "s1", "s2", "shingles", "c"))], names=["trie", "leaf", "rep", "s1", "s2", "shingles", "c"])

    return texts.select("rep", "s1", "s2", "shingles", "c").mapInArrow(grow, "trie int, leaf long, rep long, s1 long, s2 long, shingles long, c long")


def next_leaves(texts: DataFrame, tries: int, partitions: int, distance: int, similarity: float) -> DataFrame:
    """a, b, d: each leaf with the next one in order, but for those over a partition's end. A first pass; nothing rests on it."""
    order = ["trie", "leaf", "rep"]
    forest = grown(texts, tries).repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            now = [batch.column(n).to_numpy() for n in LEAF]
            rows = [np.concatenate(x) for x in zip(tail, now, strict=True)] if tail else now
            lo, hi = np.arange(len(rows[0]) - 1), np.arange(1, len(rows[0]))
            trie = rows[0]
            yield from _close(rows, *(x[trie[lo] == trie[hi]] for x in (lo, hi)), distance, similarity)
            tail = [x[-1:] for x in rows]

    return forest.select(*LEAF).mapInArrow(pair, "a long, b long, d long")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ. Unsigned, as bitwise_count counts the bits of the absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _close(rows: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, distance: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of the pairs of places those of different components, within the distance, and of lengths that allow the similarity."""
    _, rep, s1, s2, size, c = rows
    near = _differing(s1[lo], s1[hi]).astype(np.int64) + _differing(s2[lo], s2[hi])
    at = np.flatnonzero((near <= distance) & (c[lo] != c[hi]))
    lo, hi, near = lo[at], hi[at], near[at]
    at = np.flatnonzero(np.minimum(size[lo], size[hi]) >= similarity * np.maximum(size[lo], size[hi]))
    if len(at):
        x, y = rep[lo[at]], rep[hi[at]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(near[at])], schema=PAIRS)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have the similarity. sets: rep, held."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAIRS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, PAIRS_AT_ONCE)):
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity - 1e-12 for x, y in zip(*(batch.column(n).to_pylist() for n in ("ta", "tb")), strict=True)]
            keep = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            if keep.num_rows:
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], schema=schema)

    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("held").alias("ta")), "a")
    whole = left.join(sets.select(F.col("rep").alias("b"), F.col("held").alias("tb")), "b").select("a", "b", "ta", "tb")
    return whole.mapInArrow(check, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """rep, held (its shingles' hashes, ascending, as bytes) for the texts of the ids; equal texts of an id once."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    given = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text")).join(ids, "rep", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAIRS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, PAIRS_AT_ONCE)):
            held = [shingle_hashes(words_of(t.as_py())).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(map(xxhash.xxh3_128_digest, held), pa.binary()), pa.array(held, pa.binary())], names=["rep", "key", "held"])

    sets = given.mapInArrow(shingle, "rep long, key binary, held binary").filter("octet_length(held) > 0")
    return written(sets.repartition("rep").groupBy("rep", "key").agg(F.first("held").alias("held")).select("rep", "held"), "sets")


def dealt(forest: DataFrame, dense: DataFrame) -> DataFrame:
    """Leaves of dense prefixes (trie, prefix), dealt into parts: a row for each two parts that have to meet.

    A component with many leaves in a prefix has parts of its own, which needn't meet each other; all others share parts by
    their component. So a prefix whose leaves are nearly all linked costs in proportion to its leaves.
    """
    key = ["trie", "prefix"]
    leaves = forest.join(dense, key)
    sizes = leaves.groupBy(*key, "c").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("w"))
    parts = lambda n, w: F.greatest(F.ceil(n / MOST_LEAVES), F.ceil(w / MOST_SHINGLES)).cast("int")
    many = (F.col("n") > MOST_LEAVES // 4) | (F.col("w") > MOST_SHINGLES // 4)
    own = F.transform(F.array_sort(F.collect_list(F.when(many, F.struct("c", parts(F.col("n"), F.col("w")).alias("parts"))))), lambda o: F.struct(o["c"].alias("owner"), o["parts"].alias("parts")))
    shared = F.greatest(F.lit(1), parts(F.sum(F.when(~many, F.col("n")).otherwise(0)), F.sum(F.when(~many, F.col("w")).otherwise(0))))
    plan = sizes.groupBy(*key).agg(own.alias("own"), shared.alias("shared"))
    none = F.lit(None).cast("long")
    first = lambda i: F.col("shared") + F.aggregate(F.slice("own", 1, i), F.lit(0), lambda a, o: a + o["parts"])
    every = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("shared") - 1), lambda p: F.struct(p.alias("part"), none.alias("owner"))),
        F.flatten(F.transform("own", lambda o, i: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda p: F.struct((first(i) + p).alias("part"), o["owner"].alias("owner"))))),
    )
    plan = written(plan.select(*key, "shared", every.alias("every")), "dealt")
    mine = F.filter("every", lambda e: e["owner"] == F.col("c"))
    by = lambda what, n: F.pmod(F.xxhash64(what), n).cast("int")
    part = F.when(F.size("mine") > 0, F.get("mine", by("rep", F.size("mine")))["part"]).otherwise(by("c", F.col("shared")))
    met = leaves.join(plan, key).withColumn("mine", mine).withColumn("part", part)
    others = F.filter("every", lambda e: e["owner"].isNull() | (e["owner"] != F.col("c")))
    met = met.withColumn("other", F.explode(F.transform(others, lambda e: e["part"])))
    return met.select(*LEAF, "prefix", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))


def _by_unit(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """(unit, columns) of rows in the order of UNIT."""
    held: list[list] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        units = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in UNIT], 1)
        cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]).any(1)) + 1).tolist(), len(units)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            now = tuple(units[start].tolist())
            if now != key:
                if held:
                    yield key, [pa.concat_arrays(h) for h in zip(*held, strict=True)]
                held, key = [], now
            held.append([batch.column(n).slice(start, stop - start) for n in columns])
    if held:
        yield key, [pa.concat_arrays(h) for h in zip(*held, strict=True)]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= 1 << 14:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def candidates(forest: DataFrame, tries: int, depth: int, partitions: int, distance: int, similarity: float) -> DataFrame:
    """UNIT and rep: the leaves that have a candidate where they meet. forest: LEAF, prefix, part, x, y."""
    unit = list(UNIT)
    met = forest.repartition(partitions, *unit).sortWithinPartitions(*unit, "c", "rep")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = prefix_masks(tries, depth)
        for (trie, prefix, x, y), columns in _by_unit(batches, (*LEAF[1:], "part")):
            n = len(columns[0])
            if n < 2:
                continue
            rep, s1, s2, size, c, part = (a.to_numpy() for a in columns)
            has = np.zeros(n, bool)
            # Rows are in the order of components, so each tile begins behind the component of its first row.
            for at in range(0, n, TILE):
                stop = min(at + TILE, n)
                for left in range(int(np.searchsorted(c, c[at], "right")), n, TILE_ACROSS):
                    right = min(left + TILE_ACROSS, n)
                    near = _differing(s1[at:stop, None], s1[None, left:right]) + _differing(s2[at:stop, None], s2[None, left:right])
                    keep = (near <= distance) & (c[at:stop, None] < c[None, left:right])
                    if x != y:
                        keep &= part[at:stop, None] != part[None, left:right]
                    i, j = np.nonzero(keep)
                    i, j = i + at, j + left
                    fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
                    i, j = i[fits], j[fits]
                    if len(i):
                        one, two = s1[i] ^ s1[j], s2[i] ^ s2[j]
                        new = np.ones(len(i), bool)
                        for a, b in masks[:trie]:
                            new &= ((one & a) | (two & b)) != 0
                        has[i[new]] = has[j[new]] = True
            at = np.flatnonzero(has)
            if len(at):
                same = [pa.array(np.full(len(at), v), kind) for v, kind in zip((trie, prefix, x, y), (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(rep[at])], names=[*UNIT, "rep"])

    return met.mapInArrow(lambda batches: _together(meet(batches)), f"{UNIT_SQL}, rep long")


def compare(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Places of sets whose Jaccard similarity suffices, unless they are linked by earlier ones already."""
    n, size = len(sets), np.array(list(map(len, sets)), np.int64)
    ends = np.cumsum(size)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    group = np.arange(n)
    for i in range(n - 1):
        if not (group[i + 1 :] != group[i]).any():
            continue
        own = codes[ends[i] - size[i] : ends[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes[ends[i] :]], ends[i:-1] - ends[i])
        mark[own] = 0
        for j in (np.flatnonzero(both >= (similarity - 1e-12) * (size[i] + size[i + 1 :] - both)) + i + 1).tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                yield i, j


def links_of(met: DataFrame, sets: DataFrame, partitions: int, similarity: float) -> DataFrame:
    """a, b: links among the leaves (UNIT, rep) that meet, by their shingle sets; at most one per leaf."""
    unit = list(UNIT)
    rows = met.join(sets, "rep").repartition(partitions, *unit).sortWithinPartitions(*unit, "rep")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (rep, held) in _by_unit(batches, ("rep", "held")):
            ids = rep.to_numpy()
            pairs = [(ids[i], ids[j]) for i, j in compare([np.frombuffer(x.as_py(), np.uint64) for x in held], similarity) if ids[i] != ids[j]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*x), pa.int64()) if k == 0 else pa.array(np.maximum(*x), pa.int64()) for k, x in enumerate([np.array(pairs, np.int64).T] * 2)], names=["a", "b"])

    return rows.mapInArrow(lambda batches: _together(link(batches)), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = 0.8, recall: float = 0.99, reach: int = 32) -> DataFrame:
    """doc_id and class_id: one row per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(sketches(docs, text), "sketches")
    there = rows.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    texts = there.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("shingles").alias("shingles"))
    texts = written(texts.withColumn("c", F.col("rep")), "texts")
    n_texts = texts.count()
    tries, depth, distance = tries_for(n_texts, similarity, recall, reach), depth_for(n_texts, reach), distance_for(similarity)
    # Texts of one document are linked to begin with.
    shared = there.select("doc_id", "key").join(texts.select("key", "rep"), "key").filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = [shared.join(texts.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b")]

    def with_prefix(texts: DataFrame) -> DataFrame:
        return grown(texts, tries).withColumn("prefix", F.shiftright("leaf", 64 - depth) if depth else F.lit(0).cast("long"))

    forest = with_prefix(texts)
    dense = forest.groupBy("trie", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("w")).filter((F.col("n") > MOST_LEAVES) | (F.col("w") > MOST_SHINGLES))
    dense = written(dense.select("trie", "prefix"), "dense")
    if dense.limit(1).count():
        # Neighbours in the first tries are linked before, so that what is one group needn't meet itself in parts.
        pairs = written(next_leaves(texts, min(FIRST_TRIES, tries), partitions, distance, similarity).distinct(), "pairs")
        ids = written(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "ids")
        links.append(written(verified(pairs, shingle_sets(docs, ids, text), similarity), "verified"))
        labels = components(links[0].unionByName(links[1]))
        texts = written(texts.drop("c").join(labels, texts["rep"] == labels["v"], "left").select("key", "rep", "s1", "s2", "shingles", F.coalesce("c", "rep").alias("c")), "texts")
        forest = with_prefix(texts)
        parted = forest.join(dense, ["trie", "prefix"], "left_anti")
        forest = dealt(forest, dense)
    else:
        parted, forest = forest, None
    whole = parted.select(*LEAF, "prefix", *[F.lit(0).alias(n) for n in ("part", "x", "y")])
    met = written(candidates(whole.unionByName(forest) if forest is not None else whole, tries, depth, partitions, distance, similarity), "met")
    sets = shingle_sets(docs, written(met.select("rep").distinct(), "ids"), text)
    links.append(written(links_of(met, sets, partitions, similarity), "verified"))
    labels = components(functools.reduce(DataFrame.unionByName, links))
    classes = texts.select("key", "rep").join(labels, F.col("rep") == F.col("v"), "left").select("key", F.coalesce("c", "rep").alias("class_id"))
    out = rows.select("doc_id", "key").join(classes, "key", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"))
