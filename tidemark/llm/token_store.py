"""Token ids in a content-addressed store.

Each document's id stream (its ids and an end id) is cut into chunks where a rolling hash over the last 16 ids has its low
bits zero, so equal passages give equal chunks wherever they stand. A chunk's name is the SHA-256 of its ids' bytes. The store
is a folder with

``packs/``      files of chunks one behind the other: ids, little-endian, 16 or 32 bits, a zstd frame each
``chunks/``     Parquet of unique chunks: name, pack, at, size; each is stored once
``recipes/``    Parquet of documents, sorted by doc_id over all files: doc_id, start, n_tokens, the names of its chunks as
                one binary, and the Merkle root over them
``parts/``      Parquet of one row per file of recipes: its documents, ids, and the Merkle root over its documents' roots
``manifest``    one row: format, width, counts, and the Merkle root over the roots of the parts

Tokenising happens once: a first job writes packs of the chunks that are new within a task, and their names and places as a
table. Of each name one place stays; a second job copies these into the final packs. Chunks themselves are never shuffled,
and names only once per task, so a text with very many copies costs no more than others. Packs carry random names and count
only if the table that a successful task returned names them. Reading compares recipes with parts and manifest, looks the
places of each document's chunks up, reads them in order of their places, and ``ids_bytes`` verifies each chunk's name and
each document's root.

Encoding: results of the tokenizers library are kept per space-separated word in a dictionary of bounded size in each
worker (``WordEncoder``). ``encode_whole`` is the plain call, for comparison.

Defined results: a null or empty text has the end id only; a null doc_id comes first; rows that share a doc_id follow each
other in the order of their digests; an empty table gives a store without rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import IRREGULAR_SPACE
from tidemark.runtime import dropped, fresh_path, ship, written

WINDOW = 16
CACHE_WORDS = 800_000
TEXTS_AT_ONCE = 512
PACK_BYTES = 64 << 20
#: Places in a pack with at most so many bytes between them are read at once.
GAP = 1 << 16
ROWS_AT_ONCE = 1024
IDS_AT_ONCE = 1_000_000


def gear_table(vocabulary: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number per id (splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.arange(1, vocabulary + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each place the hash of the last 16 ids: the sum of their numbers, each shifted by its distance. By doubling."""
    h, width = gear[ids], 1
    while width < WINDOW:
        shifted = h.copy()
        shifted[width:] += h[:-width] << np.uint64(width) if len(h) > width else 0
        h, width = shifted, width * 2
    return h


def cut(ids: np.ndarray, gear: np.ndarray, bits: int = 9, least: int = 64, most: int = 4096) -> list[int]:
    """The ends of the chunks: 2**bits ids on average, at least and at most so many (the last may be shorter)."""
    return ends_of(len(ids), low_places(ids, gear, bits).tolist() if len(ids) > least else [], least, most)


def low_places(ids: np.ndarray, gear: np.ndarray, bits: int = 9) -> np.ndarray:
    """The places behind an id where the hash's bits are zero."""
    return np.flatnonzero(rolling(ids, gear) >> np.uint64(64 - bits) == 0) + 1


def ends_of(n: int, places: list[int], least: int = 64, most: int = 4096) -> list[int]:
    """The ends of the chunks of n ids, from the places where the hash's bits are zero."""
    if n <= least:
        return [n]
    ends, start = [], 0
    for p in places:
        while p - start > most:
            start += most
            ends.append(start)
        if p - start >= least:
            ends.append(p)
            start = p
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def merkle(names: list[bytes]) -> bytes:
    """The root over names; an odd one goes up unchanged. Leaves and nodes are marked, so neither can pass for the other."""
    level = [hashlib.sha256(b"\0" + n).digest() for n in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if it is printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in plain)
    return {b: chr(256 + n) for n, b in enumerate(other)}


BYTE_SIGNS = _byte_signs()


class WordEncoder:
    """Encodes texts to the bytes of their ids (u32, little-endian) as the tokenizers library does.

    A space between two characters that are no white space always begins a piece of the byte-level pattern. So words
    between such spaces can be encoded apart, and are kept. The words of a batch of texts that aren't known yet go to the
    library as one text; as each token stands for as many bytes as it has signs, its ids are dealt back to the words.
    A text with other white space beside a space goes to the library whole.
    """

    MARKS = ".,;"
    OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.most = most
        self.words: dict[str, bytes] = {}
        # The model alone is much quicker for single words; so plain letters, and a mark after them, go to it as bytes.
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" abc, d\u00e9.")] if self.tokenizer.pre_tokenizer else []
        self.lettered = self.tokenizer.normalizer is None and pieces == ["\u0120abc", ",", "\u0120d\u00c3\u00a9", "."]
        self.marks = dict(zip(self.MARKS, (x.tobytes() for x in self.plain(list(self.MARKS))), strict=True))

    def plain_word(self, word: str) -> bytes | None:
        """The ids of a space and a word of Latin letters, with one of MARKS behind them or not; else null."""
        if not self.lettered:
            return None
        core, mark = word, b""
        if not word.isalpha():
            core, mark = word[:-1], self.marks.get(word[-1:])
            if mark is None or not core.isalpha():
                return None
            if (ids := self.words.get(core)) is not None:
                return ids + mark
        if core.isascii():
            signs = "\u0120" + core
        elif max(core) < "\u0250":
            signs = "\u0120" + core.encode().decode("latin-1").translate(BYTE_SIGNS)
        else:
            return None
        ids = array("I", [t.id for t in self.model.tokenize(signs)])
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes() + mark

    def irregular(self, text: str) -> bool:
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return True
        return bool(self.OTHER_SPACE.search(text)) and bool(IRREGULAR_SPACE.search(text))

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids = self.plain([" " + " ".join(some)])[0]
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in some), np.int64, len(some)))
            have = np.cumsum(self.token_bytes[ids])
            cuts = np.searchsorted(have, ends)
            if not np.array_equal(have[cuts], ends):
                raise ValueError("a token runs over a space")
            data, start = ids.tobytes(), 0
            for w, stop in zip(some, ((cuts + 1) * 4).tolist(), strict=True):
                self.words[w] = data[start:stop]
                start = stop

    def encode_many(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if t and self.irregular(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, self.plain([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        skip = set(whole)
        if len(self.words) > self.most:
            self.words.clear()
        words, get = self.words, self.words.get
        parts, later, hard = [], [], set()
        for i, t in enumerate(texts):
            if not t or i in skip:
                continue
            first, *rest = t.split(" ")
            found = list(map(get, rest))
            parts.append((i, first, found))
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        word = rest[k]
                        if (ids := get(word)) is None and word not in hard and (ids := self.plain_word(word)) is not None:
                            words[word] = ids
                        if ids is None:
                            hard.add(word)
                            later.append((found, k, word))
                        else:
                            found[k] = ids
        self._learn(sorted(hard))
        for found, k, word in later:
            found[k] = words[word]
        for (i, _, found), head in zip(parts, self.plain([first for _, first, _ in parts]), strict=True):
            out[i] = head.tobytes() + b"".join(found)
        return out


def encode_whole(path: str, text: str) -> list[int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


@functools.lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    return WordEncoder(path)


@functools.lru_cache(2)
def _gear(vocabulary: int) -> np.ndarray:
    return gear_table(vocabulary)


def _places_of(streams: list[bytes], gear: np.ndarray) -> Iterator[list[int]]:
    """low_places() of each stream, of many at once: where ids of the stream before are within the window, no chunk may end."""
    at = 0
    while at < len(streams):
        size, stop = len(streams[at]), at + 1
        while stop < len(streams) and size + len(streams[stop]) <= IDS_AT_ONCE * 4:
            size, stop = size + len(streams[stop]), stop + 1
        places = low_places(np.frombuffer(b"".join(streams[at:stop]), "<u4"), gear)
        ends = np.cumsum([len(x) // 4 for x in streams[at:stop]])
        cuts = [0, *np.searchsorted(places, ends, "right").tolist()]
        for i, start in enumerate([0, *ends[:-1].tolist()]):
            yield (places[cuts[i] : cuts[i + 1]] - start).tolist()
        at = stop


STAGED = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("root", pa.binary()), ("name", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
STAGED_SQL = "kind tinyint, doc_id long, n_tokens long, names binary, root binary, name binary, pack string, at long, size long"
PLACES_SQL = "name binary, pack string, at long, size long"


class _Packs:
    """Writes chunks into packs of at most PACK_BYTES in a folder; add() returns a chunk's place."""

    def __init__(self, folder: str):
        self.folder, self.out, self.at = folder, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= PACK_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.pack", 0
            fs, path = pafs.FileSystem.from_uri(f"{self.folder}/{self.name}")
            self.out = fs.open_output_stream(path, compression=None, buffer_size=1 << 20)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Places:
    """Reads places of packs in a folder: sorted, and near ones at once."""

    def __init__(self, folder: str):
        self.folder, self.name, self.source = folder, None, None

    def _bytes(self, pack: str, at: int, stop: int) -> bytes:
        if pack != self.name:
            self.close()
            fs, path = pafs.FileSystem.from_uri(f"{self.folder}/{pack}")
            self.name, self.source = pack, fs.open_input_file(path)
        return self.source.read_at(stop - at, at)

    def read(self, wanted: set[tuple[str, int, int]]) -> dict[tuple[str, int, int], bytes]:
        out, run = {}, []

        def done() -> None:
            if run:
                base = run[0][1]
                data = self._bytes(run[0][0], base, max(at + size for _, at, size in run))
                out.update((p, data[p[1] - base : p[1] - base + p[2]]) for p in run)

        for place in sorted(wanted):
            if run and (place[0] != run[-1][0] or place[1] > run[-1][1] + run[-1][2] + GAP or place[1] - run[0][1] > 8 << 20):
                done()
                run = []
            run.append(place)
        done()
        return out

    def close(self) -> None:
        if self.source is not None:
            self.source.close()
            self.name, self.source = None, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", files: int | None = None) -> str:
    """Encodes doc_id and text, and writes a store; returns its folder."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "token-store")
    width = 2 if end_id < 1 << 16 and _vocabulary(tokenizer) <= 1 << 16 else 4
    fs, path = pafs.FileSystem.from_uri(folder)
    for name in ("staged-packs", "packs"):
        fs.create_dir(f"{path}/{name}", recursive=True)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = _encoder(tokenizer), max(_vocabulary(tokenizer), end_id + 1)
        gear, end, seen = _gear(vocabulary), np.array([end_id], "<u4").tobytes(), set()
        rows: list[tuple] = []
        packs, zipper = _Packs(f"{folder}/staged-packs"), zstandard.ZstdCompressor(level=1)
        for batch in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
            streams = [x + end for x in encoder.encode_many([t or "" for t in batch.column("text").to_pylist()])]
            for doc_id, stream, places in zip(batch.column("doc_id").to_pylist(), streams, _places_of(streams, gear), strict=True):
                ids = np.frombuffer(stream, "<u4")
                data = ids.astype("<u2").tobytes() if width == 2 else stream
                names, start = [], 0
                for stop in ends_of(len(ids), places):
                    part = data[start * width : stop * width]
                    name, start = hashlib.sha256(part).digest(), stop
                    names.append(name)
                    if name not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(name)
                        rows.append((1, None, None, None, None, name, *packs.add(zipper.compress(part))))
                rows.append((0, doc_id, len(ids), b"".join(names), merkle(names), None, None, None, None))
            if len(rows) > 1 << 14:
                yield _batch(rows, STAGED)
                rows = []
        packs.close()
        if rows:
            yield _batch(rows, STAGED)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, places = _Packs(f"{folder}/packs"), _Places(f"{folder}/staged-packs")
        schema = pa.schema([STAGED.field(n) for n in ("name", "pack", "at", "size")])
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("name", "pack", "at", "size")), strict=True))
            found = places.read({r[1:] for r in rows})
            yield _batch([(r[0], *packs.add(found[r[1:]])) for r in rows], schema)
        packs.close()
        places.close()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    staged = f"{folder}/staged"
    given.mapInArrow(stage, STAGED_SQL).write.partitionBy("kind").option("compression", "zstd").parquet(staged)

    def part(kind: int, *columns: str) -> DataFrame:
        return spark.read.schema(STAGED_SQL).option("basePath", staged).parquet(staged).filter(F.col("kind") == kind).select(*columns)

    partitions = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Of a name that several tasks wrote, the least place stays.
    kept = part(1, "name", "pack", "at", "size").groupBy("name").agg(F.min(F.struct("pack", "at", "size")).alias("x")).select("name", "x.*")
    ordered = kept.repartitionByRange(partitions, "pack", "at").sortWithinPartitions("pack", "at")
    ordered.mapInArrow(copy, PLACES_SQL).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    _write_recipes(part(0, "doc_id", "n_tokens", "names", "root"), folder, partitions)
    dropped(spark, staged, f"{folder}/staged-packs")
    _parts(spark, folder).write.parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts").orderBy("part").collect()  # one for each file of recipes
    row = (1, width, sum(r["documents"] for r in parts), sum(r["ids"] for r in parts), merkle([bytes(r["root"]) for r in parts]))
    spark.createDataFrame([row], "format int, width int, documents long, ids long, root binary").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def _write_recipes(recipes: DataFrame, folder: str, files: int) -> None:
    """Sorts by doc_id over all files and adds the running start, by the sums of the files before."""
    spark = recipes.sparkSession
    ordered = recipes.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ranged = written(ordered.withColumn("part", F.spark_partition_id()), "recipes")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("inner", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(F.broadcast(sums), "part")
    placed.select("part", "doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "names", "root").sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    dropped(spark, *{f.rpartition("/")[0] for f in ranged.inputFiles()[:1]})


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """part, documents, ids and the Merkle root over the documents' roots, from the recipes."""
    schema = pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roots, ids = None, [], 0
        for batch in batches:
            for part, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                if part != now:
                    if now is not None:
                        yield _batch([(now, len(roots), ids, merkle(roots))], schema)
                    now, roots, ids = part, [], 0
                roots.append(root)
                ids += n
        if now is not None:
            yield _batch([(now, len(roots), ids, merkle(roots))], schema)

    recipes = spark.read.parquet(f"{folder}/recipes").select("part", "start", "n_tokens", "root")
    return recipes.repartition("part").sortWithinPartitions("part", "start").mapInArrow(sum_up, "part int, documents long, ids long, root binary")


def _vocabulary(path: str) -> int:
    return _encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)


def verify_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest, after the recipes are compared with the parts, and the parts with it."""
    manifest = spark.read.parquet(f"{folder}/manifest").first().asDict()
    stored = spark.read.parquet(f"{folder}/parts").orderBy("part").collect()
    there = _parts(spark, folder).orderBy("part").collect()  # one for each file of recipes, as stored
    if stored != there or merkle([bytes(r["root"]) for r in stored]) != bytes(manifest["root"]) or (sum(r["documents"] for r in there), sum(r["ids"] for r in there)) != (manifest["documents"], manifest["ids"]):
        raise ValueError(f"the recipes of {folder} don't match their manifest")
    return manifest


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, names, root, chunks (array of binary, in order) and width, from the files alone."""
    ship(spark)
    width = verify_manifest(spark, folder)["width"]
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "n_tokens", "names", "root")
    index = spark.read.parquet(f"{folder}/chunks").select("name", "pack", "at", "size")
    count = F.floor(F.octet_length("names") / 32).cast("int")
    wanted = recipes.select("start", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("names"), i * 32 + 1, F.lit(32)))).alias("n", "name"))
    found = wanted.join(index, "name", "left").select("start", F.struct("n", "pack", "at", "size").alias("place"))
    by_document = found.groupBy("start").agg(F.sort_array(F.collect_list("place")).alias("places"))
    placed = recipes.join(by_document, "start").sortWithinPartitions("start")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("root", pa.binary()), ("chunks", pa.list_(pa.binary())), ("width", pa.int32())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(f"{folder}/packs")
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            held = batch.column("places")
            flat = held.flatten()
            # A name that the index lacks stays null, and is found when the document is verified.
            each = [None if p is None else (p, at, size) for p, at, size in zip(*(flat.field(n).to_pylist() for n in ("pack", "at", "size")), strict=True)]
            data = places.read({x for x in each if x is not None})
            chunks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy()))), pa.int32()), pa.array([data.get(x) for x in each], pa.binary()))
            columns = [batch.column(n) for n in ("doc_id", "start", "n_tokens", "names", "root")]
            yield pa.RecordBatch.from_arrays([*columns, chunks, pa.array(np.full(batch.num_rows, width, np.int32))], schema=schema)
        places.close()

    return placed.mapInArrow(fetch, "doc_id long, start long, n_tokens long, names binary, root binary, chunks array<binary>, width int")


def ids_bytes(row: dict) -> bytes:
    """The ids of a document as u32, little-endian, after its chunks' names, its root and its length are verified."""
    names = [row["names"][i : i + 32] for i in range(0, len(row["names"]), 32)]
    unzip = zstandard.ZstdDecompressor()
    chunks = [unzip.decompress(c) if c is not None else b"" for c in row["chunks"]]
    data = b"".join(chunks)
    if [hashlib.sha256(c).digest() for c in chunks] != names or merkle(names) != row["root"] or len(data) != row["width"] * row["n_tokens"]:
        raise ValueError(f"document {row['doc_id']} doesn't match its names or root")
    return np.frombuffer(data, "<u2").astype("<u4").tobytes() if row["width"] == 2 else data


def checked_crc(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the verified ids."""
    ship(read.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                data = ids_bytes(x)
                rows.append({"doc_id": x["doc_id"], "start": x["start"], "n_tokens": x["n_tokens"], "ids_crc32": zlib.crc32(data)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
