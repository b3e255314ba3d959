"""WARC writing, normalising and reading.

``write_archives`` puts each task's records into archives that are one gzip stream each. ``normalise_archives`` inflates
each of these streams once, rewrites every record as a gzip member of its own and writes a sidecar index of the members'
offsets. ``read_archives`` reads the members through the index and checks every payload against its digest.

Files carry a random name and count only if the table that a successful task returned names them; a task that ran twice,
or died, leaves at most files that nothing refers to. All of them lie in the shared folder.

Records with equal payloads (SHA-1, xxhash64 and length) of at least ``revisit_from`` bytes: the largest id is the
response, the others are revisits that refer to it and hold no payload. The payloads' digests alone are grouped, partly
before the shuffle, so that a payload with very many copies costs no more than others.

Defined results: a null payload is empty; a null url is written as an empty target; control characters in urls are
percent-encoded; rows that repeat the largest id are all responses; a null id never is the one referred to, and is a
revisit if another row of its group has an id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import dropped, fresh_path, ship, written

URN = "urn:tidemark:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 20


def record_kinds(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    payload = F.encode(F.coalesce("payload", F.lit("")), "UTF-8") if dict(pages.dtypes)["payload"] != "binary" else F.coalesce("payload", F.lit(b""))
    keyed = pages.select("id", "url", payload.alias("payload")).select(
        "id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.xxhash64("payload").alias("second")
    )
    key = ["payload_digest", "second", "payload_bytes"]
    groups = keyed.filter(F.col("payload_bytes") >= revisit_from).groupBy(*key).agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = keyed.join(groups, key, "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    out = joined.withColumn("refers_to", refers)
    return out.select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def warc_record(rid: int | None, url: str | None, payload: bytes | None, n_bytes: int, sha1_hex: str, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'null' if rid is None else rid}>",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; the payload and its length are checked against the digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda x: None if x is None or x.endswith(":null>") else int(x.removeprefix(f"<{URN}").removesuffix(">"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its digest")
    return {"id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None, "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


class _Archive:
    """An archive that is one gzip stream."""

    def __init__(self, folder: str, level: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, name = pafs.FileSystem.from_uri(self.path)
        self.out, self.zip = fs.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
        self.records = self.bytes = 0

    def add(self, record: bytes) -> None:
        self.out.write(self.zip.compress(record))
        self.records, self.bytes = self.records + 1, self.bytes + len(record)

    def close(self) -> dict:
        self.out.write(self.zip.flush())
        self.out.close()
        return {"archive": self.path, "records": self.records}


def write_archives(kinds: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", level: int = 1, most_bytes: int = 128 << 20) -> DataFrame:
    """Writes what record_kinds() returned; one row per archive. A task starts another archive after most_bytes."""
    ship(kinds.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for i in range(batch.num_rows):
                archive = archive or _Archive(folder, level)
                archive.add(warc_record(*(c[i].as_py() for c in columns), date))
                if archive.bytes >= most_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return written(kinds.mapInArrow(write, "archive string, records long"), "warc-archives")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time."""
    have = bytearray()
    for piece in pieces:
        have += piece
        while True:
            end = have.find(b"\r\n\r\n")
            if end < 0:
                break
            length = int(re.search(rb"\r\nContent-Length: (\d+)", have[:end])[1])
            whole = end + 4 + length + 4
            if len(have) < whole:
                break
            yield bytes(have[:whole])
            del have[:whole]
    if have:
        raise ValueError("the stream ends within a record")


def _inflated(source) -> Iterator[bytes]:
    """The whole stream, inflated once; members that follow each other count as one stream."""
    unzip = zlib.decompressobj(31)
    while part := source.read(PIECE):
        while part:
            yield unzip.decompress(part)
            part = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    yield unzip.flush()


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites archives record by record; one row per archive with its index: (offset, length) of each member, as u64."""
    ship(archives.sparkSession)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                to, to_name = pafs.FileSystem.from_uri(target)
                offset, n = 0, 0
                with fs.open_input_stream(name, compression=None) as source, to.open_output_stream(to_name, compression=None) as out, to.open_output_stream(f"{to_name}.idx") as index:
                    for record in split_records(_inflated(source)):
                        zip_ = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = zip_.compress(record) + zip_.flush()
                        out.write(member)
                        index.write(json.dumps([offset, len(member)]).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pylist([{"archive": target, "records": n}], pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    n = archives.count()
    return written(archives.select("archive").repartition(max(1, n)).mapInArrow(normalise, "archive string, records long"), "warc-normal")


READ_SCHEMA = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(normal: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of normalised archives, read member by member at the offsets of the index."""
    ship(normal.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, size, seen = [], 0, 0
                with fs.open_input_file(name) as source, fs.open_input_stream(f"{name}.idx") as index:
                    for line in index.read().splitlines():
                        offset, length = json.loads(line)
                        row = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                        size, seen = size + len(row["payload"] or b""), seen + 1
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= 2000 or payloads and size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return normal.repartition(max(1, normal.count())).mapInArrow(read, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """Writes id, url and payload to archives, normalises these and returns the table of the normal ones."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{name}/whole", recursive=True)
    fs.create_dir(f"{name}/normal", recursive=True)
    archives = write_archives(record_kinds(pages, revisit_from), f"{folder}/whole")
    normal = normalise_archives(archives, f"{folder}/normal")
    dropped(spark, f"{folder}/whole")
    return normal
