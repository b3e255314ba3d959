"""A journal as Parquet tables in a folder: versioned, checked on opening, with migrations, backup and export."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.capture import cancellations_of, edges_of
from tidemark.runtime import dropped

VERSION = 5
SCHEMAS = {
    "events": "id string, event_type string, producer string, source string, source_ref string, session_id string, message_id string, role string, wing string, room string, privacy_scope string, status string, provenance_json string, content string, content_sha256 string, created_at string, captured_at string, metadata_json string, source_profile string, source_platform string, source_chat_id string, source_user_id string, source_topic_id string, source_session_id string, scope_kind string, authorization_version int, seq long",
    "supersessions": "superseded_event_id string, superseding_event_id string, recorded_at string",
    "cancellations": "superseded_event_id string, superseding_event_id string, cancellation_event_id string, recorded_at string",
    "projections": "projection_id string, event_id string, target string, status string, projected_at string, projection_ref string",
    "embeddings": "event_id string, model string, model_digest string, dimensions int, vector_sha256 string, vector array<double>, projected_at string",
    "documents": "doc_id string, content string, content_sha256 string, wing string, room string, source_file string, event_id string, indexed_at string, metadata_json string",
    "traces": "trace_id string, query_sha256 string, query_preview string, consumer string, session_id string, source string, result_ids array<string>, result_count int, created_at string",
    "served": "memory_key string, consumer string, session_id string",
    "grants": "grant_id string, event_id string, grantee_profile string, grantee_platform string, grantee_chat_id string, grantee_user_id string, grantee_topic_id string, grant_kind string, created_at string, expires_at string, authorization_version int",
    "proposals": "nonce string, payload_hash string, payload_json string, source_profile string, source_platform string, source_chat_id string, source_user_id string, source_topic_id string, session_key_hash string, source_session_id string, created_at string, expires_at string, consumed_at string, event_id string",
    "audits": "audit_id string, nonce string, payload_hash string, event_id string, source_profile string, source_platform string, source_chat_id string, source_user_id string, source_topic_id string, action string, created_at string",
}


class StoreUnavailable(RuntimeError):
    pass


class StoreInvalid(RuntimeError):
    pass


class JournalStore:
    """Tables in versions; a manifest names the one that holds for each. Writing goes through one driver."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        if "://" not in root and not root.startswith("/"):
            raise ValueError("the path must be absolute")
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        found = self._read_manifest()
        if found is None:
            if read_only:
                raise StoreUnavailable("memory_store_unavailable")
            found = {"version": VERSION, "tables": dict.fromkeys(SCHEMAS, -1)}
            self._write_manifest(found)
        if found["version"] > VERSION:
            raise StoreInvalid("the store is of a newer version")
        if read_only and (found["version"] != VERSION or set(SCHEMAS) - set(found["tables"])):
            raise StoreInvalid("memory_store_invalid")
        self.manifest = found
        if not read_only and (found["version"] < VERSION or set(SCHEMAS) - set(found["tables"])):
            found["tables"] = dict.fromkeys(SCHEMAS, -1) | found["tables"]
            found["version"] = VERSION
            self._write_manifest(found)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _read_manifest(self) -> dict | None:
        fs, path = self._fs(f"{self.root}/manifest")
        if not fs.exists(path):
            return None
        last = max((s.getPath().getName() for s in fs.listStatus(path)), default=None)
        if last is None:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{last}", wholetext=True).first()[0])

    def _write_manifest(self, found: dict) -> None:
        """A new file under the next number; it holds once it is renamed."""
        n = found.get("number", 0) + 1
        found["number"] = n
        fs, part = self._fs(f"{self.root}/manifest-{n:012d}.part")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        folder = self._fs(f"{self.root}/manifest")[1]
        fs.mkdirs(folder)
        if not fs.rename(part, self._fs(f"{self.root}/manifest/{n:012d}.json")[1]):
            raise StoreInvalid("another writer was faster")

    def read(self, name: str) -> DataFrame:
        n = self.manifest["tables"][name]
        if n < 0:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{n:06d}")

    def write(self, **tables: DataFrame) -> None:
        """New versions of some tables, which hold together once the manifest is there."""
        if self.read_only:
            raise StoreInvalid("the store is open for reading")
        changed = dict(self.manifest["tables"])
        for name, df in tables.items():
            changed[name] += 1
            target = self.spark.createDataFrame([], SCHEMAS[name]).unionByName(df.select(*[c for c in df.columns if c in {f.split()[0] for f in SCHEMAS[name].split(", ")}]), allowMissingColumns=True)
            target.write.parquet(f"{self.root}/{name}/{changed[name]:06d}")
        found = self.manifest | {"tables": changed}
        self._write_manifest(found)
        self.manifest = found

    def backfill_edges(self) -> None:
        """Edges and cancellations from the events' metadata, once each."""
        events = self.read("events")
        e = self.read("supersessions").unionByName(edges_of(events)).dropDuplicates(["superseded_event_id", "superseding_event_id"])
        c = self.read("cancellations").unionByName(cancellations_of(events)).dropDuplicates(["superseded_event_id", "superseding_event_id", "cancellation_event_id"])
        self.write(supersessions=e, cancellations=c)

    def check(self) -> dict[str, int]:
        """Row counts, after each table was read with its schema; ids must be there and single."""
        counts = {name: self.read(name).count() for name in SCHEMAS}
        twice = self.read("events").groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).count()
        if twice:
            raise StoreInvalid("an id occurs twice")
        return counts

    def backup(self, target: str) -> JournalStore:
        """A copy that is checked before and after; never onto something that is there."""
        fs, path = self._fs(target)
        if fs.exists(path):
            raise FileExistsError(target)
        before = self.check()
        copy = JournalStore(self.spark, target)
        copy.write(**{name: self.read(name) for name in SCHEMAS})
        if copy.check() != before:
            dropped(self.spark, target)
            raise StoreInvalid("the copy differs")
        return copy


def migrate_embeddings(rows: DataFrame) -> DataFrame:
    """Rows of the old form, with one digest column, to the present one."""
    return rows.withColumn("model_digest", F.lit("0" * 64)).withColumnRenamed("digest", "vector_sha256")


def export_before(events: DataFrame, before: str) -> DataFrame:
    """Events created before an instant (text, with an offset), in order."""
    if not re.search(r"T.*(Z|[+-]\d{2}:?\d{2})$", before):
        raise ValueError("the instant needs an offset")
    return events.filter(F.col("created_at") < before).orderBy("created_at", "id")


def export_jsonl(events: DataFrame, before: str, path: str) -> None:
    """One JSON object per line; the files of the folder are in order."""
    export_before(events, before).write.mode("errorifexists").json(path)


def sync_collection(documents: DataFrame, collection: DataFrame, projections: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """A full refresh from a collection (doc_id, content, wing, room, source_file): the new documents, and stale ids.

    A document belongs to the event that was last projected to its source file (ties: the greatest id).
    """
    from tidemark.operators.capture import upsert_documents

    refs = projections.filter("status = 'success' AND coalesce(projection_ref, '') <> ''").groupBy(F.col("projection_ref").alias("source_file")).agg(F.max(F.struct("projected_at", "event_id"))["event_id"].alias("event_id"))
    rows = collection.join(refs, "source_file", "left")
    stale = documents.select("doc_id").join(collection.select("doc_id"), "doc_id", "left_anti")
    return upsert_documents(documents.join(stale, "doc_id", "left_anti"), rows, at), stale


def documents_by_ids(documents: DataFrame, ids: DataFrame, events: DataFrame, superseded: DataFrame) -> DataFrame:
    """Documents of some ids, with whether the event they come from is superseded."""
    flags = superseded.select(F.col("id").alias("event_id"), F.lit(True).alias("__s"))
    # What a document says of its event itself stays.
    names = [(have, name) for have, name in (("source", "event_source"), ("session_id", "event_session_id")) if name not in documents.columns]
    linked = events.select(F.col("id").alias("event_id"), *[F.col(have).alias(name) for have, name in names])
    rows = documents.join(ids, "doc_id", "left_semi").join(linked, "event_id", "left").join(flags, "event_id", "left")
    return rows.withColumn("superseded", F.coalesce("__s", F.lit(False))).drop("__s")


def retrieval_trace(spark: SparkSession, trace_id: str, query: str, key: bytes, consumer: str, session_id: str, source: str, result_ids: list[str], at: str, preview: bool = False) -> DataFrame:
    """A trace of a search. The query itself isn't kept: its keyed digest is, and 240 characters if asked for."""
    from tidemark.functions.structured import keyed_digest

    row = (trace_id, keyed_digest(query, key), query[:240] if preview else "", consumer, session_id, source, result_ids, len(result_ids), at)
    return spark.createDataFrame([row], SCHEMAS["traces"])
