"""Session archive: save/upsert (K4), load (S4), lookup (S5), JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.json import decode_session, to_document
from parley.schemas import SESSION_FIELDS
from parley.sources import store
from parley.sources.files import scan_text


class StorageError(Exception):
    """A stored session that cannot be decoded."""


class SessionNotFound(Exception):
    """No session has the id."""


def session_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in SESSION_FIELDS])


def to_json_documents(sessions: DataFrame, *keep: str) -> DataFrame:
    """(session_id, [kept columns,] document): one JSON document per session."""
    return sessions.select("session_id", *keep, to_document(session_struct(sessions)).alias("document"))


def from_json_documents(docs: DataFrame, doc_col: str = "document") -> DataFrame:
    """Decode documents; adds ``_s`` (the session), ``status`` found | corrupt, and
    ``error``, which names the required fields that are missing."""
    parsed = docs.withColumn("_d", decode_session(F.col(doc_col)))
    found = F.col("_d.error").isNull()
    return parsed.select(*docs.columns, F.when(found, F.col("_d.session")).alias("_s"),
                         F.when(found, F.lit("found")).otherwise(F.lit("corrupt")).alias("status"),
                         F.col("_d.error").alias("error"))


def upsert(existing: DataFrame, updates: DataFrame, version_col: str = "version") -> DataFrame:
    """K4: the latest version of every session id in either input, one row each."""
    return store.one_per_key(existing.unionByName(updates), "session_id", (version_col,))


ORDER = ("version", "run_id")


def save_sessions(new: DataFrame, path: str, version_col: str = "version", run_id: str | None = None, buckets: int | None = None) -> str:
    """K4 on storage: one run of the archive at ``path`` with the latest version of
    each id in ``new``: the document, and the presentation and Q&A texts where
    they are not null. One file per bucket of ids."""
    texts = new.select("session_id", F.col(version_col).cast("long").alias("version"), "presentation_text", "structured_qa_text",
                       to_document(session_struct(new)).alias("document"))
    return store.write_keyed(texts, path, "session_id", run_id, buckets, last_by=("version",))


def archive(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """The latest row of each archived session: all of it, or ``columns`` of it, which spares moving the documents."""
    return store.latest(store.read_runs(spark, path), "session_id", ORDER, columns or None)


def compact(spark: SparkSession, path: str) -> str:
    """Merge all finished runs of the archive into one file per bucket."""
    return store.compact(spark, path, "session_id", ORDER)


def load_sessions(spark: SparkSession, path: str, listing: str = "all") -> DataFrame:
    """Session JSON files, one document each: (file, status, error, session).
    Files that cannot be decoded are rows too, never dropped; the text files beside them are no sessions."""
    raw = scan_text(spark, path, "*.json", listing).select(F.col("path").alias("file"), F.col("text").alias("document"))
    return from_json_documents(raw).select("file", "status", "error", F.col("_s").alias("session"))


def lookup(requests: DataFrame, stored: DataFrame, id_col: str = "session_id", doc_col: str = "document") -> DataFrame:
    """S5 in batch form: every requested id with status found / not_found /
    corrupt and the decoded session (NULL unless found). Only hits are decoded."""
    s = stored.select(F.col(id_col).alias("_id"), F.col(doc_col).alias("_doc"))
    hits = from_json_documents(requests.join(s, requests[id_col] == s["_id"], "left"), "_doc")
    status = F.when(F.col("_id").isNull(), F.lit("not_found")).otherwise(F.col("status"))
    return hits.select(id_col, status.alias("status"), F.when(status == "found", F.col("_s")).alias("session"))


def lookup_in(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """S5 on storage, in batch form: only rows with a requested id, in its bucket, are reduced and decoded."""
    wanted = requests.select("session_id").distinct()
    wanted = wanted.select(F.col("session_id").alias("_want"), store.bucket(F.col("session_id"), store.buckets_of(spark, path)).alias("_bucket"))
    rows = store.read_runs(spark, path)
    rows = rows.join(wanted, (rows["bucket"] == wanted["_bucket"]) & (rows["session_id"] == wanted["_want"]), "left_semi")
    return lookup(requests, store.latest(rows, "session_id", ORDER))


def stored_versions(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """All stored rows of one session; reads the files of the id's bucket only."""
    b = store.bucket(F.lit(session_id), store.buckets_of(spark, path))
    return store.read_runs(spark, path).where((F.col("bucket") == b) & (F.col("session_id") == session_id))


def lookup_one(spark: SparkSession, path: str, session_id: str):
    """One session as a Row."""
    rows = stored_versions(spark, path, session_id)
    hit = from_json_documents(rows.orderBy(*[F.desc(c) for c in ORDER]).limit(1)).select("status", "error", "_s").collect()
    if not hit:
        raise SessionNotFound(session_id)
    if hit[0].status != "found":
        raise StorageError(f"{session_id}: {hit[0].error}")
    return hit[0]["_s"]
