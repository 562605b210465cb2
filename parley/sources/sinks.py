"""Stage sinks (K1-K3): one row per key and run; reading takes each key's latest
run, so rerunning a subset of inputs leaves all other results in place. Tables are keyed (a file per bucket and run) and can be compacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.json import to_document
from parley.operators.incremental import PRESENTATION_SUFFIX, QA_SUFFIX
from parley.operators.summary import render_report
from parley.sources import store
from parley.sources.named_files import write_files


def write_transcripts(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """K1: (stem, raw_text, segments, language)."""
    out = df.select("stem", "transcript.raw_text", "transcript.segments", "transcript.language")
    return store.write_keyed(out, path, "stem", run_id, last_by=())


def write_structure(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """K2: presentation and structured Q&A text of each stem, one table."""
    out = df.select("stem", "presentation_text", "structured_qa_text")
    return store.write_keyed(out, path, "stem", run_id, last_by=())


def summary_outputs(df: DataFrame) -> DataFrame:
    """K3 rows: (base, summary_json, summary_txt). JSON keeps explicit nulls
    and non-ASCII text; the text form is the T12 report."""
    s = F.struct("content", "key_points", "action_items", "topics")
    return df.select("base", to_document(s).alias("summary_json"),
                     render_report(F.col("content"), F.col("key_points"), F.col("action_items"),
                                   F.col("topics")).alias("summary_txt"))


def write_summaries(df: DataFrame, path: str, run_id: str | None = None) -> str:
    """K3: both summary artefacts per base name."""
    return store.write_keyed(summary_outputs(df), path, "base", run_id, last_by=())


def read_outputs(spark: SparkSession, path: str, key: str = "stem", *columns: Column) -> DataFrame:
    """The latest output of each key: all of it, or the key and ``columns`` of it, which spares moving the rest."""
    wanted = [F.col(key), *columns] if columns else None
    return store.latest(store.read_runs(spark, path), key, columns=wanted).drop("run_id", "bucket")


def _files(df: DataFrame, *pairs) -> DataFrame:
    """(name, content) of each (name, content) pair of a row; no file where the content is null."""
    items = F.filter(F.array(*[F.struct(n.alias("name"), c.alias("content")) for n, c in pairs]), lambda x: x["content"].isNotNull())
    return df.select(F.explode(items).alias("f")).select("f.*")


def export_transcripts(df: DataFrame, folder: str) -> None:
    """K1 as files: ``<stem>.txt`` with the raw text of (stem, raw_text)."""
    write_files(_files(df, (F.concat("stem", F.lit(".txt")), F.col("raw_text"))), folder)


def export_structure(df: DataFrame, folder: str, key: str = "stem") -> None:
    """K2 as files: ``<stem>_presentation.txt`` and ``<stem>_q_and_a.txt``; an empty text is a file, a missing one is none."""
    write_files(_files(df, (F.concat(key, F.lit(f"{PRESENTATION_SUFFIX}.txt")), F.col("presentation_text")),
                       (F.concat(key, F.lit(f"{QA_SUFFIX}.txt")), F.col("structured_qa_text"))), folder)


def export_summaries(df: DataFrame, folder: str) -> None:
    """K3 as files: ``<base>_summary.json`` and ``<base>_summary.txt`` of (base, summary_json, summary_txt)."""
    write_files(_files(df, (F.concat("base", F.lit("_summary.json")), F.col("summary_json")),
                       (F.concat("base", F.lit("_summary.txt")), F.col("summary_txt"))), folder)


def export_sessions(rows: DataFrame, folder: str) -> None:
    """K4 as files, from rows of the archive: ``<session_id>.json`` and the two text files."""
    write_files(_files(rows, (F.concat("session_id", F.lit(".json")), F.col("document"))), folder)
    export_structure(rows, folder, "session_id")
