"""Registered queries vs their DuckDB twins on the smallest scale factor."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

FAST = ["normalised_words", "wer_macro", "qa_blocks", "qa_runs", "qa_render", "assemble_transcript",
        "segment_progress", "skip_done", "run_report", "presentation_split", "verbatim", "summary_report",
        "parse_response", "vocabulary_hits", "leaderboard", "best_model", "session_load", "sink_rerun",
        "stage_rerun", "provider_replies", "session_lookup", "session_upsert", "session_status", "archive_compact", "pipeline_modes",
        "pipeline_log", "exported_files", "session_now", "verbatim_distance", "target_index", "sql_qa_runs", "sql_blocks", "sql_wer",
        "stream_chain", "stream_split", "stream_replay", "stream_transcribe", "stream_summaries", "transcribe_plain", "source_validation"]


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fmt = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    lines = sorted("|".join(fmt(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "events", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    drows = rel.fetchall()
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(rel.columns, drows)


@pytest.mark.parametrize("name", ["leaderboard", "best_model"])
def test_pairs_are_scored_once(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("levenshtein(") == 1


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["case_name", "m1", "m2", "m3"]
