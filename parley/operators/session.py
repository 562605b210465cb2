"""Session-document operators (P4-P11, A1 via ``ordered``, E1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import is_blank


def segment_progress(end_time: Column, duration: Column) -> Column:
    """``min(100, end / duration * 100)``; NULL when the duration is
    missing or zero (providers without timings report 0.0)."""
    return F.least(F.lit(100.0), F.lit(100.0) * end_time / F.nullif(duration.cast("double"), F.lit(0.0)))


def summary_input(qa_text: Column, raw_text: Column) -> Column:
    """The Q&A text when it is non-empty, else the transcript's raw text.

    A whitespace-only Q&A text counts as present (and then fails P4)."""
    return F.coalesce(F.nullif(qa_text, F.lit("")), raw_text)


def require_text(text: Column) -> Column:
    """Error class for a text that cannot be processed, else NULL."""
    return F.when(is_blank(text), F.lit("EmptyText"))


def init_session(path: Column, modified: Column, title: Column, now: Column | None = None) -> Column:
    """P5: struct(session_id, created_at, title). The id is derived from the whole path
    and the time of the file (replay-safe, unlike a random UUID); an empty or
    missing title falls back to the stem; ``now`` defaults to the current time."""
    from parley.operators.incremental import stem

    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(F.sha2(F.concat_ws("|", path, F.unix_micros(modified).cast("string")), 256).alias("session_id"),
                    (F.current_timestamp() if now is None else now).alias("created_at"),
                    F.coalesce(F.nullif(title, F.lit("")), stem(name)).alias("title"))


def with_transcript(df, transcript: Column):
    """Copy of each session with the transcript replaced, other parts kept."""
    return df.withColumn("transcript", transcript)


def with_structure(df, presentation: Column, structured_qa: Column):
    """Presentation and structured Q&A replaced together."""
    return df.withColumn("presentation_text", presentation).withColumn("structured_qa_text", structured_qa)


def with_summary(df, summary: Column):
    """Summary replaced."""
    return df.withColumn("summary", summary)


def with_title(df, title: Column):
    """P9 on a nested field: ``Column.withField`` rewrites one struct field."""
    return df.withColumn("metadata", F.col("metadata").withField("title", title))
