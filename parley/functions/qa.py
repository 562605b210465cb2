"""Labelled Q&A text as arrays of blocks (T5-T7, T10, T11), in-row.

When a whole Q&A text sits in one row these higher-order-function forms need
no shuffle at all. Block arrays are ``array<struct<pos:int, tag:string, text:string>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import WS_CLASS, _col, strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
QUESTION, ANSWER, FOLLOW_UP = "Question", "Answer", "Follow-up"
TAGS = (QUESTION, ANSWER, FOLLOW_UP)
# A tag is "[Name]:"; rendered blocks are "[Name]: text", one per line.
TAG_RE = r"\[(Question|Answer|Follow-up)\]:"
TAG_SPLIT_RE = r"\[(?:Question|Answer|Follow-up)\]:"

BLOCK_TYPE = "array<struct<pos:int,tag:string,text:string>>"


def parse_blocks(c) -> Column:
    """T5: ordered (pos, tag, text) blocks of a labelled text.

    A block's text runs from its tag to the next tag (or the end) and is
    stripped; text before the first tag is dropped; tags are case-sensitive.
    """
    c = _col(c)
    tags = F.regexp_extract_all(c, F.lit(TAG_RE), 1)
    parts = F.split(c, TAG_SPLIT_RE)
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    blocks = F.zip_with(tags, bodies, lambda t, b: F.struct(t.alias("tag"), strip(b).alias("text")))
    return F.transform(blocks, lambda b, i: F.struct((i + 1).alias("pos"), b["tag"].alias("tag"),
                                                     b["text"].alias("text")))


def canonical_tag(tag: Column) -> Column:
    """Follow-up counts as a Question."""
    return F.when(tag == F.lit(FOLLOW_UP), F.lit(QUESTION)).otherwise(tag)


def with_merged_blocks(df: DataFrame, blocks_col: str, out: str) -> DataFrame:
    """T6 (in-row form): canonical tags, drop empty blocks *before* run
    detection, join consecutive same-tag blocks with one space.

    Linear: run starts are found by index comparison, then each run is one
    ``slice`` of the non-empty blocks. The intermediate arrays are staged as
    columns because lambda bodies must only see cheap column references (an
    inline array expression would be re-evaluated for every element).
    """
    ne = F.filter(F.transform(F.col(blocks_col), lambda b: F.struct(canonical_tag(b["tag"]).alias("tag"),
                                                                    b["text"].alias("text"))),
                  lambda b: F.length(b["text"]) > 0)
    df = df.withColumn("_ne", ne)
    n = F.size("_ne")
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_starts", F.filter(idx, lambda i: (i == 1) | (
        F.element_at(F.col("_ne"), i)["tag"] != F.element_at(F.col("_ne"), F.greatest(i - 1, F.lit(1)))["tag"])))

    def run(s, k):
        nxt = F.coalesce(F.get(F.col("_starts"), k + 1), n + 1)  # next run start (0-based get)
        return F.struct((k + 1).alias("pos"), F.element_at(F.col("_ne"), s)["tag"].alias("tag"),
                        F.array_join(F.transform(F.slice(F.col("_ne"), s, nxt - s), lambda b: b["text"]), " ").alias("text"))

    return df.withColumn(out, F.transform(F.col("_starts"), run)).drop("_ne", "_starts")


def render_blocks(blocks) -> Column:
    """``[Tag]: text`` lines joined by newlines; '' for no blocks."""
    return F.array_join(F.transform(_col(blocks), lambda b: F.concat(F.lit("["), b["tag"], F.lit("]: "), b["text"])),
                        "\n")


def with_clean_qa(df: DataFrame, text_col: str, out: str = "qa_text", blocks_out: str | None = None) -> DataFrame:
    """T5 -> T6 -> T7 on a labelled text column; optionally keep the merged blocks."""
    keep = blocks_out or "_merged"
    df = with_merged_blocks(df.withColumn("_parsed", parse_blocks(text_col)), "_parsed", keep)
    df = df.withColumn(out, render_blocks(keep)).drop("_parsed")
    return df if blocks_out else df.drop(keep)


def answers_only(blocks) -> Column:
    """Only Answer blocks feed the summary."""
    return F.filter(_col(blocks), lambda b: b["tag"] == F.lit(ANSWER))


def strip_labels(c) -> Column:
    """Text without its ``[Tag]:`` labels (labels are not words, for T10)."""
    return F.regexp_replace(_col(c), TAG_SPLIT_RE, " ")


__all__ = ["parse_blocks", "with_merged_blocks", "render_blocks", "with_clean_qa", "answers_only", "strip_labels",
           "canonical_tag", "TAGS", "QUESTION", "ANSWER", "FOLLOW_UP", "WS_CLASS"]
