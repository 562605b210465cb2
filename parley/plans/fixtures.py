"""Stand-in inputs derived from the driver tables (see FIXTURES.md).

The reference works on recordings, transcript files, labelled Q&A text and
model hypotheses. The driver supplies generic tables instead; these functions
derive the stage inputs from them deterministically, so every query grows with
the tables it reads. Each derivation has a twin in ``parley.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import split_whitespace, strip
from parley.operators.structure import label_turn

# file-name suffix by doc_id % 4
FILE_SUFFIXES = (".txt", "_presentation.txt", "_q_and_a.txt", ".mp3")
MODELS = ("m1", "m2", "m3")
CHARS_PER_SECOND = 15.0


def doc_files(documents: DataFrame) -> DataFrame:
    """documents -> (doc_id, name, text, lang): a listing of stage files."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in FILE_SUFFIXES]), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("name"),
        "text", "lang")


def turn_tag(role: Column, turn: Column) -> Column:
    """Label of a conversation turn; every fourth one goes back and forth."""
    return label_turn(role, turn % 4 == 3)


def labelled_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, tag, content): tagged turns with runs and empty blocks."""
    c = conversations
    content = F.when((c.conv_id + c.turn) % 11 == 0, F.lit("")).otherwise(c.text)
    return c.select("conv_id", "turn", "role", turn_tag(c.role, c.turn).alias("tag"), content.alias("content"))


def hypothesis_text(text: Column, conv_id: Column, turn: Column, model_no: Column) -> Column:
    """Deterministic 'recognition output' for model ``model_no`` (1-based)."""
    words = split_whitespace(text)

    def edit(w, i):
        pos = i + 1
        return (F.when((pos * 7 + conv_id + model_no) % (model_no * 5 + 10) == 0, F.lit(None).cast("string"))
                .when((pos * 11 + turn) % 17 == 0, F.reverse(w))
                .otherwise(w))

    return F.array_join(F.transform(words, edit), " ")


def reference_cases(conversations: DataFrame) -> DataFrame:
    """One evaluation case per conversation turn: (conv_id, turn, ref_text)."""
    return conversations.select("conv_id", "turn", F.col("text").alias("ref_text"))


def hypotheses(conversations: DataFrame, models=MODELS) -> DataFrame:
    """(conv_id, turn, model, hyp_text): one hypothesis per case and model."""
    c = conversations.select("conv_id", "turn", "text",
                             F.explode(F.array(*[F.lit(i + 1) for i in range(len(models))])).alias("model_no"))
    names = F.array(*[F.lit(m) for m in models])
    return c.select("conv_id", "turn",
                    F.element_at(names, F.col("model_no")).alias("model"),
                    hypothesis_text(F.col("text"), F.col("conv_id"), F.col("turn"), F.col("model_no")).alias("hyp_text"))


def segment_rows(conversations: DataFrame) -> DataFrame:
    """(session_id, seg_no, text) rows: a conversation is a session, a turn a segment."""
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_no"),
                                strip(F.col("text")).alias("text"))


# Stage definitions over the file listing: which files a stage reads (by
# doc_id % 4, i.e. by suffix) and which output kinds mark an input as done.
STAGES = (
    ("transcribe", 3, ("transcript",)),
    ("structure", 0, ("presentation", "q_and_a")),
    ("summarize", 2, ("summary_txt", "summary_json")),
)


def stage_outputs(labels: DataFrame) -> DataFrame:
    """(doc_id, kind): outputs already on disk, from ``labels`` (quality=1:
    first output of a stage present; toxic=0: second output present)."""
    q1, t0 = F.col("quality") == 1, F.col("toxic") == 0
    kinds = F.array(F.when(q1, "transcript"), F.when(q1, "presentation"), F.when(t0, "q_and_a"),
                    F.when(q1, "summary_txt"), F.when(t0, "summary_json"))
    return labels.select("doc_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
