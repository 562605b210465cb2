"""Rule-based structuring (M2 'rules' provider): presentation split (T8),
turn / sentence labelling (T9), verbatim check (T10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.qa import ANSWER, FOLLOW_UP, QUESTION, render_blocks, with_merged_blocks
from parley.functions.text import WORD_CLASS, _col, sentences, split_whitespace

# Defaults for English sessions; callers pass their own lists per language.
DEFAULT_QA_CUES = ("questions", "question", "q&a", "thank you")
DEFAULT_QUESTION_CUES = ("what", "how", "why", "can", "could", "would", "do", "does", "is", "are")


def cue_pattern(cues: Sequence[str]) -> str:
    """Whole-word match of any (lower-case) cue; use on lower-cased text."""
    alts = "|".join(_re_escape(c.lower()) for c in cues)
    return f"(?<![{WORD_CLASS}])(?:{alts})(?![{WORD_CLASS}])"


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\-&" else ch for ch in s)


def with_split(df: DataFrame, text_col: str, cues: Sequence[str]) -> DataFrame:
    """Adds ``presentation``, ``q_and_a`` and ``cue_sentence`` (null without a cue).

    The presentation is the contiguous run of sentences before the first
    sentence containing a cue word; that sentence and everything after is Q&A.
    No cue: all presentation, empty Q&A. Words are kept verbatim and in order.
    Sentences and the cue's place are staged, so each is computed once.
    """
    pat = cue_pattern(cues)
    df = df.withColumn("_sents", sentences(F.col(text_col)))
    df = df.withColumn("_k", F.array_position(F.transform("_sents", lambda s: F.lower(s).rlike(pat)), True).cast("int"))
    k, n = F.col("_k"), F.size("_sents")
    end = F.when(k == 0, n).otherwise(k - 1)
    return df.withColumns({
        "presentation": F.array_join(F.slice("_sents", 1, F.greatest(end, F.lit(0))), " "),
        "q_and_a": F.array_join(F.slice("_sents", F.greatest(end, F.lit(0)) + 1, F.greatest(n - end, F.lit(0))), " "),
        "cue_sentence": F.when(k > 0, k)}).drop("_sents", "_k")


def label_sentences(text, question_cues: Sequence[str]) -> Column:
    """T9 for raw text: sentence blocks tagged Question when they end with '?'
    or open with a question cue, otherwise Answer."""
    pat = "^" + cue_pattern(question_cues)
    return F.transform(sentences(_col(text)), lambda s, i: F.struct(
        (i + 1).alias("pos"),
        F.when(s.endswith("?") | F.lower(s).rlike(pat), F.lit(QUESTION)).otherwise(F.lit(ANSWER)).alias("tag"),
        s.alias("text")))


def label_turn(role: Column, follows_up: Column, presenter_roles: Sequence[str] = ("system",), asker_roles: Sequence[str] = ("user",)) -> Column:
    """T9 for turn tables: what presenters say before the Q&A has no tag, a turn of the back-and-forth is a Follow-up,
    what askers (facilitator, audience) say is a Question, and all else an Answer."""
    return (F.when(role.isin(list(presenter_roles)), F.lit(None).cast("string")).when(follows_up, F.lit(FOLLOW_UP))
            .when(role.isin(list(asker_roles)), F.lit(QUESTION)).otherwise(F.lit(ANSWER)))


def with_structure(df: DataFrame, text_col: str, qa_cues: Sequence[str], question_cues: Sequence[str],
                   pres_out: str = "presentation", qa_out: str = "structured_qa_text") -> DataFrame:
    """M2 'rules' provider on raw text: T8 -> T9 -> T6 -> T7 (staged columns)."""
    df = with_split(df, text_col, qa_cues).withColumnsRenamed({"presentation": pres_out, "q_and_a": "_qa"}).drop("cue_sentence")
    df = with_merged_blocks(df.withColumn("_lab", label_sentences(F.col("_qa"), question_cues)), "_lab", "_runs")
    return df.withColumn(qa_out, render_blocks("_runs")).drop("_qa", "_lab", "_runs")


def leading_presentation(turns: DataFrame, key: str, pos: str, role: str, presenter_roles=("system",)) -> DataFrame:
    """T8 on turn tables: turns before the first non-presenter turn.

    Adds boolean ``is_presentation``. The first Q&A position per key is a plain
    aggregate (partial before the shuffle), joined back on the key."""
    first_qa = (turns.where(~F.col(role).isin(list(presenter_roles)))
                .groupBy(key).agg(F.min(pos).alias("_first_qa")))
    return (turns.join(first_qa, key, "left")
            .withColumn("is_presentation", F.col("_first_qa").isNull() | (F.col(pos) < F.col("_first_qa")))
            .drop("_first_qa"))


def verbatim_check(raw, presentation, labelled_qa) -> Column:
    """struct(ok, first_diff, n_raw, n_out). Output words (presentation,
    then Q&A without its labels) must equal the input words in order."""
    from parley.functions.qa import strip_labels

    raw_w = split_whitespace(_col(raw))
    out_w = F.concat(split_whitespace(F.coalesce(_col(presentation), F.lit(""))),
                     split_whitespace(strip_labels(F.coalesce(_col(labelled_qa), F.lit("")))))
    same = F.zip_with(raw_w, out_w, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False).cast("long")
    return F.struct((first == 0).alias("ok"), F.nullif(first, F.lit(0).cast("long")).alias("first_diff"),
                    F.size(raw_w).cast("long").alias("n_raw"), F.size(out_w).cast("long").alias("n_out"))


def with_verbatim_check(df: DataFrame, raw: str, presentation: str, labelled_qa: str) -> DataFrame:
    """T10 with the T2 distance: adds ``verbatim`` (the struct) and ``distance``, 0 where the words agree."""
    from parley.functions.qa import strip_labels
    from parley.functions.text import with_word_edit_distance

    texts = [F.coalesce(F.col(presentation), F.lit("")), strip_labels(F.coalesce(F.col(labelled_qa), F.lit("")))]
    df = df.withColumn("verbatim", verbatim_check(F.col(raw), F.col(presentation), F.col(labelled_qa)))
    differ = ~F.col("verbatim.ok")
    none = F.array().cast("array<string>")
    df = df.withColumn("_raw", F.when(differ, split_whitespace(F.col(raw))).otherwise(none))
    df = df.withColumn("_out", F.when(differ, F.concat(*[split_whitespace(t) for t in texts])).otherwise(none))
    return with_word_edit_distance(df, "_raw", "_out", "distance").drop("_raw", "_out")
