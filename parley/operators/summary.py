"""Extractive summaries (M3 'extractive' provider) and the text report.

Deterministic rules (integer scores, no float ties across engines):

* input: Answer blocks of a session (T11), split into sentences;
* a session without Q&A text is summarised from its raw text (P8), and every
  session has a row, possibly of empty parts;
* terms: normalised words (T1) of at least ``min_term_chars`` characters;
* ``tf`` = occurrences in the session's answers, ``df`` = sessions having the
  term, ``N`` = sessions with at least one term;
* sentence score = sum of ``tf`` over its distinct terms;
* key points = top ``n_points`` sentences by (score desc, position), shown in
  position order; content = the top ``n_content`` of them, in position order,
  joined by one space;
* topics = top ``n_topics`` terms by (tf * N div df desc, term);
* action items = sentences matching an action-cue list, in position order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import explode_items, normalise_words, posexplode_items, sentences
from parley.operators.ordered import ordered_collect
from parley.operators.structure import cue_pattern
from parley.sources import store

DEFAULT_ACTION_CUES = ("will", "should", "need to", "plan to", "next step", "follow up")
POS_SHIFT = 1 << 32  # sentence position = block_pos * 2^32 + sentence index


def answer_sentences(answers: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, spos, sentence) with a session-wide sentence position."""
    s = (answers.select(key, pos, posexplode_items(sentences(F.col(text))).alias("_i", "sentence"))
         .where(F.col("sentence").isNotNull()))
    return s.select(key, (F.col(pos).cast("long") * POS_SHIFT + F.col("_i")).alias("spos"), "sentence")


#: Blocks, and sentences of a block, that one row of the table of terms speaks for.
CHUNK_BLOCKS, CHUNK_SENTENCES = 64, 4096


def session_terms(sents: DataFrame, key: str, min_term_chars: int = 1) -> DataFrame:
    """(key, term, tf, at): every term of a session, its number there, and the sentences that have it; a session of very
    many sentences has several rows for a term, each of a chunk of the sentences. Words are cut once, and this table is
    all that scores, topics and document frequencies read."""
    words = sents.select(key, "spos", explode_items(normalise_words(F.col("sentence"))).alias("term")).where(F.length("term") >= min_term_chars)
    chunk = F.struct(F.call_function("div", F.col("spos"), F.lit(POS_SHIFT * CHUNK_BLOCKS)).alias("b"),
                     F.call_function("div", F.col("spos") % POS_SHIFT, F.lit(CHUNK_SENTENCES)).alias("s"))
    rows = words.groupBy(key, "term", chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("spos").alias("at"))
    return rows.select(key, "term", F.sum("_n").over(Window.partitionBy(key, "term")).alias("tf"), "at",
                       (F.row_number().over(Window.partitionBy(key, "term").orderBy("_chunk")) == 1).alias("first"))


def scored_sentences(sents: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, spos, sentence, score): the sum of ``tf`` over a sentence's distinct terms, in one aggregation."""
    scores = terms.select(key, F.explode("at").alias("spos"), "tf", F.lit(None).cast("string").alias("sentence"))
    own = sents.select(key, "spos", F.lit(0).cast("long").alias("tf"), "sentence")
    return own.unionByName(scores).groupBy(key, "spos").agg(F.max("sentence").alias("sentence"), F.sum("tf").alias("score"))


def top_k(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """Rows ranked 1..k per key; Spark limits each key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_fallback(answers: DataFrame, raw: DataFrame, with_qa: DataFrame, key: str) -> DataFrame:
    """``answers`` (key, pos, text), and for sessions without Q&A text the rows
    of their raw text. ``with_qa`` lists the sessions that have Q&A text."""
    return answers.unionByName(raw.join(with_qa.select(key).distinct(), key, "left_anti"))


def summarize(answers: DataFrame | None, key: str = "session_id", pos: str = "pos", text: str = "text",
              action_cues: Sequence[str] = DEFAULT_ACTION_CUES, min_term_chars: int = 1,
              n_points: int = 5, n_content: int = 3, n_topics: int = 6, sents: DataFrame | None = None) -> dict:
    """Summaries of every session in ``answers`` (one row per Answer block), or in ``sents``, a table of
    :func:`answer_sentences`. The sessions summarised here are the corpus.

    Terms and scored sentences are stored, so each is computed once. Returns DataFrames ``points`` (key, rank, spos,
    sentence) ranked by score, ``topics`` (key, rank, term), ``actions`` (key, spos, sentence) and
    ``sentences`` (key, spos, sentence, score).
    """
    if sents is None:
        sents = store.stage_table(answer_sentences(answers, key, pos, text), "sentences")
    terms = store.stage_table(session_terms(sents, key, min_term_chars), "terms")
    scored = store.stage_table(scored_sentences(sents, terms, key), "scored")
    points = top_k(scored, key, [F.col("score").desc(), F.col("spos")], n_points)

    tf = terms.where("first").select(key, "term", "tf")
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_sessions = tf.agg(F.count_distinct(key).alias("n")).scalar()  # scalar subquery
    weights = tf.join(df_, "term").withColumn("weight", F.floor(F.col("tf") * n_sessions / F.col("df")).cast("long"))
    topics = top_k(weights, key, [F.col("weight").desc(), F.col("term")], n_topics)

    pat = cue_pattern(action_cues)
    actions = scored.where(F.lower("sentence").rlike(pat))
    return {"points": points, "topics": topics.select(key, "rank", "term", "weight"),
            "actions": actions, "sentences": scored, "n_content": n_content}


def collect_in_order(df: DataFrame, key: str, order_col: str, value_col: str, out: str,
                     where=None) -> DataFrame:
    """Small ranked sets (top-k survivors) into an ordered array per key."""
    d = df.where(where) if where is not None else df
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v"))))
    return d.groupBy(key).agg(F.transform(items, lambda x: x["v"]).alias(out))


def summary_table(parts: dict, key: str, keys: DataFrame) -> DataFrame:
    """(key, content, key_points[], action_items[], topics[]) of every session in ``keys``.

    Action items of a session are whole output; they are gathered per session
    after a partial concatenation per sentence chunk would not shrink them."""
    ranked = F.struct("spos", "sentence", "rank")
    best = parts["points"].groupBy(key).agg(F.array_sort(F.collect_list(ranked)).alias("_p"))
    points = best.select(key, F.transform("_p", lambda x: x["sentence"]).alias("key_points"),
                         F.transform(F.filter("_p", lambda x: x["rank"] <= parts["n_content"]), lambda x: x["sentence"]).alias("_content"))
    topics = collect_in_order(parts["topics"], key, "rank", "term", "topics")
    # action items are unbounded per session: gathered in two levels
    actions = ordered_collect(parts["actions"], key, "spos", F.col("sentence"), "action_items",
                              chunk_size=POS_SHIFT)
    out = keys.select(key).distinct()
    for part in (points, topics, actions):
        out = out.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key,
                      F.array_join(F.coalesce("_content", empty), " ").alias("content"),
                      F.coalesce("key_points", empty).alias("key_points"),
                      F.coalesce("action_items", empty).alias("action_items"),
                      F.coalesce("topics", empty).alias("topics"))


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results): report layout
# ---------------------------------------------------------------------------
REPORT_SUMMARY = "SUMMARY:"
REPORT_KEY_POINTS = "KEY POINTS:"
REPORT_ACTIONS = "ACTION ITEMS:"
REPORT_TOPICS = "TOPICS:"
BULLET = "- "


def render_report(content, key_points, action_items, topics):
    """The plain-text report of one summary."""
    empty = F.array().cast("array<string>")

    def bullets(arr):
        return F.array_join(F.transform(F.coalesce(arr, empty), lambda x: F.concat(F.lit(BULLET), x)), "\n")

    # a missing content is formatted as the text "None", as the reference prints it
    return F.concat_ws("\n",
                       F.concat(F.lit(REPORT_SUMMARY + "\n"), F.coalesce(content, F.lit("None")), F.lit("\n")),
                       F.lit(REPORT_KEY_POINTS), bullets(key_points),
                       F.lit("\n" + REPORT_ACTIONS), bullets(action_items),
                       F.lit("\n" + REPORT_TOPICS), F.array_join(F.coalesce(topics, empty), ", "))
