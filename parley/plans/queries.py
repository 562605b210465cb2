"""Registered queries: one per operator family of the inventory.

Every query takes ``(spark, sf_dir)``, reads the driver tables under ``sf_dir``
(never a fixed small input) and returns a DataFrame whose column names match
the DuckDB twin in ``parley.plans.oracle``. Arrays are joined to strings and
doubles rounded to 6 digits so that both engines hash the same values.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import qa, sql
from parley.functions.text import explode_items, is_blank, normalise_words, strip
from parley.operators import evaluate as ev
from parley.operators import incremental as inc
from parley.operators import ordered
from parley.operators import session as session_ops
from parley.operators import structure
from parley.operators import summary as summ
from parley.operators import timing
from parley.operators import providers
from parley.plans import session_flow as flow
from parley.streaming import chain as streaming
from parley.functions import json as pjson
from parley import schemas
from parley.sources import sessions as arch
from parley.sources import files, sinks, store
from parley.plans import fixtures as fx
from parley.spark import read_table, spread, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- evaluation
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one shuffle of the source by case key: references and hypotheses are
    # derived in parallel from it and join without another exchange
    conv = read_table(spark, sf_dir, "conversations")
    conv = conv.repartition(ev.scoring_partitions(spark), "conv_id", "turn")
    pairs = ev.pair_cases(fx.reference_cases(conv), fx.hypotheses(conv), ["conv_id", "turn"], prepartitioned=True)
    return (ev.score_pairs(pairs)
            .withColumn("case_name", F.format_string("c%d_t%d", "conv_id", "turn")))


@query
def normalised_words(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents"))
    w = normalise_words(F.col("text"))
    return docs.select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


@query
def word_errors(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("conv_id", "turn", "model", "ref_words", "hyp_words", "errors")


@query
def wer_by_pair(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("conv_id", "turn", "model", F.round("wer", 6).alias("wer"),
                                              F.round("accuracy", 6).alias("accuracy"))


@query
def wer_macro(spark, sf_dir):
    m = ev.macro_wer(scored_pairs(spark, sf_dir))
    return m.select("model", F.round("avg_wer", 6).alias("avg_wer"),
                    F.round("avg_accuracy", 6).alias("avg_accuracy"), "n_cases")


@query
def leaderboard(spark, sf_dir):
    return ev.leaderboard(scored_pairs(spark, sf_dir), "case_name", fx.MODELS)


@query
def best_model(spark, sf_dir):
    return ev.best_model(scored_pairs(spark, sf_dir), "case_name")


@query
def evaluation_summary(spark, sf_dir):
    """A2 / A5 as a report prints them: cases, and both averages in percent."""
    m = ev.macro_wer(scored_pairs(spark, sf_dir))
    return m.select("model", "n_cases", ev.percent(F.col("avg_wer")).alias("wer"), ev.percent(F.col("avg_accuracy")).alias("accuracy"))


@query
def eval_pairs(spark, sf_dir):
    """Texts paired by case name; a case that either side lacks is skipped."""
    conv = read_table(spark, sf_dir, "conversations")
    stem = F.format_string("c%d_t%d", "conv_id", "turn").alias("stem")
    refs = conv.where(F.col("turn") % 3 != 0).select(stem, "text")
    hyps = conv.where(F.col("turn") % 4 != 1).select(stem, F.upper("text").alias("text"))
    pairs = files.scan_eval_pairs(refs, hyps)
    return pairs.select("case_name", F.length("ref_text").cast("long").alias("ref_chars"), (F.upper("ref_text") == F.col("hyp_text")).alias("same"))


# ---------------------------------------------------------------- Q&A blocks
def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, qa_raw): the labelled Q&A text of each session, as a
    structuring provider would return it (one ``[Tag]: text`` line per turn)."""
    turns = fx.labelled_turns(read_table(spark, sf_dir, "conversations")).where(F.col("tag").isNotNull())
    lines = turns.select("conv_id", "turn", F.concat(F.lit("["), "tag", F.lit("]: "), "content").alias("line"))
    return ordered.ordered_concat(lines, "conv_id", "turn", "line", sep="\n", out="qa_raw").drop("n_items")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, raw_text, n_segments): A1 over the session's segments."""
    segs = fx.segment_rows(read_table(spark, sf_dir, "conversations"))
    return (ordered.ordered_concat(segs, "session_id", "seg_no", "text", sep=" ", out="raw_text")
            .withColumnRenamed("session_id", "conv_id").withColumnRenamed("n_items", "n_segments"))


@query
def qa_blocks(spark, sf_dir):
    t = labelled_text(spark, sf_dir)
    b = t.select("conv_id", explode_items(qa.parse_blocks("qa_raw")).alias("b")).where(F.col("b").isNotNull())
    return b.select("conv_id", F.col("b.pos").cast("long").alias("pos"), "b.tag", "b.text")


@query
def qa_runs(spark, sf_dir):
    turns = fx.labelled_turns(read_table(spark, sf_dir, "conversations")).where(F.col("tag").isNotNull())
    rows = turns.select("conv_id", "turn", qa.canonical_tag(F.col("tag")).alias("tag"),
                        strip(F.col("content")).alias("text"))
    return ordered.merge_runs(rows, "conv_id", "turn", "tag", "text")


@query
def qa_render(spark, sf_dir):
    t = labelled_text(spark, sf_dir)
    return qa.with_clean_qa(t, "qa_raw", "qa_text").select("conv_id", "qa_text")


@query
def answers_only(spark, sf_dir):
    t = qa.with_clean_qa(labelled_text(spark, sf_dir), "qa_raw", "qa_text", blocks_out="runs")
    ans = qa.answers_only("runs")
    return t.select("conv_id", F.size(ans).cast("long").alias("n_answers"),
                    F.array_join(F.transform(ans, lambda b: b["text"]), "\n").alias("answer_text"))


@query
def turn_labels(spark, sf_dir):
    turns = fx.labelled_turns(read_table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "role", "tag", qa.canonical_tag(F.col("tag")).alias("canonical_tag"))


# ---------------------------------------------------------------- SQL only
def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query in SQL over the tables as views, with the library's SQL functions."""
    sql.register(spark)
    return spark.sql(text, conversations=read_table(spark, sf_dir, "conversations"))


@query
def sql_qa_runs(spark, sf_dir):
    """T6 in SQL: labelled turns into runs of one tag."""
    return _sql(spark, sf_dir, """
        WITH labelled AS (
          SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'Follow-up' WHEN role = 'user' THEN 'Question' ELSE 'Answer' END AS tag,
                 CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS content
          FROM {conversations} WHERE role <> 'system'),
        blocks AS (SELECT * FROM (SELECT conv_id, turn, parley_tag(tag) AS tag, parley_strip(content) AS text FROM labelled) WHERE length(text) > 0),
        marked AS (SELECT *, lag(tag) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM tag AS starts FROM blocks),
        runs AS (SELECT *, max(CASE WHEN starts THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run_pos FROM marked)
        SELECT conv_id, run_pos, max(tag) AS tag, listagg(text, ' ') WITHIN GROUP (ORDER BY turn) AS text, count(*) AS n_blocks
        FROM runs GROUP BY conv_id, run_pos""")


@query
def sql_blocks(spark, sf_dir):
    """T5-T7 and T11 in SQL: labelled text cut into block rows by the table function, cleaned, and its answers."""
    return _sql(spark, sf_dir, """
        WITH lines AS (
          SELECT conv_id, turn, concat('[', CASE WHEN turn % 4 = 3 THEN 'Follow-up' WHEN role = 'user' THEN 'Question' ELSE 'Answer' END, ']: ',
                 CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END) AS line
          FROM {conversations} WHERE role <> 'system'),
        qa AS (SELECT conv_id, listagg(line, '\\n') WITHIN GROUP (ORDER BY turn) AS qa_raw FROM lines GROUP BY conv_id),
        cleaned AS (SELECT conv_id, parley_qa(qa_raw) AS qa_text, size(parley_answers(qa_raw)) AS n_answers FROM qa)
        SELECT b.conv_id, b.n_blocks, c.qa_text, CAST(c.n_answers AS BIGINT) AS n_answers
        FROM (SELECT conv_id, count(*) AS n_blocks FROM qa, LATERAL parley_block_rows(qa.qa_raw) GROUP BY conv_id) b JOIN cleaned c ON b.conv_id = c.conv_id""")


@query
def sql_wer(spark, sf_dir):
    """T1-T4 in SQL: each answer against the text of the turn before it."""
    return _sql(spark, sf_dir, """
        SELECT conv_id, turn, CAST(parley_word_errors(said, text) AS BIGINT) AS errors, round(parley_wer(said, text), 6) AS wer,
               round(parley_accuracy(parley_wer(said, text)), 6) AS accuracy
        FROM (SELECT conv_id, turn, role, text, concat(left(text, 60), ' so ', left(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 40)) AS said FROM {conversations})
        WHERE said IS NOT NULL""")


# ---------------------------------------------------------------- transcripts
@query
def assemble_transcript(spark, sf_dir):
    segs = fx.segment_rows(read_table(spark, sf_dir, "conversations"))
    agg = ordered.ordered_concat(segs, "session_id", "seg_no", "text", sep=" ", out="raw_text")
    dur = segs.groupBy("session_id").agg(F.sum(F.length("text")).alias("_chars"))
    return (agg.join(dur, "session_id")
            .select(F.col("session_id").alias("conv_id"), F.col("n_items").alias("n_segments"), "raw_text",
                    F.round(F.col("_chars") / F.lit(fx.CHARS_PER_SECOND), 6).alias("duration_s")))


def segment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = fx.segment_rows(read_table(spark, sf_dir, "conversations")).withColumn("_len", F.length("text"))
    cum = ordered.running_sum(segs, "session_id", "seg_no", "_len", out="_cum")
    return cum.select("session_id", "seg_no", "text",
                      ((F.col("_cum") - F.col("_len")) / F.lit(fx.CHARS_PER_SECOND)).alias("start_time"),
                      (F.col("_cum") / F.lit(fx.CHARS_PER_SECOND)).alias("end_time"))


@query
def segment_progress(spark, sf_dir):
    st = segment_times(spark, sf_dir)
    # duration = total characters / rate: one partial aggregate over the scan,
    # not a second pass over the running-sum plan
    segs = fx.segment_rows(read_table(spark, sf_dir, "conversations"))
    dur = segs.groupBy("session_id").agg((F.sum(F.length("text")) / F.lit(fx.CHARS_PER_SECOND)).alias("duration"))
    prog = session_ops.segment_progress(F.col("end_time"), F.col("duration"))
    return (st.join(dur, "session_id")
            .select(F.col("session_id").alias("conv_id"), F.col("seg_no").alias("turn"),
                    F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"),
                    F.round(prog, 6).alias("progress")))


@query
def summary_input(spark, sf_dir):
    raw = transcripts(spark, sf_dir)
    qa_t = qa.with_clean_qa(labelled_text(spark, sf_dir), "qa_raw", "qa_text").select("conv_id", "qa_text")
    j = raw.join(qa_t, "conv_id", "left")
    inp = session_ops.summary_input(F.col("qa_text"), F.col("raw_text"))
    return j.select("conv_id",
                    F.when(F.length(F.coalesce("qa_text", F.lit(""))) > 0, F.lit("qa")).otherwise(F.lit("raw")).alias("source"),
                    F.when(is_blank(inp), F.lit("error")).otherwise(F.lit("ok")).alias("status"),
                    F.length(inp).cast("long").alias("input_chars"))


# ---------------------------------------------------------------- incremental
TARGETS = ("SRC1_", "_Presentation")
FORCED = ("src4_1",)
QA_CUES = ("this", "que", "und", "qui")
QUESTION_CUES = ("that", "la", "die", "los")


def stage_inputs(spark: SparkSession, sf_dir: str, residue: int) -> DataFrame:
    listed = fx.doc_files(read_table(spark, sf_dir, "documents"))
    listed = listed.withColumn("stem", inc.stem("name"))
    if residue == 0:  # transcripts: *.txt without derived stems
        return listed.where(F.col("name").endswith(".txt") & ~inc.is_derived("stem"))
    if residue == 2:
        return listed.where(F.col("name").endswith("_q_and_a.txt"))
    return listed.where(F.col("name").endswith(".mp3"))


@query
def transcript_scan_filter(spark, sf_dir):
    t = stage_inputs(spark, sf_dir, 0)
    return t.select("doc_id", "name", "stem", F.length("text").cast("long").alias("n_chars"))


@query
def target_filter(spark, sf_dir):
    listed = fx.doc_files(read_table(spark, sf_dir, "documents"))
    return inc.filter_targets(listed, "name", TARGETS).select("doc_id", "name")


@query
def target_index(spark, sf_dir):
    """P2 with a list of targets as long as the table of labels is."""
    listed = fx.doc_files(read_table(spark, sf_dir, "documents")).select("doc_id", "name")
    wanted = read_table(spark, sf_dir, "labels").where(F.col("doc_id") % 7 == 0).select(F.concat(F.lit("C"), F.col("doc_id") % 20, F.lit("_"), F.col("doc_id")).alias("target"))
    return inc.filter_targets_by_index(listed, "name", wanted)


@query
def skip_done(spark, sf_dir):
    outs = fx.stage_outputs(read_table(spark, sf_dir, "labels"))
    todo = inc.skip_done(stage_inputs(spark, sf_dir, 0), outs, "doc_id", "kind", ("presentation", "q_and_a"))
    return todo.select("doc_id", "name")


@query
def force_targets(spark, sf_dir):
    outs = fx.stage_outputs(read_table(spark, sf_dir, "labels"))
    todo = inc.select_work(stage_inputs(spark, sf_dir, 0), outs, "doc_id", "name", "kind",
                           ("presentation", "q_and_a"), targets=FORCED)
    return todo.select("doc_id", "name")


@query
def run_report(spark, sf_dir):
    listed = fx.doc_files(read_table(spark, sf_dir, "documents")).withColumn("stem", inc.stem("name"))
    name = F.col("name")
    stage = (F.when(name.endswith(".mp3"), F.lit("transcribe"))
             .when(name.endswith("_q_and_a.txt"), F.lit("summarize"))
             .when(name.endswith(".txt") & ~inc.is_derived("stem"), F.lit("structure")))
    staged = listed.select("doc_id", stage.alias("stage"), session_ops.require_text(F.col("text")).isNotNull().alias("bad"))
    outs = fx.stage_outputs(read_table(spark, sf_dir, "labels"))
    return inc.stage_report(staged.where(F.col("stage").isNotNull()), outs, "doc_id", "stage", "kind", "bad",
                            {name_: required for name_, _, required in fx.STAGES})


@query
def require_text_split(spark, sf_dir):
    turns = fx.labelled_turns(read_table(spark, sf_dir, "conversations"))
    err = session_ops.require_text(F.col("content"))
    return turns.select("conv_id", "turn", F.when(err.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                        err.alias("error_class"))


@query
def session_init(spark, sf_dir):
    listed = fx.doc_files(read_table(spark, sf_dir, "documents"))
    title = (F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
             .when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.upper("lang")))
    modified = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    s = session_ops.init_session(F.concat(F.col("lang"), F.lit("/"), F.col("name")), modified, title, now=modified)
    return listed.select("doc_id", s["session_id"].alias("session_id"), F.unix_seconds(s["created_at"]).alias("created_s"), s["title"].alias("title"))


@query
def session_now(spark, sf_dir):
    """P5 with its own clock: every session of a run is created at one time, which is now."""
    listed = fx.doc_files(read_table(spark, sf_dir, "documents"))
    s = listed.select(session_ops.init_session(F.col("name"), F.lit("2024-01-01").cast("timestamp"), F.lit("")).alias("s"))
    age = F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds("s.created_at"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s.session_id").alias("n_ids"), F.count_distinct("s.created_at").alias("n_times"),
                 (F.max(age) < 3600).alias("is_now"))


# ---------------------------------------------------------------- structuring
@query
def presentation_split(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents"))
    sp = structure.with_split(docs, "text", QA_CUES)
    return sp.select("doc_id", F.col("cue_sentence").cast("long").alias("cue_sentence"),
                     F.length("presentation").cast("long").alias("presentation_chars"),
                     F.length("q_and_a").cast("long").alias("qa_chars"))


@query
def sentence_labels(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents"))
    st = structure.with_structure(docs, "text", QA_CUES, QUESTION_CUES)
    return st.select("doc_id", F.length("presentation").cast("long").alias("presentation_chars"),
                     "structured_qa_text")


def presentation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    marked = structure.leading_presentation(conv, "conv_id", "turn", "role")
    pres = marked.where("is_presentation").select("conv_id", "turn", strip(F.col("text")).alias("text"))
    return ordered.ordered_concat(pres, "conv_id", "turn", "text", out="presentation").drop("n_items")


@query
def verbatim(spark, sf_dir):
    raw = transcripts(spark, sf_dir)
    j = (raw.join(presentation_text(spark, sf_dir), "conv_id", "left")
         .join(labelled_text(spark, sf_dir), "conv_id", "left"))
    v = structure.verbatim_check(F.col("raw_text"), F.col("presentation"), F.col("qa_raw"))
    return j.select("conv_id", v["ok"].alias("ok"), v["first_diff"].alias("first_diff"),
                    v["n_raw"].alias("n_raw"), v["n_out"].alias("n_out"))


@query
def verbatim_distance(spark, sf_dir):
    """T10 with its distance: where output and input words differ, how many edits lie between them."""
    j = (transcripts(spark, sf_dir).join(presentation_text(spark, sf_dir), "conv_id", "left").join(labelled_text(spark, sf_dir), "conv_id", "left"))
    v = structure.with_verbatim_check(j, "raw_text", "presentation", "qa_raw")
    return v.select("conv_id", F.col("verbatim.ok").alias("ok"), F.col("distance").cast("long").alias("distance"))


# ---------------------------------------------------------------- summaries
ACTION_CUES = ("with", "pour", "und", "los")


def runs_of(conv: DataFrame) -> DataFrame:
    """(conv_id, run_pos, tag, text, n_blocks): merged labelled runs of the turns, as rows."""
    turns = fx.labelled_turns(conv).where(F.col("tag").isNotNull())
    rows = turns.select("conv_id", "turn", qa.canonical_tag(F.col("tag")).alias("tag"), strip(F.col("content")).alias("text"))
    return ordered.merge_runs(rows, "conv_id", "turn", "tag", "text")


def summary_rows(conv: DataFrame) -> DataFrame:
    """(conv_id, pos, text): Answer runs of each session (T11), or its raw text."""
    runs = runs_of(conv)
    answers = runs.where(F.col("tag") == "Answer").select("conv_id", F.col("run_pos").cast("long").alias("pos"), "text")
    raw = fx.segment_rows(conv).select(F.col("session_id").alias("conv_id"), F.col("seg_no").cast("long").alias("pos"), "text")
    return summ.with_fallback(answers, raw, runs, "conv_id")


def summary_parts(spark: SparkSession, sf_dir: str) -> dict:
    rows = summary_rows(read_table(spark, sf_dir, "conversations"))
    return summ.summarize(rows, key="conv_id", action_cues=ACTION_CUES)


def summary_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read_table(spark, sf_dir, "conversations").select("conv_id")
    return summ.summary_table(summary_parts(spark, sf_dir), "conv_id", keys)


@query
def summary_key_points(spark, sf_dir):
    t = summary_of_all(spark, sf_dir)
    return t.select("conv_id", F.array_join("key_points", "\n").alias("key_points"), "content")


@query
def summary_topics(spark, sf_dir):
    p = summary_parts(spark, sf_dir)
    return p["topics"].select("conv_id", F.col("rank").cast("long").alias("rank"), "term", "weight")


@query
def summary_actions(spark, sf_dir):
    t = summary_of_all(spark, sf_dir)
    return t.select("conv_id", F.size("action_items").cast("long").alias("n_actions"),
                    F.array_join("action_items", "\n").alias("action_items"))


@query
def summary_report(spark, sf_dir):
    t = summary_of_all(spark, sf_dir)
    return t.select("conv_id", summ.render_report(F.col("content"), F.col("key_points"), F.col("action_items"),
                                                  F.col("topics")).alias("report"))


# ---------------------------------------------------------------- responses
def structure_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, response): what an external structuring model might return,
    one shape per ``conv_id % 5`` (full, missing key, null, truncated, empty)."""
    pres = presentation_text(spark, sf_dir)
    lab = labelled_text(spark, sf_dir)
    ids = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    j = ids.join(pres, "conv_id", "left").join(lab, "conv_id", "left")
    p, q_ = F.coalesce("presentation", F.lit("")), F.coalesce("qa_raw", F.lit(""))
    full = pjson.to_document(F.struct(p.alias("presentation"), q_.alias("q_and_a")))
    resp = (F.when(F.col("conv_id") % 5 == 0, full)
            .when(F.col("conv_id") % 5 == 1, pjson.to_document(F.struct(p.alias("presentation"))))
            .when(F.col("conv_id") % 5 == 2, pjson.to_document(F.struct(F.lit(None).cast("string").alias("presentation"),
                                                                         q_.alias("q_and_a"))))
            .when(F.col("conv_id") % 5 == 3, F.substring(full, 1, F.floor(F.length(full) / 2).cast("int")))
            .otherwise(F.lit("")))
    return j.select("conv_id", resp.alias("response"))


@query
def parse_response(spark, sf_dir):
    r = structure_responses(spark, sf_dir)
    p = r.select("conv_id", pjson.parse_structure_response("response").alias("p"))
    p = p.select("conv_id", "p.error", "p.presentation", "p.raw_qa")
    p = qa.with_clean_qa(p, "raw_qa", "qa_text")
    ok = F.col("error").isNull()
    return p.select("conv_id", F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"), "error",
                    F.when(ok, F.length("presentation")).cast("long").alias("presentation_chars"),
                    F.when(ok, F.col("qa_text")).alias("qa_text"))


@query
def parse_summary_response(spark, sf_dir):
    ev_ = read_table(spark, sf_dir, "events")
    built = pjson.to_document(F.struct(F.col("event_type").alias("content"),
                                       F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("key_points"),
                                       F.array().cast("array<string>").alias("action_items"),
                                       F.array(F.col("event_type")).alias("topics")))
    resp = (F.when(F.col("event_id") % 4 == 0, F.col("props"))
            .when(F.col("event_id") % 4 == 1, built)
            .when(F.col("event_id") % 4 == 2, F.lit(""))
            .otherwise(F.concat(F.lit("not json "), F.col("props"))))
    p = ev_.select("event_id", pjson.parse_summary_response(resp).alias("p"))
    ok = F.col("p.error").isNull()
    return p.select("event_id", F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                    F.when(ok, F.col("p.content")).alias("content"),
                    F.when(ok, F.size("p.key_points")).cast("long").alias("n_key_points"),
                    F.when(ok, F.size("p.action_items")).cast("long").alias("n_action_items"),
                    F.when(ok, F.array_join("p.topics", ",")).alias("topics"))


# ---------------------------------------------------------------- timing, vocabulary
@query
def step_timing(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("step"), F.col("value").alias("duration_s"),
        (F.col("event_type") == "error").alias("failed"))
    return timing.step_timing(log)


@query
def vocabulary_hits(spark, sf_dir):
    terms = ev.vocabulary_terms(read_table(spark, sf_dir, "benchmark"))
    hits = ev.vocabulary_coverage(spread(read_table(spark, sf_dir, "documents")), terms, "doc_id")
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("hits").alias("hits"))


@query
def vocabulary_missed(spark, sf_dir):
    terms = ev.vocabulary_terms(read_table(spark, sf_dir, "benchmark"))
    conv = read_table(spark, sf_dir, "conversations")
    pairs = ev.pair_cases(fx.reference_cases(conv), fx.hypotheses(conv), ["conv_id", "turn"])
    missed = ev.missed_terms(pairs, terms, ["conv_id", "turn", "model"])
    return missed.groupBy("model", "term").agg(F.count(F.lit(1)).alias("n_cases"))


# ---------------------------------------------------------------- session archive
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents assembled from the stage outputs of each conversation."""
    st = segment_times(spark, sf_dir)
    seg = F.struct(F.col("start_time"), F.col("end_time"), F.col("text"), F.lit(None).cast("string").alias("speaker"))
    segs = (ordered.ordered_collect(st, "session_id", "seg_no", seg, "segments")
            .withColumn("duration", F.array_max(F.transform("segments", lambda x: x["end_time"])))
            .withColumnRenamed("session_id", "conv_id"))
    qa_t = qa.with_clean_qa(labelled_text(spark, sf_dir), "qa_raw", "qa_text").select("conv_id", "qa_text")
    j = (transcripts(spark, sf_dir).join(segs, "conv_id")
         .join(presentation_text(spark, sf_dir), "conv_id", "left").join(qa_t, "conv_id", "left")
         .join(summary_of_all(spark, sf_dir).select("conv_id", F.struct("content", "key_points", "action_items", "topics").alias("summary")),
               "conv_id", "left"))
    sid = F.sha2(F.col("conv_id").cast("string"), 256)
    meta = F.struct(sid.alias("session_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("created_at"),
                    F.concat(F.lit("session "), F.col("conv_id").cast("string")).alias("title"),
                    F.col("duration").alias("duration_seconds"),
                    F.parse_json(F.to_json(F.create_map(F.lit("turns"), F.col("n_segments")))).alias("extra_info"))
    tr = F.struct(F.col("raw_text"), F.col("segments"), F.lit(None).cast("string").alias("language"))
    return j.select("conv_id", sid.alias("session_id"), meta.alias("metadata"), tr.alias("transcript"),
                    F.col("presentation").alias("presentation_text"), F.col("qa_text").alias("structured_qa_text"),
                    F.col("summary").alias("summary"))


@query
def session_roundtrip(spark, sf_dir):
    s = sessions(spark, sf_dir)
    docs = s.select("conv_id", pjson.to_document(arch.session_struct(s)).alias("document"))
    back = arch.from_json_documents(docs)
    ok = F.coalesce(pjson.to_document(F.col("_s")) == F.col("document"), F.lit(False))
    return back.select(F.col("_s.session_id").alias("session_id"), ok.alias("roundtrip_ok"),
                       F.col("_s.metadata.title").alias("title"),
                       F.size("_s.transcript.segments").cast("long").alias("n_segments"),
                       F.length("_s.transcript.raw_text").cast("long").alias("raw_chars"),
                       F.size("_s.summary.topics").cast("long").alias("n_topics"),
                       F.get_json_object("document", "$.metadata.extra_info.turns").cast("long").alias("turns"))


def saved_archive(spark: SparkSession, sf_dir: str) -> str:
    """Path of an archive after two runs: every session as version 1, then every
    third one as version 2, written twice by a run that was retried."""
    s = store.stage_table(sessions(spark, sf_dir).withColumn("version", F.lit(1).cast("long")), "sessions")
    upd = (s.where(F.col("conv_id") % 3 == 0).withColumn("version", F.lit(2).cast("long"))
           .withColumn("metadata", F.col("metadata").withField("title", F.concat(F.col("metadata.title"), F.lit(" (v2)")))))
    path = work_path(spark, "archive")
    arch.save_sessions(s.unionByName(s.where(F.col("conv_id") % 4 == 0)), path, run_id="r1")  # the first save has repeated ids
    for _ in range(2):
        arch.save_sessions(upd, path, run_id="r2")
    return path


@query
def session_upsert(spark, sf_dir):
    return arch.archive(spark, saved_archive(spark, sf_dir), F.col("session_id"), F.col("version"),
                        F.get_json_object("document", "$.metadata.title").alias("title"),
                        F.length("presentation_text").cast("long").alias("presentation_chars"),
                        F.length("structured_qa_text").cast("long").alias("qa_chars"))


@query
def session_lookup(spark, sf_dir):
    path = saved_archive(spark, sf_dir)
    ids = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    sid = ids.select("conv_id", F.sha2(F.col("conv_id").cast("string"), 256).alias("session_id"))
    broken = arch.archive(spark, path).join(sid.where(F.col("conv_id") % 7 == 0), "session_id").select(
        "session_id", (F.col("version") + 1).alias("version"), "presentation_text", "structured_qa_text", F.substring("document", 1, 40).alias("document"))
    store.write_keyed(broken, path, "session_id", "r3")
    unknown = ids.where(F.col("conv_id") % 5 == 0).select(F.sha2((F.col("conv_id") + 1000000).cast("string"), 256).alias("session_id"))
    res = arch.lookup_in(spark, path, sid.select("session_id").unionByName(unknown))
    return res.select("session_id", "status", F.col("session.metadata.title").alias("title"))


@query
def archive_compact(spark, sf_dir):
    """K4 compaction: ten runs of the archive, each with a tenth of the sessions and again every third of those saved before,
    merged into one file a bucket. What the archive holds before, after, and after the covered runs are deleted."""
    s = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    s = s.select("conv_id", F.sha2(F.col("conv_id").cast("string"), 256).alias("session_id"), "n")
    path = work_path(spark, "archive")
    for r in range(10):
        rows = s.where((F.col("conv_id") % 10 <= r) & ((F.col("conv_id") % 10 == r) | (F.col("conv_id") % 3 == 0)))
        rows = rows.select("session_id", F.lit(r).cast("long").alias("version"), F.lit(None).cast("string").alias("presentation_text"),
                           F.lit("").alias("structured_qa_text"), F.to_json(F.struct("session_id", "n")).alias("document"))
        store.write_keyed(rows, path, "session_id", f"r{r}", buckets=16)

    def held(state):
        rows = arch.archive(spark, path)
        return store.stage_table(rows.select(F.lit(state).alias("state"), "session_id", "version", F.col("run_id").alias("run"), "document"), "held")

    before = held("before")
    base = arch.compact(spark, path)
    after = held("after")
    files = spark.read.parquet(f"{path}/run_id={base}").select(F.input_file_name().alias("f")).distinct().count()
    assert store.live_runs(spark, path) == [base] and files <= 16
    store.purge(spark, path)
    return before.unionByName(after).unionByName(held("purged"))


@query
def session_load(spark, sf_dir):
    """S4 on documents of eight shapes: complete, other forms of time, optional or
    required parts missing, broken."""
    raw = transcripts(spark, sf_dir)
    sid = F.sha2(F.col("conv_id").cast("string"), 256)
    shape = F.col("conv_id") % 8
    q_ = lambda c: F.to_json(F.struct(c.alias("x")))
    text = F.regexp_extract(q_(F.col("raw_text")), r'^\{"x":(.*)\}$', 1)
    created = (F.when(shape == 1, F.lit("2024-03-05T06:07:08")).when(shape == 2, F.lit("2024-03-05T08:07:08+02:00"))
               .when(shape == 3, F.lit("yesterday")).otherwise(F.lit("2024-03-05T06:07:08.5+00:00")))
    meta = F.concat(F.lit('"metadata":{"session_id":"'), sid, F.lit('","created_at":"'), created, F.lit('","extra_info":{"n":'), F.col("n_segments").cast("string"), F.lit("}}"))
    tr = (F.when(shape == 4, F.lit('"transcript":{}')).when(shape == 5, F.lit('"transcript":{"segments":[]}'))
          .otherwise(F.concat(F.lit('"transcript":{"raw_text":'), text, F.lit("}"))))
    doc = F.concat(F.lit('{"session_id":"'), sid, F.lit('",'), meta, F.lit(","), tr, F.lit(',"summary":{}}'))
    doc = F.when(shape == 6, F.substring(doc, 1, 50)).otherwise(doc)
    r = arch.from_json_documents(raw.select("conv_id", doc.alias("document")))
    return r.select("conv_id", "status", "error", F.unix_seconds("_s.metadata.created_at").alias("created_s"),
                    F.col("_s.transcript").isNotNull().alias("has_transcript"), F.size("_s.transcript.segments").cast("long").alias("n_segments"),
                    F.length("_s.transcript.raw_text").cast("long").alias("raw_chars"), F.col("_s.summary").isNull().alias("no_summary"),
                    F.try_variant_get("_s.metadata.extra_info", "$.n", "long").alias("n"))


@query
def sink_rerun(spark, sf_dir):
    """K1-K3: all stems written, then every third one again with another text; all
    stems are still there, and the later text wins."""
    d = read_table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("stem"), "doc_id", "text", "lang")
    seg = F.array(F.struct(F.lit(0.0).alias("start_time"), F.lit(0.0).alias("end_time"), F.col("text").alias("text"), F.lit(None).cast("string").alias("speaker")))
    tr = d.withColumn("transcript", F.struct(F.col("text").alias("raw_text"), seg.alias("segments"), F.col("lang").alias("language")))
    path = work_path(spark, "sinks")
    again = lambda df: df.where(F.col("doc_id") % 3 == 0)
    changed = again(tr).withColumn("transcript", F.col("transcript").withField("raw_text", F.concat(F.lit("again "), F.col("text"))))
    sinks.write_transcripts(tr, f"{path}/k1", "r1"), sinks.write_transcripts(changed, f"{path}/k1", "r2")
    st = d.select("stem", "doc_id", F.col("text").alias("presentation_text"), F.lit("").alias("structured_qa_text"))
    sinks.write_structure(st, f"{path}/k2", "r1")
    sinks.write_structure(again(st).withColumn("structured_qa_text", F.lit("[Answer]: yes")), f"{path}/k2", "r2")
    empty = F.array().cast("array<string>")
    su = d.select(F.col("stem").alias("base"), "doc_id", F.col("lang").alias("content"), empty.alias("key_points"), empty.alias("action_items"), F.array("lang").alias("topics"))
    sinks.write_summaries(su, f"{path}/k3", "r1"), sinks.write_summaries(again(su).withColumn("content", F.lit(None).cast("string")), f"{path}/k3", "r2")
    n = lambda c, out: c.cast("long").alias(out)
    k1 = sinks.read_outputs(spark, f"{path}/k1", "stem", n(F.length("raw_text"), "raw_chars"), n(F.size("segments"), "n_segments"), F.col("language"))
    k2 = sinks.read_outputs(spark, f"{path}/k2", "stem", n(F.length("presentation_text"), "presentation_chars"), F.col("structured_qa_text"))
    k3 = sinks.read_outputs(spark, f"{path}/k3", "base").withColumnRenamed("base", "stem")
    return k1.join(k2, "stem", "full").join(k3, "stem", "full").select(
        "stem", "raw_chars", "n_segments", "language", "presentation_chars", "structured_qa_text", "summary_json", "summary_txt")


@query
def exported_files(spark, sf_dir):
    """K1, K2, K4 as files and S1-S4 over their folder: names that begin with ``_`` or ``.`` are listed, text files are no
    sessions, sessions no transcripts."""
    t = transcripts(spark, sf_dir).join(labelled_text(spark, sf_dir), "conv_id", "left")
    t = qa.with_clean_qa(t.withColumn("qa_raw", F.coalesce("qa_raw", F.lit(""))), "qa_raw", "qa_text")
    first = F.element_at(F.array(F.lit("_"), F.lit("."), F.lit("c")), (F.col("conv_id") % 3 + 1).cast("int"))
    t = store.stage_table(t.withColumn("stem", F.concat(first, F.col("conv_id").cast("string"))), "export")
    folder = work_path(spark, "files")
    sinks.export_transcripts(t, folder)
    sinks.export_structure(t.select("stem", F.col("raw_text").alias("presentation_text"), F.when(F.col("conv_id") % 4 > 0, F.col("qa_text")).alias("structured_qa_text")), folder)
    doc = F.to_json(F.struct(F.col("stem").alias("session_id"), F.struct(F.col("stem").alias("session_id"), F.lit("2024-01-02T03:04:05").alias("created_at")).alias("metadata")))
    sinks.export_sessions(t.select(F.col("stem").alias("session_id"), F.when(F.col("conv_id") % 5 > 0, doc).otherwise(F.lit("{")).alias("document"),
                                   F.lit(None).cast("string").alias("presentation_text"), F.lit(None).cast("string").alias("structured_qa_text")), folder)
    sinks.write_files(t.select(F.concat("stem", F.when(F.col("conv_id") % 2 == 0, F.lit(".wav")).otherwise(F.lit(".WAV"))).alias("name"), F.encode("raw_text", "UTF-8").alias("content")), folder)
    n = lambda c: F.length(c).cast("long").alias("chars")
    return (files.scan_audio(spark, folder).select(F.lit("audio").alias("kind"), "stem", F.length(F.decode("content", "UTF-8")).cast("long").alias("chars"))
            .unionByName(files.scan_transcripts(spark, folder).select(F.lit("transcript").alias("kind"), "stem", n("text")))
            .unionByName(files.scan_qa(spark, folder).select(F.lit("qa").alias("kind"), "stem", n("text")))
            .unionByName(arch.load_sessions(spark, folder).select(F.col("status").alias("kind"), inc.stem(F.element_at(F.split("file", "/"), -1)).alias("stem"), F.lit(0).cast("long").alias("chars"))))


# ---------------------------------------------------------------- transcription, run status
def audio_payloads(spark: SparkSession, sf_dir: str, corrupt_every: int | None = None) -> DataFrame:
    """(conv_id, path, content): one timed-text 'recording' per session."""
    st = segment_times(spark, sf_dir)
    lines = st.select("session_id", "seg_no", F.to_json(F.struct(F.col("start_time").alias("start"),
                                                                 F.col("end_time").alias("end"), "text")).alias("line"))
    pay = ordered.ordered_concat(lines, "session_id", "seg_no", "line", sep="\n", out="payload")
    content = F.encode("payload", "UTF-8")
    if corrupt_every:
        content = F.when(F.col("session_id") % corrupt_every == 0, F.encode(F.lit("\x00not a recording"), "UTF-8")).otherwise(content)
    return pay.select(F.col("session_id").alias("conv_id"),
                      F.format_string("conv_%d.wav", "session_id").alias("path"), content.alias("content"))


@query
def transcribe_batch(spark, sf_dir):
    recordings = audio_payloads(spark, sf_dir)
    t = providers.transcribe(recordings, "timed_text")
    t = t.withColumn("conv_id", F.regexp_extract("path", r"conv_(\d+)\.wav", 1).cast("long"))
    return t.select("conv_id", F.size("transcript.segments").cast("long").alias("n_segments"),
                    F.col("transcript.raw_text").alias("raw_text"),
                    F.round(F.array_max(F.transform("transcript.segments", lambda s: s["end_time"])), 6).alias("duration_s"))


@query
def transcribe_plain(spark, sf_dir):
    """A provider without timings gives one segment, and the fixed language is recorded."""
    docs = read_table(spark, sf_dir, "documents")
    files_ = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    t = providers.transcribe(files_, "plain_text", language="en", key="doc_id")
    seg = F.col("transcript.segments")
    return t.select("doc_id", F.size(seg).cast("long").alias("n_segments"), seg[0]["end_time"].alias("end_time"),
                    F.length("transcript.raw_text").cast("long").alias("raw_chars"), F.col("transcript.language").alias("language"))


@query
def source_validation(spark, sf_dir):
    """Requested recordings against the listing; missing ones are error rows downstream."""
    listing = audio_payloads(spark, sf_dir)
    ids = read_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    asked = ids.select(F.format_string("conv_%d.wav", F.col("conv_id") + 3).alias("path"))
    checked = files.validate_sources(asked, listing)
    heard = providers.transcribe(checked, "timed_text").select(F.col("path").alias("_p"), "error_class")
    return checked.join(heard, F.col("path") == F.col("_p")).select("path", "status", "error_class")


@query
def session_parts(spark, sf_dir):
    """One part of each session replaced, the others untouched."""
    s = sessions(spark, sf_dir)
    tr = session_ops.with_transcript(s, F.col("transcript").withField("language", F.lit("xx")))
    st = session_ops.with_structure(tr, F.lit("new"), F.col("structured_qa_text"))
    su = session_ops.with_summary(st, F.lit(None).cast(schemas.SUMMARY))
    out = session_ops.with_title(su, F.upper("metadata.title"))
    return out.select("conv_id", F.col("transcript.language").alias("language"), F.size("transcript.segments").cast("long").alias("n_segments"),
                      "presentation_text", F.length("structured_qa_text").cast("long").alias("qa_chars"), F.col("summary").isNull().alias("no_summary"),
                      F.col("metadata.title").alias("title"))


BY_RULES = flow.Pipeline(structurizer=flow.Rules(QA_CUES, QUESTION_CUES), summarizer=flow.Extractive(ACTION_CUES))


@query
def session_status(spark, sf_dir):
    """E1 with failures at each step: missing, unreadable and blank recordings, and one
    whose transcript has no answers to a question."""
    recordings = audio_payloads(spark, sf_dir, corrupt_every=13).withColumn("title", F.lit(None).cast("string"))
    blank = F.encode(F.lit('{"start": 0, "end": 1, "text": " "}'), "UTF-8")
    content = (F.when(F.col("conv_id") % 11 == 3, F.lit(None).cast("binary")).when(F.col("conv_id") % 7 == 2, blank).otherwise(F.col("content")))
    recordings = recordings.withColumn("content", content).withColumn("modificationTime", F.timestamp_seconds(F.lit(1704067200)))
    return flow.status_counts(flow.run_pipeline(recordings, work_path(spark, "archive"), "r1", BY_RULES))


@query
def pipeline_modes(spark, sf_dir):
    """E1 without structuring (summaries of the raw text), and with a summarizing provider that refuses some texts; a
    fixed language. What each archived session holds."""
    def refuse(text):
        if len(text) % 3 == 0:
            raise ValueError("refused")
        return json.dumps({"content": text[:40] + "!", "topics": ["x"]})

    recordings = (audio_payloads(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
                  .withColumn("modificationTime", F.timestamp_seconds(F.lit(1704067200))))
    recordings = store.stage_table(recordings, "recordings")
    model = providers.Provider("summarize", "excerpt", lambda: refuse)
    modes = {"raw": dataclasses.replace(BY_RULES, structurizer=None), "model": dataclasses.replace(BY_RULES, structurizer=None, summarizer=model, language="xx")}
    out = None
    for mode, by in modes.items():
        path = work_path(spark, "archive")
        runs = flow.run_pipeline(recordings, path, "r1", by).select("path", "session_id", "failed_step", "error")
        content = F.get_json_object("document", "$.summary.content")
        doc = arch.archive(spark, path, F.col("session_id").alias("_id"), F.col("structured_qa_text").isNull().alias("no_qa"),
                           F.get_json_object("document", "$.transcript.language").alias("language"),
                           F.when(F.lit(mode == "model"), content).alias("content"), (F.length(content) > 0).alias("has_content"))
        j = runs.join(doc, F.col("session_id") == F.col("_id"), "left")
        part = j.select(F.lit(mode).alias("mode"), F.regexp_extract("path", r"conv_(\d+)", 1).cast("long").alias("conv_id"), "failed_step", "error",
                        "language", F.coalesce("no_qa", F.lit(True)).alias("no_qa"), "content", "has_content")
        out = part if out is None else out.unionByName(part)
    return out


@query
def pipeline_log(spark, sf_dir):
    """A6 over the log that E1 keeps of its own steps: rows and failed rows of each, and that each took time."""
    recordings = audio_payloads(spark, sf_dir, corrupt_every=13).withColumn("title", F.lit(None).cast("string"))
    content = F.when(F.col("conv_id") % 11 == 3, F.lit(None).cast("binary")).otherwise(F.col("content"))
    recordings = recordings.withColumn("content", content).withColumn("modificationTime", F.timestamp_seconds(F.lit(1704067200)))
    path = work_path(spark, "log")
    flow.run_pipeline(recordings, work_path(spark, "archive"), "r1", BY_RULES, log_path=path)
    log = store.read_runs(spark, path)
    timed = timing.step_timing(log.withColumn("bad", F.col("failed") > 0), failed="bad").select(F.col("step").alias("_step"), "n_runs", (F.col("total_s") > 0).alias("timed"))
    return log.join(timed, F.col("step") == F.col("_step")).select("step", "n", "failed", "n_runs", "timed")


@query
def provider_replies(spark, sf_dir):
    """M2 and M3 by a provider (U1, U2): recorded replies of all shapes; bad ones are error rows."""
    asked = structure_responses(spark, sf_dir)
    made = providers.structurize(asked, "recorded", "conv_id", "response")
    told = asked.withColumn("response", F.when(F.col("conv_id") % 5 == 0, F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("content"), F.array(F.lit("a"), F.lit("b")).alias("key_points")))).otherwise(F.col("response")))
    summed = providers.summarize(told, "recorded", "conv_id", "response").select(
        F.col("conv_id").alias("id"), "summary", F.col("error_class").alias("summary_error"))
    return made.join(summed, F.col("conv_id") == F.col("id")).select(
        "conv_id", "error_class", F.length("presentation_text").cast("long").alias("presentation_chars"), "structured_qa_text",
        "summary_error", F.col("summary.content").alias("content"), F.size("summary.key_points").cast("long").alias("n_key_points"))


@query
def stage_rerun(spark, sf_dir):
    """E2 run twice under one id, then once more under another, which skips what the first one did and tries
    the failed ones again: the reports of each run, and the rows that the table holds in the end."""
    outs = fx.stage_outputs(read_table(spark, sf_dir, "labels"))
    sink, found = work_path(spark, "stage"), stage_inputs(spark, sf_dir, 0)

    def stage(df):
        return df.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("Refused")).alias("error_class"))

    reports = [store.stage_table(flow.run_stage(found, "doc_id", "name", stage, sink, "structure", run_id=r, outputs=outs,
                                                required=("presentation", "q_and_a")), "report") for r in ("r1", "r1", "r2")]
    rows = store.latest(store.read_runs(spark, sink), "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    out = rows.select(F.lit("stored").alias("run"), "status", "n")
    for i, r in enumerate(reports):
        out = out.unionByName(r.select(F.lit(f"run{i + 1}").alias("run"), "status", "n"))
    return out


# ---------------------------------------------------------------- streaming
TURN_ROWS = "conv_id long, rows array<struct<turn:bigint,role:string,text:string>>"


def arriving_turns(spark: SparkSession, sf_dir: str, files: int, **options) -> DataFrame:
    """The conversations as a stream of so many files, the turns of each session spread over them; its
    last turn carries the end mark."""
    conv = streaming.end_marked(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "total")
    folder = work_path(spark, "arriving")
    conv.repartition(files, "conv_id", "turn").write.parquet(folder)
    return streaming.files_stream(spark, folder, conv.schema, **options)


def _whole_sessions(rows: DataFrame) -> DataFrame:
    return streaming.assemble(rows, "conv_id", "turn", "total")


def _labelled(sessions_: DataFrame) -> DataFrame:
    """(conv_id, rows, qa_raw) of whole sessions: T9 on the turns of a row; null without a labelled turn."""
    def tag(r):
        return fx.turn_tag(r["role"], r["turn"])

    def line(r):
        content = F.when((F.col("conv_id") + r["turn"]) % 11 == 0, F.lit("")).otherwise(r["text"])
        return F.concat(F.lit("["), tag(r), F.lit("]: "), content)

    lines = F.transform(F.filter("rows", lambda r: tag(r).isNotNull()), line)
    return sessions_.withColumn("qa_raw", F.when(F.size(lines) > 0, F.array_join(lines, "\n")))


def _label_stage(sessions_: DataFrame) -> DataFrame:
    return _labelled(sessions_).select("conv_id", "qa_raw").where(F.col("qa_raw").isNotNull())


def _clean_stage(labelled: DataFrame) -> DataFrame:
    return qa.with_clean_qa(labelled, "qa_raw", "qa_text").select("conv_id", "qa_text")


QA_STAGES = [("sessions", _whole_sessions, TURN_ROWS), ("label", _label_stage, "conv_id long, qa_raw string"), ("clean", _clean_stage, "conv_id long, qa_text string")]


@query
def stream_chain(spark, sf_dir):
    """Turns flow through assembly, labelling and Q&A cleaning as chained streaming stages; the result equals
    the batch qa_render."""
    sink, _ = streaming.chain(arriving_turns(spark, sf_dir, 4), QA_STAGES, name="stream_chain")
    return streaming.committed(spark, sink, "conv_id long, qa_text string")


@query
def stream_split(spark, sf_dir):
    """R1-R2 with each session's turns in five files, one file a micro-batch."""
    sink, _ = streaming.chain(arriving_turns(spark, sf_dir, 5, max_files=1), QA_STAGES, name="stream_split")
    return streaming.committed(spark, sink, "conv_id long, qa_text string")


@query
def stream_replay(spark, sf_dir):
    """J4 after crashes: batches of two stages are replayed, and the chain goes on over the same sinks."""
    root, rows = work_path(spark, "stream_replay"), arriving_turns(spark, sf_dir, 2)
    streaming.chain(rows, QA_STAGES, root=root)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    for i in (0, 1):
        commits = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{i}_{QA_STAGES[i][0]}/checkpoint/commits")
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, True)
    sink, _ = streaming.chain(rows, QA_STAGES, root=root)
    return streaming.committed(spark, sink, "conv_id long, qa_text string")


@query
def stream_transcribe(spark, sf_dir):
    """Recordings as files flow through M1; unreadable ones are quarantined."""
    pay = audio_payloads(spark, sf_dir, corrupt_every=13).select("conv_id", F.decode("content", "UTF-8").alias("value"))
    folder, sink = work_path(spark, "recordings"), work_path(spark, "transcripts")
    # one flat folder: a folder for each recording would cost the stream a listing of its own, one after the other
    pay = pay.select(F.format_string("conv_id=%d.txt", "conv_id").alias("name"), F.concat("value", F.lit("\n")).alias("content"))
    sinks.write_files(pay.repartition(ev.scoring_partitions(spark), "name"), folder)
    schema = "path string, modificationTime timestamp, length long, content binary"
    recordings = streaming.files_stream(spark, folder, schema, fmt="binaryFile", path_glob="*.txt")
    t = providers.transcribe(recordings.select("path", "content"), "timed_text")
    heard = t.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), "error_class",
                     F.size("transcript.segments").cast("long").alias("n_segments"), F.length("transcript.raw_text").cast("long").alias("raw_chars"))
    streaming.run_stage(heard, sink, f"{sink}_checkpoint")
    out = "conv_id long, error_class string, n_segments long, raw_chars long"
    return streaming.committed(spark, sink, out).unionByName(streaming.committed(spark, sink, out, "failed"))


def _answer_stage(sessions_: DataFrame) -> DataFrame:
    """(conv_id, items): the answers of each whole session (T11), or its raw segments."""
    d = qa.with_clean_qa(_labelled(sessions_).withColumn("qa_raw", F.coalesce("qa_raw", F.lit(""))), "qa_raw", "qa_text", blocks_out="runs")
    answers = F.transform(qa.answers_only("runs"), lambda b: F.struct(b["pos"].cast("long").alias("pos"), b["text"].alias("text")))
    raw = F.transform("rows", lambda r: F.struct(r["turn"].alias("pos"), strip(r["text"]).alias("text")))
    return d.select("conv_id", F.when(F.size("runs") > 0, answers).otherwise(raw).alias("items"))


@query
def stream_summaries(spark, sf_dir):
    """Whole sessions and their answers as streaming stages. Summaries read the committed answers, so the
    document frequencies of all of them are those of the whole corpus so far, also for sessions of earlier batches."""
    items = "conv_id long, items array<struct<pos:bigint,text:string>>"
    sink, _ = streaming.chain(arriving_turns(spark, sf_dir, 2, max_files=1), [("sessions", _whole_sessions, TURN_ROWS), ("answers", _answer_stage, items)], name="stream_summaries")
    told = streaming.committed(spark, sink, items)
    rows = told.select("conv_id", F.explode("items").alias("i")).select("conv_id", "i.pos", "i.text")
    t = summ.summary_table(summ.summarize(rows, key="conv_id", action_cues=ACTION_CUES), "conv_id", told)
    return t.select("conv_id", summ.render_report(F.col("content"), F.col("key_points"), F.col("action_items"), F.col("topics")).alias("report"))
