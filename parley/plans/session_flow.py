"""The session pipeline (E1) and the batch stage runner.

E1: validate the sources, initialise sessions, transcribe, structure (or not), choose the
summary's input, summarise, archive. Each stage's output is stored and is the
next one's input; a session that fails a step stops there, and its status is read
from what was stored. Both keep a log of their steps (A6).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import incremental as inc
from parley.operators import providers, structure
from parley.operators import summary as summ
from parley.operators.session import init_session, require_text, summary_input
from parley.operators.timing import StepLog
from parley.functions import qa
from parley.functions.text import explode_items
from parley.sources import sessions as arch
from parley.sources import store

STEPS = ("validation", "transcription", "structuring", "summarization", "archiving")
KEY = "session_id"


@dataclass(frozen=True)
class Rules:
    """Structuring by rules: words that open the Q&A, and words that open a question."""

    qa_cues: Sequence[str] = structure.DEFAULT_QA_CUES
    question_cues: Sequence[str] = structure.DEFAULT_QUESTION_CUES


@dataclass(frozen=True)
class Extractive:
    """Summaries from the session's own sentences: words that mark an action item."""

    action_cues: Sequence[str] = summ.DEFAULT_ACTION_CUES


@dataclass(frozen=True)
class Pipeline:
    """What serves each step. A provider is a value or a name; ``structurizer`` None leaves structuring out, and
    summaries are then made of the raw text. ``options`` go to the provider of a stage ("transcribe", "structurize",
    "summarize"), ``per_minute`` and ``callers`` bound the rate of its calls (R4)."""

    transcriber: str | providers.Provider = "timed_text"
    structurizer: str | providers.Provider | Rules | None = Rules()
    summarizer: str | providers.Provider | Extractive = Extractive()
    language: str | None = None
    options: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    per_minute: Mapping[str, float] = field(default_factory=dict)
    callers: Mapping[str, int] = field(default_factory=dict)

    def calls(self, stage: str) -> dict:
        return {"per_minute": self.per_minute.get(stage), "callers": self.callers.get(stage, 1), **self.options.get(stage, {})}


def _structured(texts: DataFrame, by: Pipeline) -> DataFrame:
    """(session_id, presentation_text, structured_qa_text, error_class, error_msg)."""
    none = [F.lit(None).cast("string").alias(c) for c in ("error_class", "error_msg")]
    if by.structurizer is None:
        return texts.select(KEY, *[F.lit(None).cast("string").alias(c) for c in ("presentation_text", "structured_qa_text")], *none)
    if isinstance(by.structurizer, Rules):
        rules = by.structurizer
        return structure.with_structure(texts, "_text", rules.qa_cues, rules.question_cues).select(
            KEY, F.col("presentation").alias("presentation_text"), "structured_qa_text", *none)
    return providers.structurize(texts, by.structurizer, KEY, "_text", **by.calls("structurize"))


def _summarised(usable: DataFrame, by: Pipeline) -> DataFrame:
    """(session_id, summary, error_class, error_msg)."""
    if not isinstance(by.summarizer, Extractive):
        return providers.summarize(usable, by.summarizer, KEY, "_input", **by.calls("summarize"))
    blocks = qa.with_clean_qa(usable, "structured_qa_text", "_clean", blocks_out="_runs")
    answers = blocks.select(KEY, explode_items(qa.answers_only("_runs")).alias("b")).where(F.col("b").isNotNull())
    answers = answers.select(KEY, F.col("b.pos").cast("long").alias("pos"), F.col("b.text").alias("text"))
    with_qa = usable.where(F.length(F.coalesce("structured_qa_text", F.lit(""))) > 0)
    raw = usable.select(KEY, F.lit(0).cast("long").alias("pos"), F.col("_text").alias("text"))
    rows = summ.with_fallback(answers, raw, with_qa, KEY)
    table = summ.summary_table(summ.summarize(rows, KEY, action_cues=by.summarizer.action_cues), KEY, usable)
    return table.select(KEY, F.struct("content", "key_points", "action_items", "topics").alias("summary"),
                        *[F.lit(None).cast("string").alias(c) for c in ("error_class", "error_msg")])


def run_pipeline(files: DataFrame, archive_path: str, run_id: str, by: Pipeline = Pipeline(), log_path: str | None = None) -> DataFrame:
    """Run every step for the files (path, modificationTime, title, content) and archive
    the sessions. Returns (path, session_id, failed_step, error), one row per file.

    ``content`` null means that the file is missing. ``log_path`` names a table to which
    the run's steps are added: rows, failed rows and duration of each.
    """
    spark = files.sparkSession
    log = StepLog(spark, run_id)
    s = init_session(F.col("path"), F.col("modificationTime"), F.col("title"))
    started = log.stored(STEPS[0], files.select("path", "content", s.alias("s")).select("path", "content", "s.*"), "content is null")
    present = started.where(F.col("content").isNotNull())
    heard = log.stored(STEPS[1], providers.transcribe(present, by.transcriber, language=by.language, key=KEY, **by.calls("transcribe")), "error_class is not null")
    good = heard.where(F.col("error_class").isNull()).select(KEY, "transcript", F.col("transcript.raw_text").alias("_text"))
    good = good.withColumn("_bad", require_text(F.col("_text")))
    # a text that cannot be processed fails the first step that reads it
    empty = good.where("_bad is not null").select(KEY, *[F.lit(None).cast("string").alias(c) for c in ("presentation_text", "structured_qa_text")],
                                                  F.col("_bad").alias("error_class"), F.lit(None).cast("string").alias("error_msg"))
    made = _structured(good.where("_bad is null"), by)
    made = log.stored(STEPS[2], made.unionByName(empty) if by.structurizer else made, "error_class is not null")
    parts = good.join(made.where(F.col("error_class").isNull()).drop("error_class", "error_msg"), KEY, "inner" if by.structurizer else "left")
    parts = parts.withColumn("_input", summary_input(F.col("structured_qa_text"), F.col("_text"))).withColumn("_bad", require_text(F.col("_input")))
    parts = store.stage_table(parts, "parts")
    usable = parts.where("_bad is null")
    unusable = parts.where("_bad is not null").select(KEY, F.lit(None).cast("struct<content:string,key_points:array<string>,action_items:array<string>,topics:array<string>>").alias("summary"),
                                                      F.col("_bad").alias("error_class"), F.lit(None).cast("string").alias("error_msg"))
    summed = log.stored(STEPS[3], _summarised(usable, by).unionByName(unusable), "error_class is not null")
    done = usable.join(summed.where(F.col("error_class").isNull()).drop("error_class", "error_msg"), KEY).join(started.drop("content", "path"), KEY)
    done = done.withColumn("metadata", F.struct(
        F.col(KEY), "created_at", "title", F.array_max(F.transform("transcript.segments", lambda x: x["end_time"])).alias("duration_seconds"),
        F.parse_json(F.lit("{}")).alias("extra_info"))).withColumn("version", F.unix_micros("created_at"))
    try:
        log.step(STEPS[4], done, lambda d: arch.save_sessions(d, archive_path, run_id=run_id))
        saved = store.read_runs(spark, archive_path, [run_id]).select(F.col(KEY).alias("_saved"))  # what this run stored
        lost = F.lit("StorageError")
    except Exception as exc:  # the sessions are reported, each as one whose archiving failed
        log.records.append((run_id, STEPS[4], None, None, None, None))
        saved, lost = spark.createDataFrame([], "_saved string"), F.lit(f"StorageError: {type(exc).__name__}")
    if log_path:
        log.save(log_path)
    one = lambda df, step: df.where(F.col("error_class").isNotNull()).select(F.col(KEY).alias("_id"), F.lit(step).alias("failed_step"), F.col("error_class").alias("error"))
    missing = started.where(F.col("content").isNull()).withColumn("error_class", F.lit("MissingSource"))
    failures = one(missing, STEPS[0])
    for table, step in ((heard, STEPS[1]), (made, STEPS[2]), (summed, STEPS[3])):
        failures = failures.unionByName(one(table, step))
    out = started.select("path", KEY).join(failures, F.col(KEY) == F.col("_id"), "left").join(saved, F.col(KEY) == F.col("_saved"), "left")
    gone = F.col("failed_step").isNull() & F.col("_saved").isNull()
    return out.select("path", KEY, F.when(gone, F.lit(STEPS[4])).otherwise(F.col("failed_step")).alias("failed_step"),
                      F.when(gone, lost).otherwise(F.col("error")).alias("error"))


def status_counts(runs: DataFrame) -> DataFrame:
    """(step, status, n) of rows with a ``failed_step``: ok before it, skipped after it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("step")) for i, s in enumerate(STEPS)])
    at = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("failed_step")) - 1
    x = runs.select(at.alias("at"), F.explode(steps).alias("x"))
    status = (F.when(F.col("at").isNull() | (F.col("x.i") < F.col("at")), F.lit("ok"))
              .when(F.col("x.i") == F.col("at"), F.lit("failed")).otherwise(F.lit("skipped")))
    return x.groupBy("x.step", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run_stage(inputs: DataFrame, key: str, name_col: str, stage_fn: Callable[[DataFrame], DataFrame], sink: str, stage_name: str,
              run_id: str | None = None, targets: Sequence[str] | None = None, outputs: DataFrame | None = None, kind_col: str = "kind",
              required: Sequence[str] = (), log_path: str | None = None) -> DataFrame:
    """E2 (batch): P2 target filter -> J1/J3 work selection -> stage -> sink, and the
    A7 report of this run.

    Inputs with a good result in a finished run of ``sink`` are done, and those whose ``required`` kinds of
    ``outputs`` exist elsewhere; failed ones are tried again, and explicit targets run in any case. ``stage_fn`` maps
    the selected rows to rows with an ``error_class`` column. Its rows are written once, as one run of the table at
    ``sink`` with folders by status (R5: the failed ones are the quarantine), and the report counts what was
    stored. The same ``run_id`` again replaces that run, and does not count its results as done."""
    spark = inputs.sparkSession
    found = inc.filter_targets(inputs, name_col, targets)
    run_id = run_id or store.new_run_id()
    todo = found
    if not targets:
        done = store.done_keys(spark, sink, key, without_run=run_id)
        if done is not None:
            # a history that outgrows the inputs is first cut to their keys: a join that Spark prunes by a Bloom filter of them
            todo = todo.join(done.join(found.select(key), key, "left_semi"), key, "left_anti")
        if outputs is not None:
            todo = inc.skip_done(todo, outputs, key, kind_col, required)
    status = F.when(F.col("error_class").isNull(), F.lit("ok")).otherwise(F.lit("failed"))
    log = StepLog(spark, run_id)
    log.step(stage_name, stage_fn(todo).withColumn("status", status), lambda d: store.write_run(d, sink, run_id, ["status"]), "status = 'failed'")
    if log_path:
        log.save(log_path)
    _, _, _, _, n, failed = log.records[0]
    return inc.run_report(found, n, failed, stage_name)
