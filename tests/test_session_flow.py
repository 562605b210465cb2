import json

from pyspark.sql import functions as F

from parley.operators import providers, timing
from parley.plans.session_flow import Extractive, Pipeline, Rules, run_pipeline, run_stage, status_counts
from parley.sources import sessions as arch
from parley.sources import store


def test_batch_stage_runner_reports_isolates_and_can_be_retried(spark, tmp_path):
    inputs = spark.createDataFrame([(1, "a.txt", "x"), (2, "b.txt", " "), (3, "c.txt", "z"), (4, "d.txt", "w")],
                                   "k long, name string, text string")
    outputs = spark.createDataFrame([(4, "presentation"), (4, "q_and_a"), (3, "presentation")], "k long, kind string")
    sink = str(tmp_path / "out")

    def stage(df):
        return df.withColumn("error_class", F.when(F.length(F.trim("text")) == 0, F.lit("EmptyText")))

    def report(run, targets=None):
        rep = run_stage(inputs, "k", "name", stage, sink, "structure", run_id=run, targets=targets, outputs=outputs,
                        required=("presentation", "q_and_a"), log_path=str(tmp_path / "log"))
        return {r.status: r.n for r in rep.collect()}

    for run in ("r1", "r1"):  # a retry replaces its run and does its work again
        assert report(run) == {"found": 4, "skipped": 1, "processed": 2, "failed": 1}
    assert report("r2") == {"found": 4, "skipped": 3, "processed": 0, "failed": 1}  # done is skipped, failed is tried again
    assert report("r3", ["A.TXT"]) == {"found": 1, "skipped": 0, "processed": 1, "failed": 0}  # targets run in any case
    rows = store.read_runs(spark, sink)
    assert rows.count() == 5
    now = {r.k: r.status for r in store.latest(rows, "k").collect()}
    assert now == {1: "ok", 2: "failed", 3: "ok"}
    log = timing.step_timing(store.read_runs(spark, str(tmp_path / "log")).withColumn("bad", F.col("failed") > 0), failed="bad").collect()
    assert [(r.step, r.n_runs, r.n_failed) for r in log] == [("structure", 3, 2)]


def test_pipeline_stops_each_session_at_its_first_failure(spark, tmp_path):
    line = lambda t: json.dumps({"start": 0.0, "end": 2.0, "text": t})
    files = spark.createDataFrame([
        ("in/good.wav", bytearray(line("Welcome all. What is new? We will ship it.").encode())),
        ("in/plain.wav", bytearray(line("Only a talk here.").encode())),
        ("in/gone.wav", None), ("in/noise.wav", bytearray(b"\x00noise")), ("in/silent.wav", bytearray(line(" ").encode())),
        ("other/good.wav", bytearray(line("Another one.").encode()))],
        "path string, content binary").withColumn("title", F.lit("")).withColumn("modificationTime", F.lit("2024-01-01").cast("timestamp"))
    path = str(tmp_path / "archive")
    by = Pipeline(structurizer=Rules(("what",), ("what",)), summarizer=Extractive(("will",)))
    runs = run_pipeline(files, path, "r1", by)
    got = {r.path: (r.failed_step, r.error) for r in runs.collect()}
    assert got == {"in/good.wav": (None, None), "in/plain.wav": (None, None), "other/good.wav": (None, None),
                   "in/gone.wav": ("validation", "MissingSource"), "in/noise.wav": ("transcription", "TranscriptionError"),
                   "in/silent.wav": ("structuring", "EmptyText")}
    counts = {(r.step, r.status): r.n for r in status_counts(runs).collect()}
    assert counts[("transcription", "failed")] == 1 and counts[("transcription", "skipped")] == 1 and counts[("archiving", "ok")] == 3
    ids = {r.path: r.session_id for r in runs.collect()}
    assert len(set(ids.values())) == 6  # the same name in two folders is two sessions
    s = arch.lookup_one(spark, path, ids["in/good.wav"])
    assert s.presentation_text == "Welcome all." and s.structured_qa_text == "[Question]: What is new?\n[Answer]: We will ship it."
    assert s.summary.action_items == ["We will ship it."] and s.metadata.title == "good" and s.metadata.created_at is not None
    assert arch.lookup_one(spark, path, ids["in/plain.wav"]).summary.content == "Only a talk here."


def recordings(spark, texts):
    rows = [(f"in/{n}.wav", bytearray(json.dumps({"start": 0.0, "end": 2.0, "text": t}).encode())) for n, t in texts.items()]
    return spark.createDataFrame(rows, "path string, content binary").withColumn("title", F.lit("")).withColumn("modificationTime", F.lit("2024-01-01").cast("timestamp"))


def test_pipeline_without_structuring_summarises_the_raw_text(spark, tmp_path):
    path = str(tmp_path / "archive")
    runs = run_pipeline(recordings(spark, {"a": "Hello there. What now? We stay.", "b": " "}), path, "r1", Pipeline(structurizer=None), log_path=str(tmp_path / "log")).collect()
    assert {r.path: (r.failed_step, r.error) for r in runs} == {"in/a.wav": (None, None), "in/b.wav": ("summarization", "EmptyText")}
    s = arch.lookup_one(spark, path, next(r.session_id for r in runs if r.path == "in/a.wav"))
    assert s.structured_qa_text is None and s.presentation_text is None and s.summary.content == "Hello there. What now? We stay."
    log = {r.step: (r.n, r.failed) for r in store.read_runs(spark, str(tmp_path / "log")).collect()}
    assert log == {"validation": (2, 0), "transcription": (2, 0), "structuring": (1, 0), "summarization": (2, 1), "archiving": (1, 0)}


def test_pipeline_passes_language_options_and_summarizer(spark, tmp_path):
    def reply(mark):
        def ask(text):
            if "bad" in text:
                raise ValueError("no")
            return json.dumps({"content": text + mark})
        return ask

    by = Pipeline(summarizer=providers.Provider("summarize", "m", reply, {"mark": "!"}), structurizer=None, language="xx",
                  options={"summarize": {"mark": "?"}}, per_minute={"summarize": 60_000}, callers={"summarize": 2})
    path = str(tmp_path / "archive")
    runs = run_pipeline(recordings(spark, {"a": "fine", "b": "bad"}), path, "r1", by).collect()
    assert {r.path: (r.failed_step, r.error) for r in runs} == {"in/a.wav": (None, None), "in/b.wav": ("summarization", "SummarizationError")}
    s = arch.lookup_one(spark, path, next(r.session_id for r in runs if r.path == "in/a.wav"))
    assert s.summary.content == "fine?" and s.transcript.language == "xx"


def test_a_session_that_this_run_lost_is_reported(spark, tmp_path, monkeypatch):
    files, path = recordings(spark, {"a": "One thing.", "b": "Another."}), str(tmp_path / "archive")
    run_pipeline(files, path, "r1", Pipeline(structurizer=None))
    monkeypatch.setattr(arch, "save_sessions", lambda d, *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    runs = run_pipeline(files, path, "r2", Pipeline(structurizer=None)).collect()
    assert {(r.failed_step, r.error) for r in runs} == {("archiving", "StorageError: OSError")}
