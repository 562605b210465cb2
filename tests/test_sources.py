import json

from pyspark.sql import functions as F

from parley.operators import providers
from parley.operators.providers import transcribe
from parley.sources import files
from parley.sources import sessions as arch


def test_scan_and_transcribe(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    seg = [{"start": 0.0, "end": 1.5, "text": " hello "}, {"start": 1.5, "end": 3.0, "text": "world"}]
    (d / "a.wav").write_text("\n".join(json.dumps(s) for s in seg))
    (d / "b.mp3").write_text("not json at all")
    (d / "c.WAV").write_text("excluded: case-sensitive glob")
    (d / "talk.txt").write_text("raw text\nof two lines")
    (d / "talk_presentation.txt").write_text("p")
    (d / "talk_q_and_a.txt").write_text("[Question]: q")
    audio = files.scan_audio(spark, str(d))
    assert sorted(r.name for r in audio.collect()) == ["a.wav", "b.mp3"]
    out = {r.path.split("/")[-1]: r for r in transcribe(audio, "timed_text", language="en").collect()}
    assert out["a.wav"].transcript.raw_text == "hello world"
    assert out["a.wav"].transcript.language == "en"
    assert out["b.mp3"].error_class == "TranscriptionError" and out["b.mp3"].transcript is None
    assert [(r.name, r.text) for r in files.scan_transcripts(spark, str(d)).collect()] == [("talk.txt", "raw text\nof two lines")]
    assert [r.text for r in files.scan_qa(spark, str(d)).collect()] == ["[Question]: q"]
    req = spark.createDataFrame([(f"file:{d}/a.wav",), (f"file:{d}/zzz.wav",)], "path string")
    st = {r.path.split("/")[-1]: r.status for r in files.validate_sources(req, audio).collect()}
    assert st == {"a.wav": "ok", "zzz.wav": "missing"}


def test_provider_lookup_options_and_replies(spark):
    import pytest

    with pytest.raises(providers.UnknownProvider, match="timed_text"):
        providers.find("transcribe", "slow")
    with pytest.raises(providers.UnknownOption):
        providers.find("transcribe", " Plain_Text ").bind({"beams": 3})
    with pytest.raises(ValueError):
        providers.add(providers.Provider("summarize", "recorded", lambda: str))
    shout = providers.Provider("structurize", "shout", lambda mark: lambda t: json.dumps({"presentation": t.upper() + mark}), {"mark": "!"})
    texts = spark.createDataFrame([(1, "hello"), (2, None)], "k long, t string")
    got = {r.k: r for r in providers.structurize(texts, shout, "k", "t", mark="?", per_minute=60_000, callers=1).collect()}
    assert got[1].presentation_text == "HELLO?" and got[1].structured_qa_text == "" and got[1].error_class is None
    assert got[2].error_class == "StructuringError"
    replies = spark.createDataFrame([(1, '{"content": "c", "topics": ["t"]}'), (2, "{broken"), (3, "")], "k long, t string")
    got = {r.k: r for r in providers.summarize(replies, "recorded", "k", "t").collect()}
    assert got[1].summary.content == "c" and got[1].summary.key_points == [] and got[1].summary.topics == ["t"]
    assert got[2].error_class == got[3].error_class == "SummarizationError" and got[2].summary is None


def test_structure_reply_must_be_one_object_of_texts(spark):
    from parley.functions.json import parse_structure_response

    rows = ['{"presentation": {"a": 1}}', '{"presentation": 5}', '{"presentation": "p"} trailing', '{"presentation": " p "}']
    df = spark.createDataFrame([(r,) for r in rows], "r string").select(parse_structure_response("r").alias("p"))
    assert [r.p.error for r in df.collect()] == ["field is not text", "field is not text", "invalid json", None]


def test_session_files_are_read_whatever_their_time_form_and_never_dropped(spark, tmp_path):
    doc = {"session_id": "s", "metadata": {"session_id": "s", "created_at": "2024-01-02T03:04:05", "extra_info": {"a": [1, {"b": None}]}},
           "transcript": {"raw_text": "hi", "segments": [{"start_time": 0.0, "end_time": 3.5, "text": "hi"}]}, "summary": {}}
    shapes = {"plain": doc, "zone": {**doc, "metadata": {**doc["metadata"], "created_at": "2024-01-02T03:04:05+00:00"}},
              "no_raw": {**doc, "transcript": {"segments": []}}, "no_time": {**doc, "metadata": {"session_id": "s"}},
              "bad_segment": {**doc, "transcript": {"raw_text": "x", "segments": [{"text": "x"}]}}, "no_transcript": {**doc, "transcript": None}}
    for name, d in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=4))
    (tmp_path / "broken.json").write_text('{"session_id": "s"')
    got = {r.file.split("/")[-1][:-5]: r for r in arch.load_sessions(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.status == "found"} == {"plain", "zone", "no_transcript"}
    assert got["plain"].session.metadata.created_at == got["zone"].session.metadata.created_at
    assert got["plain"].session.summary is None and got["plain"].session.transcript.segments[0].speaker is None
    assert got["no_raw"].error == "missing transcript.raw_text" and got["broken"].error == "not a JSON object"
    assert got["bad_segment"].error == "missing segments" and got["no_time"].error == "missing metadata.created_at"


def test_save_load_upsert_and_lookup(spark, tmp_path):
    import pytest

    from parley.functions.json import to_document
    from parley.schemas import SESSION

    rows = [{"session_id": i, "metadata": {"session_id": i, "created_at": None, "title": t, "duration_seconds": 1.5, "extra_info": None},
             "transcript": None, "presentation_text": p, "structured_qa_text": None, "summary": None}
            for i, t, p in (("a", "old", ""), ("b", "b", None), ("a", "old", ""))]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SESSION.fields)
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", fields).alias("s")).select("s.*")
    df = df.withColumn("metadata", F.col("metadata").withField("created_at", F.lit("2024-01-01").cast("timestamp"))
                       .withField("extra_info", F.parse_json(F.lit('{"n": {"m": 1}}')))).withColumn("version", F.lit(1))
    path = str(tmp_path / "archive")
    arch.save_sessions(df, path)
    assert arch.archive(spark, path).count() == 2  # repeated ids of one save are one session
    newer = df.where("session_id = 'a'").withColumn("version", F.lit(2)).withColumn("metadata", F.col("metadata").withField("title", F.lit("new")))
    arch.save_sessions(newer, path)
    stored = {r.session_id: r for r in arch.archive(spark, path).collect()}
    assert json.loads(stored["a"].document)["metadata"]["title"] == "new" and stored["a"].presentation_text == ""
    assert json.loads(stored["a"].document)["metadata"]["extra_info"] == {"n": {"m": 1}}
    assert json.loads(stored["b"].document)["transcript"] is None
    assert arch.lookup_one(spark, path, "a").metadata.title == "new"
    with pytest.raises(arch.SessionNotFound):
        arch.lookup_one(spark, path, "zzz")
    again = arch.from_json_documents(arch.archive(spark, path))
    assert again.where(to_document(F.col("_s")) == F.col("document")).count() == 2


def test_rerun_keeps_all_other_results(spark, tmp_path):
    from parley.sources import sinks

    path = str(tmp_path / "k2")
    all_ = spark.range(600).select(F.col("id").cast("string").alias("stem"), F.lit("p").alias("presentation_text"), F.lit("q").alias("structured_qa_text"))
    sinks.write_structure(all_, path)
    sinks.write_structure(all_.where("stem = '7'").withColumn("structured_qa_text", F.lit("new")), path)
    out = sinks.read_outputs(spark, path)
    assert out.count() == 600 and out.where("structured_qa_text = 'new'").count() == 1


def test_summary_sink_and_copy_on_write(spark, tmp_path):
    from parley.operators.session import with_title
    from parley.sources.sinks import summary_outputs, write_summaries

    df = spark.createDataFrame([("talk", None, ["k1"], [], ["é topic"])],
                               "base string, content string, key_points array<string>, action_items array<string>, topics array<string>")
    row = summary_outputs(df).first()
    assert json.loads(row.summary_json) == {"content": None, "key_points": ["k1"], "action_items": [], "topics": ["é topic"]}
    assert "é topic" in row.summary_json  # non-ASCII kept
    assert row.summary_txt.startswith("SUMMARY:\nNone\n\nKEY POINTS:\n- k1")
    write_summaries(df.withColumn("content", F.lit("c")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert "run_id" in spark.read.parquet(str(tmp_path / "s")).columns
    meta = spark.createDataFrame([(("id1", "old"),)], "metadata struct<session_id:string,title:string>")
    assert with_title(meta, F.lit("new")).first().metadata.asDict() == {"session_id": "id1", "title": "new"}


def test_verbatim_check_reports_the_distance(spark):
    from parley.operators.structure import with_verbatim_check

    df = spark.createDataFrame([("a b c d", "a b", "[Question]: c [Answer]: d"), ("a b c d", "a x", "[Answer]: d")], "raw string, p string, q string")
    got = [(r.verbatim.ok, r.verbatim.first_diff, r.distance) for r in with_verbatim_check(df, "raw", "p", "q").collect()]
    assert got == [(True, None, 0), (False, 2, 2)]


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    from parley.spark import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Session())
    Context.getCheckpointDir = lambda self: "hdfs://x/shared/0f-uuid"
    assert ensure_checkpoint_dir(Session()) == "hdfs://x/shared"


def test_compaction_keeps_all_rows_in_one_file_a_bucket(spark, tmp_path):
    from parley.sources import store

    path = str(tmp_path / "table")
    rows = spark.range(300).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    store.write_keyed(rows, path, "k", "r0", buckets=8)
    for r in range(1, 10):
        store.write_keyed(rows.where(f"cast(k as int) % 10 = {r}").withColumn("v", F.lit(r)), path, "k", f"r{r}")
    want = {str(i): (i % 10, f"r{i % 10}") for i in range(300)}
    held = lambda: {r.k: (r.v, r.run_id) for r in store.latest(store.read_runs(spark, path), "k").collect()}
    assert held() == want and len(store.live_runs(spark, path)) == 10
    (tmp_path / "table" / "run_id=c0-dead").mkdir()  # a compaction that died before its manifest
    store.write_run(rows, path, "unfinished")
    (tmp_path / "table" / "run_id=unfinished" / "_SUCCESS").unlink()
    base = store.compact(spark, path, "k")
    assert held() == want and store.live_runs(spark, path) == [base]
    files_ = [f for f in (tmp_path / "table" / f"run_id={base}").rglob("*.parquet")]
    assert len(files_) == 8 and len({f.parent for f in files_}) == 8
    assert len(store.purge(spark, path)) == 10 and held() == want
    store.write_keyed(rows.where("k = '7'").withColumn("v", F.lit(99)), path, "k", "s1")
    assert held() == {**want, "7": (99, "s1")}
    store.compact(spark, path, "k")
    assert held() == {**want, "7": (99, "s1")} and len(store.live_runs(spark, path)) == 1


def test_lookup_reads_one_bucket(spark, tmp_path):
    from parley.sources import store

    path = str(tmp_path / "archive")
    rows = spark.range(50).select(F.col("id").cast("string").alias("session_id"), F.lit(1).cast("long").alias("version"), F.lit("p").alias("presentation_text"),
                                  F.lit("q").alias("structured_qa_text"), F.lit("{").alias("document"))
    store.write_keyed(rows, path, "session_id", "r1")
    hit = arch.stored_versions(spark, path, "7")
    assert hit.count() == 1 and hit.select(F.input_file_name()).distinct().count() == 1
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    want = spark.createDataFrame([("7",), ("zzz",)], "session_id string")
    assert {r.session_id: r.status for r in arch.lookup_in(spark, path, want).collect()} == {"7": "corrupt", "zzz": "not_found"}


def test_a_storage_folder_with_text_files_loads(spark, tmp_path):
    doc = {"session_id": "a", "metadata": {"session_id": "a", "created_at": "2024-01-02T03:04:05"}, "presentation_text": "p", "structured_qa_text": "q"}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=4))
    (tmp_path / "a_presentation.txt").write_text("p")
    (tmp_path / "a_q_and_a.txt").write_text("q")
    assert [(r.status, r.session.presentation_text) for r in arch.load_sessions(spark, str(tmp_path)).collect()] == [("found", "p")]


def test_calls_never_exceed_their_rate_and_refused_ones_come_back(spark, tmp_path):
    import time

    seen = str(tmp_path / "seen")

    def asked():
        import os

        os.makedirs(seen, exist_ok=True)

        def ask(text):
            at = time.time()
            with open(f"{seen}/{text}", "a") as f:
                f.write(f"{at}\n")
            if text == "no" or (text in ("3", "8") and len(open(f"{seen}/{text}").readlines()) < 3):
                raise providers.Refused("quota")
            return json.dumps({"content": text})
        return ask

    texts = spark.createDataFrame([(i, str(i)) for i in range(18)] + [(99, "no")], "k long, t string").repartition(7)
    rate = 600.0  # ten a second
    got = {r.k: r for r in providers.summarize(texts, providers.Provider("summarize", "quota", lambda: asked()), "k", "t", per_minute=rate, callers=2).collect()}
    assert {k: got[k].summary.content for k in range(18)} == {k: str(k) for k in range(18)}
    assert got[99].error_class == "SummarizationError" and "Refused" in got[99].error_msg
    calls = sorted(float(x) for f in (tmp_path / "seen").iterdir() for x in f.read_text().split())
    assert len(calls) == 18 + 4 + providers.ATTEMPTS - 0
    for i, t in enumerate(calls):  # in any second: no more than ten, and one a caller at the edge
        assert sum(t <= u < t + 1.0 for u in calls[i:]) <= rate / 60 + 2


def test_a_run_of_a_keyed_table_moves_its_rows_once(spark, tmp_path, monkeypatch):
    from parley.sources import sinks, store

    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 1), (None, "n", 1), (None, "n", 2)], "k string, v string, version long")
    written, write_run = [], store.write_run
    monkeypatch.setattr(store, "write_run", lambda df, *a, **k: (written.append(df), write_run(df, *a, **k))[1])
    out = rows.select(F.col("k").alias("stem"), F.col("v").alias("presentation_text"), F.lit("").alias("structured_qa_text"))
    want = {tuple(r) for r in store.one_per_key(out, "stem").collect()}
    sinks.write_structure(out, str(tmp_path / "k2"), "r1")
    assert written[0]._jdf.queryExecution().sparkPlan().toString().count("REPARTITION") == 1
    assert written[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sinks.read_outputs(spark, str(tmp_path / "k2")).select(*out.columns)
    assert {tuple(r) for r in got.collect()} == want and got.count() == 3
    chars = sinks.read_outputs(spark, str(tmp_path / "k2"), "stem", F.length("structured_qa_text").alias("n"))
    moved = [line for line in chars._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line or "presentation_text" in line]
    assert {tuple(r) for r in chars.collect()} == {(k, 0) for k, _, _ in want} and not any("presentation_text" in line and "Relation" not in line for line in moved)
