import shutil

import pytest
from pyspark.sql import functions as F

from parley.streaming import chain as streaming

SCHEMA = "id long, text string"


def marked_empty(rows):
    return rows.withColumn("error_class", F.when(F.length("text") == 0, F.lit("EmptyText")))


def run(spark, src, sink, ckpt, fn=marked_empty, **options):
    return streaming.run_stage(fn(streaming.files_stream(spark, src, SCHEMA, **options)), sink, ckpt)


def ids(spark, sink, status="ok"):
    return sorted(r.id for r in streaming.committed(spark, sink, SCHEMA, status).collect())


def test_stage_processes_new_files_once_and_quarantines(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    spark.createDataFrame([(1, "a"), (2, "")], SCHEMA).write.parquet(src)
    for _ in range(2):  # a second run over the same folder finds nothing new
        run(spark, src, sink, ckpt)
        assert ids(spark, sink) == [1] and ids(spark, sink, "failed") == [2]
    spark.createDataFrame([(3, "c")], SCHEMA).write.mode("append").parquet(src)
    run(spark, src, sink, ckpt)
    assert ids(spark, sink) == [1, 3]


def chained(spark, src, root, **options):
    same = lambda rows: rows
    sink, _ = streaming.chain(streaming.files_stream(spark, src, SCHEMA, **options), [("first", marked_empty, SCHEMA), ("second", same, SCHEMA), ("third", same, SCHEMA)], root=root)
    return sink


@pytest.mark.parametrize("crashed", ["first", "second", "both"])
def test_replay_of_any_stage_leaves_each_row_once(spark, tmp_path, crashed):
    src, root = str(tmp_path / "src"), str(tmp_path / "chain")
    spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], SCHEMA).write.parquet(src)
    sink = chained(spark, src, root)
    assert ids(spark, sink) == [1, 3]
    for stage in {"first": ["0_first"], "second": ["1_second"], "both": ["0_first", "1_second"]}[crashed]:
        shutil.rmtree(f"{root}/{stage}/checkpoint/commits")  # as after a crash between the sink's log and the query's
    spark.createDataFrame([(4, "d")], SCHEMA).write.mode("append").parquet(src)
    assert ids(spark, chained(spark, src, root)) == [1, 3, 4]
    assert ids(spark, streaming.sink_of(root, 0, "first"), "failed") == [2]


def test_files_of_an_unfinished_batch_are_never_read(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "chain")
    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).write.parquet(src)
    first = streaming.sink_of(root, 0, "first")
    run(spark, src, first, f"{root}/0_first/checkpoint")
    shutil.rmtree(f"{root}/0_first/checkpoint/commits")  # as after a crash before the sink's log names the files
    shutil.rmtree(f"{first}/_spark_metadata")
    assert ids(spark, chained(spark, src, root)) == [1, 2]  # the files are there twice, in the log once
    assert len([f for f in (tmp_path / "chain/0_first/data/status=ok").iterdir() if f.name.startswith("part-")]) >= 2


TURNS = "id long, turn long, text string"


def arrivals(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, t, f"{i}.{t}") for i in range(12) for t in range(1 + i)], TURNS)
    src = str(tmp_path / f"src{files}")
    streaming.end_marked(rows, "id", "turn", "total").repartition(files, "id", "turn").write.parquet(src)
    return src


def assembled(spark, src, root, **options):
    rows = streaming.files_stream(spark, src, TURNS + ", total long", **options)
    text = F.array_join(F.transform("rows", lambda r: r["text"]), " ")
    return streaming.chain(rows, [("sessions", lambda r: streaming.assemble(r, "id", "turn", "total"), "id long, rows array<struct<turn:bigint,text:string>>"),
                                  ("text", lambda r: r.select("id", text.alias("text")), SCHEMA)], root=root)[0]


@pytest.mark.parametrize("files", [1, 20])
def test_sessions_are_whole_however_their_rows_arrive(spark, tmp_path, files):
    sink = assembled(spark, arrivals(spark, tmp_path, files), str(tmp_path / "chain"), max_files=1)
    got = {r.id: r.text for r in streaming.committed(spark, sink, SCHEMA).collect()}
    assert got == {i: " ".join(f"{i}.{t}" for t in range(1 + i)) for i in range(12)}


def test_late_rows_are_reported_and_open_sessions_wait(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "chain")
    schema = TURNS + ", total long"
    spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", 2), (2, 1, "d", 2)], schema).write.parquet(src)
    sink = assembled(spark, src, root)
    assert {r.id: r.text for r in streaming.committed(spark, sink, SCHEMA).collect()} == {1: "a b"}
    spark.createDataFrame([(1, 2, "late", None), (2, 0, "c", None)], schema).write.mode("append").parquet(src)
    sink = assembled(spark, src, root)
    assert {r.id: r.text for r in streaming.committed(spark, sink, SCHEMA).collect()} == {1: "a b", 2: "c d"}
    late = streaming.committed(spark, streaming.sink_of(root, 0, "sessions"), "id long, error_class string", "failed").collect()
    assert [(r.id, r.error_class) for r in late] == [(1, "LateRows")]


def test_recordings_arrive_in_one_flat_folder(spark, monkeypatch):
    import os

    from parley.plans import queries
    from parley.streaming import chain
    from tests.conftest import SF_SMALL

    folders, files_stream = [], chain.files_stream
    monkeypatch.setattr(chain, "files_stream", lambda s, folder, *a, **k: (folders.append(folder), files_stream(s, folder, *a, **k))[1])
    n = queries.stream_transcribe(spark, SF_SMALL).count()
    held = os.listdir(folders[0].removeprefix("file:"))
    assert len(held) == n > 0 and all(name.startswith("conv_id=") and name.endswith(".txt") for name in held)
