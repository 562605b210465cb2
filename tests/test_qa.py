from pyspark.sql import functions as F

from parley.functions.qa import parse_blocks, with_clean_qa
from parley.operators.ordered import merge_runs, ordered_concat
from tests.pyoracle import merge, parse, render

TEXTS = [
    "[Question]: Q [Answer]: A",
    "intro [Answer]: a\n[Question]:   \n[Answer]: b\n[Follow-up]: f [Question]: q2",
    "no tags at all",
    "[Answer]: line one\nline two\n[Answer]:\n[Answer]: x",
    "",
]


def test_parse_merge_render_match_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    out = with_clean_qa(df.withColumn("b", parse_blocks("t")), "t", "qa").collect()
    for r in out:
        assert [(b.tag, b.text) for b in r.b] == parse(r.t)
        assert r.qa == render(merge(parse(r.t)))
    assert out[0].qa == "[Question]: Q\n[Answer]: A"  # inline tags -> two lines


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    once = with_clean_qa(df, "t", "qa1")
    twice = with_clean_qa(once, "qa1", "qa2").collect()
    assert all(r.qa1 == r.qa2 for r in twice)


def test_window_form_equals_python_across_chunks(spark):
    tags = ["Question", "Question", "Answer", "Answer", "Answer", "Question", "Answer", "Answer"] * 5
    rows = [(1, i, tags[i], "" if i % 7 == 3 else f"t{i}") for i in range(len(tags))]
    rows += [(2, 0, "Answer", "solo")]
    df = spark.createDataFrame(rows, "k long, pos long, tag string, text string")
    got = merge_runs(df, "k", "pos", "tag", "text", chunk_size=3).orderBy("k", "run_pos").collect()
    exp1 = merge([(t, x) for (k, _p, t, x) in rows if k == 1])
    assert [(r.tag, r.text) for r in got if r.k == 1] == exp1
    assert [(r.tag, r.text) for r in got if r.k == 2] == [("Answer", "solo")]


def test_ordered_concat_two_levels(spark):
    rows = [(7, i, f"w{i}") for i in range(50)] + [(8, 0, "")] + [(8, 1, "x")]
    df = spark.createDataFrame(rows, "k long, p long, t string")
    got = {r.k: r.text for r in ordered_concat(df, "k", "p", "t", chunk_size=4).collect()}
    assert got[7] == " ".join(f"w{i}" for i in range(50))
    assert got[8] == " x"  # empty texts still add a separator


def test_running_sum_and_top_k_across_chunks(spark):
    from parley.operators.ordered import running_sum
    from parley.operators.summary import top_k

    rows = [(1, i, i % 5) for i in range(40)] + [(2, 0, 7)]
    df = spark.createDataFrame(rows, "k long, p long, v long")
    got = {(r.k, r.p): r.running for r in running_sum(df, "k", "p", "v", chunk_size=3).collect()}
    acc = 0
    for i in range(40):
        acc += i % 5
        assert got[(1, i)] == acc
    assert got[(2, 0)] == 7
    ranked = top_k(df, "k", [F.col("v").desc(), F.col("p")], 4).where("k = 1").orderBy("rank")
    assert [(r.p, r.rank) for r in ranked.collect()] == [(4, 1), (9, 2), (14, 3), (19, 4)]
