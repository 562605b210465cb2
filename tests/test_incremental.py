from pyspark.sql import functions as F

from parley.operators import incremental as inc


def test_stem_and_base_name(spark):
    df = spark.createDataFrame([("talk.final.txt",), (".hidden",), ("a_q_and_a.txt",), ("x.",)], "n string")
    got = [tuple(r) for r in df.select(inc.stem("n"), inc.base_name(inc.stem("n"))).collect()]
    assert got == [("talk.final", "talk.final"), (".hidden", ".hidden"), ("a_q_and_a", "a"), ("x.", "x.")]


def test_skip_done_requires_all_outputs(spark):
    inputs = spark.createDataFrame([(1, "a.txt"), (2, "b.txt"), (3, "c.txt")], "k long, name string")
    outs = spark.createDataFrame([(1, "presentation"), (1, "q_and_a"), (2, "presentation")], "k long, kind string")
    todo = inc.skip_done(inputs, outs, "k", "kind", ("presentation", "q_and_a"))
    assert sorted(r.k for r in todo.collect()) == [2, 3]  # half-written 2 is redone
    again = inc.skip_done(todo.where(F.col("k") == 1), outs, "k", "kind", ("presentation", "q_and_a"))
    assert again.count() == 0
    forced = inc.select_work(inputs, outs, "k", "name", "kind", ("presentation", "q_and_a"), targets=["A."])
    assert [r.k for r in forced.collect()] == [1]  # targets bypass the done check


def test_long_target_lists_by_index_equal_a_scan(spark):
    import random

    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcAB_.") for _ in range(rnd.randint(0, 14))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, name string")
    for targets in (["abc", "B_", "x", "aab.a", "_b_b"], ["a"], ["zzz"], [], ["", "q"], [None, "cab"]):
        table = spark.createDataFrame([(t,) for t in targets], "target string")
        got = inc.filter_targets_by_index(df, "name", table)
        low = [t.lower() for t in targets if t is not None]
        want = {i for i, n in enumerate(names) if not low or n is not None and any(t in n.lower() for t in low)}
        assert {r.i for r in got.collect()} == want, targets
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert got.columns == ["i", "name"] and "Cartesian" not in plan and " Cross" not in plan


def test_stretches_of_names_are_never_broadcast(spark):
    names = spark.createDataFrame([(i, f"Rec_{i}.txt") for i in range(50)], "i long, name string")
    wanted = spark.createDataFrame([("rec_4",), ("a target that no name has",)], "target string")
    got = inc.filter_targets_by_index(names, "name", wanted)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin [_gram") == 2 and "BroadcastHashJoin [_gram" not in plan
    assert {r.i for r in got.collect()} == {4, *range(40, 50)}
