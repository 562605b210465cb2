import random

from pyspark.sql import functions as F

from parley.functions.text import normalise_words, with_word_edit_distance, wer_from_counts
from parley.operators.evaluate import macro_wer
from tests.pyoracle import distance, normalise

CASES = ["Eco-friendly at 12 p.m., don't!", "I a m here é m A.M.", "½ x² naïve é a b", "12–4 pm — ok", "",
         "   ", "İstanbul ΣΑΣ", "foo_bar 'q'", "épm pm p\nm", "p m p m a m", "gonna whch rythmn", "a b c"]


def test_normalise_matches_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string")
    got = {r.t: r.w for r in df.select("t", normalise_words("t").alias("w")).collect()}
    for c in CASES:
        assert got[c] == normalise(c), c


def test_word_distance_matches_dp(spark):
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "d", "é", "x"]
    pairs = [([rnd.choice(vocab) for _ in range(rnd.randint(0, 12))],
              [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]) for _ in range(60)]
    big = [f"w{i}" for i in range(700)]  # above the linear-lookup size: binary search path
    pairs.append((big, big[::-1][:650]))
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    got = [r.errors for r in with_word_edit_distance(df, "r", "h").select("errors").collect()]
    assert got == [distance(a, b) for a, b in pairs]


def test_long_pairs_cost_what_their_distance_costs(spark):
    import time

    rnd = random.Random(11)
    a = [f"w{rnd.randrange(3000)}" for _ in range(20_000)]
    b, edits = list(a), 50
    for k in range(edits):  # far apart, so each edit counts
        at = 100 + k * 390
        if k % 3 == 0:
            b[at] = f"new{k}"
        elif k % 3 == 1:
            b.insert(at, f"new{k}")
        else:
            del b[at]
    df = spark.createDataFrame([(a, b), (a, list(a)), (a[:300], [])], "r array<string>, h array<string>")
    with_word_edit_distance(df.limit(1), "r", "h").collect()
    t = time.time()
    assert [r.errors for r in with_word_edit_distance(df, "r", "h").select("errors").collect()] == [edits, 0, 300]
    assert time.time() - t < 10  # the whole matrix has 400 million cells


def test_words_of_one_text_only_need_no_code(spark):
    a, b = [f"a{i}" for i in range(70_000)] + ["x", "y"], [f"b{i}" for i in range(69_990)] + ["x", "z", "y"]
    df = spark.createDataFrame([(["x", "q", "y"], ["x", "y", "r"]), (["p"], ["s"]), (a[-300:], b[-300:])], "r array<string>, h array<string>")
    assert [r.errors for r in with_word_edit_distance(df, "r", "h").collect()] == [2, 1, distance(a[-300:], b[-300:])]


def test_wer_edge_cases(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 3), (5, 2, 4)], "e int, r int, h int")
    got = [r.w for r in df.select(wer_from_counts("e", "r", "h").alias("w")).collect()]
    assert got == [0.0, 1.0, 2.5]  # empty ref, heard words; WER may exceed 1


# Golden fixture: integer errors per clip and model reproduce the published
# accuracy table and its macro averages (two decimals).
WORDS = {"cassie": 53, "nicholas": 60, "suzanne": 57, "yangxu": 60}
ERRORS = {
    "base": (8, 5, 10, 30), "small": (10, 8, 4, 3), "medium": (8, 4, 2, 3),
    "turbo": (9, 5, 3, 2), "large-v3": (9, 0, 2, 2), "cloud": (7, 4, 5, 5),
}
PUBLISHED_AVG_ACC = {"base": 77.26, "small": 88.95, "medium": 92.43, "turbo": 91.52, "large-v3": 94.04, "cloud": 90.76}


def test_golden_macro_average(spark):
    rows = [(m, clip, e, WORDS[clip]) for m, errs in ERRORS.items() for clip, e in zip(WORDS, errs)]
    df = spark.createDataFrame(rows, "model string, case string, errors int, ref_words int")
    scored = df.withColumn("wer", wer_from_counts("errors", "ref_words", F.lit(1)))
    got = {r.model: round(100 * r.avg_accuracy, 2) for r in macro_wer(scored).collect()}
    assert got == PUBLISHED_AVG_ACC


def test_sql_functions_equal_the_dataframe_ones(spark):
    from parley.functions import qa, sql

    sql.register(spark)
    rnd = random.Random(5)
    texts = CASES + ["[Question]: a [Follow-up]: b \n[Answer]: c [Answer]: [Answer]: d", "no tags", "[Answer]:", "x [Question]: q\n[Question]: r [question]: s"]
    df = spark.createDataFrame([(t, " ".join(rnd.choice("abc") for _ in range(5))) for t in texts], "t string, u string")
    df.createOrReplaceTempView("sql_texts")
    both = qa.with_clean_qa(df.withColumn("w", normalise_words("t")), "t", "clean", blocks_out="runs")
    want = sorted((r.t, r.w, r.clean, [b.text for b in r.ans]) for r in both.withColumn("ans", qa.answers_only("runs")).collect())
    got = spark.sql("SELECT t, parley_words(t) AS w, parley_qa(t) AS clean, parley_answers(t) AS ans FROM sql_texts").collect()
    assert sorted((r.t, r.w, r.clean, r.ans) for r in got) == want
    errors = spark.sql("SELECT t, u, parley_word_errors(t, u) AS e, parley_wer(t, u) AS wer FROM sql_texts").collect()
    assert all(r.e == distance(normalise(r.t), normalise(r.u)) and abs(r.wer - (r.e / len(normalise(r.t)) if normalise(r.t) else 1.0)) < 1e-12 for r in errors)
    rows = spark.sql("SELECT t, b.pos, b.tag, b.text FROM sql_texts, LATERAL parley_block_rows(t) b").collect()
    assert sorted((r.t, r.pos, r.tag, r.text) for r in rows) == sorted((r.t, b.pos, b.tag, b.text) for r in df.select("t", qa.parse_blocks("t").alias("b")).collect() for b in r.b)


def test_words_of_one_hash_code_are_told_apart(spark):
    """Most pairs are compared by hash codes of their words, and one with two words of one code by the words' numbers."""
    from parley.functions import text as tx

    codes = spark.range(4000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w")).withColumn("c", tx._hash_codes(F.array("w"))[0])
    one, other = codes.groupBy("c").agg(F.sort_array(F.collect_list("w")).alias("ws")).where(F.size("ws") > 1).orderBy("c").first().ws[:2]
    df = spark.createDataFrame([(["a", one, "b"], ["a", other, "b"]), (["a", one, "b"], ["a", "c", "b"]), (["a", one], [other, one]), ([], []), (None, ["a"])], "r array<string>, h array<string>")
    told = [r[0] for r in df.select(tx.tells_apart(F.array_union("r", "h"))).collect()]
    assert told == [False, True, False, True, None]
    assert [r.errors for r in with_word_edit_distance(df, "r", "h").collect()] == [1, 1, 1, 0, None]


def test_times_of_day_are_glued_between_any_characters(spark):
    texts = ["p m", "5 p m.", "up m", "p mx", "p p m", "pp m", "a m a m", "xa m", "éa m", "p m", "am pm", "a  m", "_p m", "-p m", "a p m"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalise_words("t")).collect()]
    assert got == [["pm"], ["5", "pm"], ["up", "m"], ["p", "mx"], ["p", "pm"], ["pp", "m"], ["am", "am"], ["xa", "m"], ["éa", "m"], ["pm"], ["am", "pm"], ["am"],
                   ["_p", "m"], ["pm"], ["a", "pm"]]
