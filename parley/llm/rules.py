"""Operator 6: quality rules with adaptive thresholds. DataFrame functions only.

Every text is measured (words, symbols, repeated lines, repeated 5-word windows), once.
For each language and source, mergeable quantile sketches of the measures give the fences
beyond which a document is rejected. A sketch counts values in buckets whose width
grows with the value (relative error 1/32), so partial sketches merge by adding
counts, in any order, with the same result. Counting happens before the shuffle and a group
has a bounded number of buckets, whatever its share of rows.

A document that fails the base rule (too few words, too many repeated words) is
rejected and does not shape the fences. A group's sketch is merged with those of its
language and of the whole corpus, each scaled down to ``BACK_OFF`` documents: a group of few
documents is judged by what is usual around it, one of many by its own. The fences
are the quartiles -/+ SPREAD times the distance between them; nothing else sets
them. A document is rejected if a measure lies beyond its fence by more than ``ERRORS``
times the error of its own measure (the root of the count that it divides, or half its mean
word length over the root of its words), so one symbol in a short text proves nothing.

Defined results: a null or empty text has no words and fails the base rule; a
null language or source is a group of its own; repeated rows are measured and judged
each, and all count in the sketches; long texts are measured whole; an empty table gives an
empty result; extra columns are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WORD, fresh, join_same, materialise, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SPREAD, ERRORS = 3, 3
#: Documents that the sketches of the language and of the corpus count for at most, each, in every group's fences.
BACK_OFF = 100
#: measure: whether low values reject too
MEASURES = {"symbols_per_word": False, "dup_lines_per_line": False, "chars_per_word": True}
#: values below 2**SKETCH_BITS have a bucket each; beyond, buckets have a relative width of 2/2**SKETCH_BITS
SKETCH_BITS = 6
#: Weight of a document of the group itself; scaled ones are whole numbers of such parts.
PARTS = 1 << 20


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number >= 0; grows with the number."""
    shift = F.greatest(F.length(F.bin(v)) - SKETCH_BITS, F.lit(0))
    return shift.cast("long") * 2 ** SKETCH_BITS + F.call_function("shiftright", v, shift)


def bucket_top(b: Column) -> Column:
    """The largest number of a bucket."""
    shift = F.call_function("shiftright", b, F.lit(SKETCH_BITS)).cast("int")
    return F.call_function("shiftleft", b % 2 ** SKETCH_BITS + 1, shift) - 1


def measure(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures of each text added, and the names that the measures got.

    Repeated windows: hashes of all 5-word windows; only if two are equal, they
    are sorted with their positions, and the positions of those that occur twice
    or more tell which words are covered.
    """
    kept = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    names = {n: fresh(docs, n) for n in (*kept, "w", "lines", "grams", "sorted_grams", "twice")}
    c = {k: F.col(v) for k, v in names.items()}
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({
        names["w"]: words(F.col("text")),
        names["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        names["n_symbols"]: (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
    })
    starts = F.sequence(F.lit(1), F.size(c["w"]) - (WINDOW - 1))
    grams = F.transform(starts, lambda i: F.xxhash64(F.slice(c["w"], i, WINDOW)))
    out = out.withColumns({
        names["n_words"]: F.size(c["w"]).cast("long"),
        names["word_chars"]: F.length(F.array_join(c["w"], "")).cast("long"),
        names["n_lines"]: F.size(c["lines"]).cast("long"),
        names["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        names["grams"]: F.when(F.size(c["w"]) >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")),
    })
    pairs = F.array_sort(F.transform(c["grams"], lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn(names["sorted_grams"], F.when(
        F.size(F.array_distinct(c["grams"])) < F.size(c["grams"]), pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    s, t = c["sorted_grams"], c["twice"]
    same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
    out = out.withColumn(names["twice"], F.array_sort(F.transform(
        F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    gap = F.transform(t, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(t, i + 1) - p, F.lit(WINDOW))))
    out = out.withColumn(names["n_repeat_words"], F.aggregate(gap, F.lit(0).cast("long"), lambda acc, x: acc + x))
    return out.drop(*[names[k] for k in ("w", "lines", "grams", "sorted_grams", "twice")]), {k: names[k] for k in kept}


def base_failed(names: dict[str, str]) -> Column:
    n, r = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def ratios(names: dict[str, str]) -> dict[str, tuple[Column, Column]]:
    """The judged measures, in thousandths, and their errors; null without words."""
    c = {k: F.col(v) for k, v in names.items()}
    per = lambda a, b: 1000.0 * a / F.nullif(b, F.lit(0))
    length = per(c["word_chars"], c["n_words"])
    return {"symbols_per_word": (per(c["n_symbols"], c["n_words"]), per(F.sqrt(c["n_symbols"]), c["n_words"])),
            "dup_lines_per_line": (per(c["n_dup_lines"], c["n_lines"]), per(F.sqrt(c["n_dup_lines"]), c["n_lines"])),
            "chars_per_word": (length, length / (2.0 * F.sqrt(c["n_words"])))}


def sketches(measured: DataFrame, names: dict[str, str]) -> DataFrame:
    """(lang, source, measure, bucket, n): one quantile sketch per language, source and measure."""
    entries = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.floor(v).cast("long")).alias("bucket")) for k, (v, _) in ratios(names).items()])
    return (measured.where(~base_failed(names)).select("lang", "source", F.explode(entries).alias("e"))
            .groupBy("lang", "source", F.col("e.measure").alias("measure"), F.col("e.bucket").alias("bucket"))
            .agg(F.count("*").alias("n")))


def packed(sketch: DataFrame, group: list[str], name: str, scaled: bool) -> DataFrame:
    """One row per group: ``name`` is its sketch as an array of (bucket, parts)."""
    per = sketch.groupBy(*group, "bucket").agg(F.sum("n").alias("n")).groupBy(*group).agg(
        F.collect_list(F.struct("bucket", "n")).alias("b"), F.sum("n").alias("total"))
    parts = (lambda x: F.call_function("div", x["n"] * F.least(F.col("total"), F.lit(BACK_OFF)) * PARTS, F.col("total"))) if scaled else (lambda x: x["n"] * PARTS)
    return per.select(*group, F.transform("b", lambda x: F.struct(x["bucket"].alias("bucket"), parts(x).cast("long").alias("parts"))).alias(name))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_<measure>, high_<measure> ...): one row per language and source."""
    own = packed(sketch, ["lang", "source", "measure"], "own", False)
    wide = join_same(own, packed(sketch, ["lang", "measure"], "of_lang", True), ["lang", "measure"])
    wide = join_same(wide, packed(sketch, ["measure"], "of_all", True), ["measure"])
    wide = wide.withColumn("merged", F.array_sort(F.concat("own", "of_lang", "of_all")))
    wide = wide.withColumn("total", F.aggregate("merged", F.lit(0).cast("long"), lambda t, x: t + x["parts"]))
    none = F.lit(None).cast("long")

    def step(acc: Column, x: Column) -> Column:
        upto = acc["upto"] + x["parts"]
        at = lambda q, name: F.when(acc[name].isNull() & (4 * upto >= q * F.col("total")), x["bucket"]).otherwise(acc[name]).alias(name)
        return F.struct(upto.alias("upto"), at(1, "b25"), at(3, "b75"))

    start = F.struct(F.lit(0).cast("long").alias("upto"), none.alias("b25"), none.alias("b75"))
    q = wide.withColumn("q", F.aggregate("merged", start, step)).select(
        "lang", "source", "measure", bucket_top(F.col("q.b25")).alias("q25"), bucket_top(F.col("q.b75")).alias("q75"))
    reach, out = SPREAD * (F.col("q75") - F.col("q25")), []
    for k, both in MEASURES.items():
        here = F.col("measure") == k
        out.append(F.max(F.when(here, F.col("q75") + reach)).alias(f"high_{k}"))
        if both:
            out.append(F.max(F.when(here, F.col("q25") - reach)).alias(f"low_{k}"))
    return q.groupBy("lang", "source").agg(*out)


def beyond(names: dict[str, str], at: dict[str, str]) -> dict[str, Column]:
    """Whether each measure lies beyond its group's fences; ``at`` has the names of the fences."""
    out = {}
    for k, (v, error) in ratios(names).items():
        out[k] = v - ERRORS * error > F.col(at[f"high_{k}"])
        if MEASURES[k]:
            out[k] = out[k] | (v + ERRORS * error < F.col(at[f"low_{k}"]))
    return out


def judged(measured: DataFrame, names: dict[str, str]) -> tuple[DataFrame, Column, dict[str, Column]]:
    """``measured`` with the fences of each row's group, the verdict as a condition on it, and what lies beyond a fence."""
    limits = materialise(fences(sketches(measured, names)), "fences")
    at = {c: fresh(measured, c) for c in limits.columns if c not in ("lang", "source")}
    joined = join_same(measured, limits.withColumnsRenamed(at), ["lang", "source"])
    out = beyond(names, at)
    good = ~base_failed(names)
    for c in out.values():
        good = good & ~c
    return joined, F.coalesce(good, F.lit(False)), out


def measured_rows(docs: DataFrame, *drop: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its measures, stored, and the names of the measures."""
    measured, names = measure(docs)
    return materialise(measured.drop(*drop), "measures"), names


def judge_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    measured, names = measured_rows(docs.select("doc_id", "lang", "source", "text"), "text")
    joined, good, _ = judged(measured, names)
    return joined.select("doc_id", *[F.col(names[k]).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         base_failed(names).alias("base_failed"), good.alias("kept"))


def rejections(docs: DataFrame) -> DataFrame:
    """(rule, n): how many documents the base rule rejects, and how many of the others lie beyond each fence."""
    measured, names = measured_rows(docs.select("doc_id", "lang", "source", "text"), "text")
    joined, _, out = judged(measured, names)
    failed = base_failed(names)
    rules = F.array(F.struct(F.lit("base").alias("rule"), failed.alias("hit")), *[F.struct(F.lit(k).alias("rule"), (~failed & c).alias("hit")) for k, c in out.items()])
    return joined.select(F.explode(rules).alias("r")).groupBy("r.rule").agg(F.sum(F.coalesce(F.col("r.hit"), F.lit(False)).cast("long")).alias("n"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the fences of their group, all columns kept."""
    measured, names = measured_rows(docs)
    joined, good, _ = judged(measured, names)
    return joined.where(good).select(*[joined[c] for c in docs.columns])
