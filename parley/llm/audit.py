"""Operator 12: audit of how filters interact. DataFrame functions only.

Five filters judge every text; the set of filters that a document fails is a mask of
five bits. All questions about orders of the filters are questions about coalitions:
what a set of filters removes together, whatever the order inside the set. So the
documents of a part are tabulated once into the removals of all 32 coalitions. A
step of an order removes what its coalition removes beyond the coalition before it.

Shapley values come from exact constrained least squares: the additive model of the
coalition removals with Shapley kernel weights, under the constraint that all
filters together explain what the full coalition removes. Its normal equations do not
depend on the removals, so they are solved once, in rationals, for the removals of
each coalition as unknowns; the solution is a weight per filter and coalition.

Filter E needs the smallest id of each text: texts are grouped by two 64-bit hashes and
their length, with counts before the shuffle; only texts that occur twice or more meet the
documents again, in an equi-join that splits hot texts. The measures of a document are
stored once, without its text.

Defined results: a null text counts as empty; a null source is the part ``""``, together
with an empty source; a document with a null id has no smaller one and is smaller
than none, and no label; rows that agree in id do not count as smaller than each other;
labels repeated for an id count as set if any of them is; labels without a document
are ignored; a document without words fails A only (and E); an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialise, words

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1


def failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails (bit 0 is A)."""
    t = F.coalesce(text, F.lit(""))
    w = words(text)
    n = F.size(w)
    conditions = (
        n < 200,
        100 * F.size(F.array_distinct(w)) < 50 * n,
        100 * (F.size(F.split(t, "[A-Z]", -1)) - 1) > 2 * F.length(t),
        t.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for i, failed in enumerate(conditions):
        mask = mask + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solutions of matrix x = column, for every column of ``right``, by elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for k in range(n):
        at = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [v - rows[i][k] * u for v, u in zip(rows[i], rows[k])]
    return [r[n:] for r in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """filters x coalitions: the weight that a coalition's removals have in a filter's Shapley value.

    Least squares of v(S) by the sum of its members' values, weighted by the Shapley
    kernel (n - 1) / (C(n, s) s (n - s)), with one Lagrange multiplier for the full coalition.
    """
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    proper = range(1, 2 ** n - 1)
    weight = {S: kernel[S.bit_count()] for S in proper}
    bit = lambda S, i: S >> i & 1
    normal = [[sum((weight[S] for S in proper if bit(S, i) and bit(S, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    right = [[weight.get(S, Fraction(0)) * bit(S, i) for S in range(2 ** n)] for i in range(n)]
    right.append([Fraction(S == 2 ** n - 1) for S in range(2 ** n)])
    return solve(normal, right)[:n]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document: the five filters that it fails, and its labels."""
    text = F.coalesce("text", F.lit(""))
    narrow = materialise(docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("mask"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(12), text).alias("h2"), F.length(text).alias("size")), "audit_masks")
    key = ["h1", "h2", "size"]
    # stored, so that the join has no aggregation beside it and Spark can split hot texts
    first = materialise(narrow.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "audit_first")
    copies = narrow.join(first, key, "left")
    copies = copies.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first_id"), F.lit(16)).otherwise(F.lit(0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = copies.join(known, F.col("doc_id") == F.col("label_id"), "left")
    return joined.select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def coalitions(marked: DataFrame) -> DataFrame:
    """(part, total, removed, good, toxic: arrays over the 32 coalitions, unique: array over the filters)."""
    few = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    hit = lambda S: F.col("mask").bitwiseAND(F.lit(S)) != 0
    table = lambda c: F.array(*[F.coalesce(F.sum(F.when(hit(S), F.col(c))), F.lit(0)).cast("long") for S in range(ALL + 1)])
    only = F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << i, F.col("n"))), F.lit(0)).cast("long") for i in range(len(FILTERS))])
    return few.groupBy("part").agg(F.sum("n").cast("long").alias("total"), table("n").alias("v"), table("good").alias("good"),
                                   table("toxic").alias("toxic"), only.alias("only"))


def steps() -> Column:
    """All steps of all orders: filter_order, step, its filter's place, the coalitions before and after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order):
            out.append(F.struct(F.lit("".join(FILTERS[j] for j in order)).alias("filter_order"), F.lit(k + 1).alias("step"),
                                F.lit(i).alias("i"), F.lit(before).alias("before"), F.lit(before | 1 << i).alias("after")))
            before |= 1 << i
    return F.array(*out)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row per part, order and step."""
    n = len(FILTERS)
    tabulated = materialise(coalitions(masks(docs, labels)), "audit_coalitions")
    orders = factorial(n)
    values = []
    for row in shapley_weights(n):
        scaled = [w * orders for w in row]  # whole numbers: a sum over all orders
        assert all(w.denominator == 1 for w in scaled)
        total = F.lit(0).cast("long")
        for S, w in enumerate(scaled):
            if w:
                total = total + F.lit(int(w)) * F.get("v", F.lit(S))
        values.append(total)
    rows = tabulated.withColumn("values", F.array(*values)).withColumn("s", F.explode(steps()))
    at = lambda c, s: F.get(c, F.col(f"s.{s}"))
    gain = lambda c: at(c, "after") - at(c, "before")
    fails = F.get("v", F.call_function("shiftleft", F.lit(1), F.col("s.i")))
    return rows.select("part", "s.filter_order", "s.step", (F.col("total") - at("v", "after")).alias("kept"), gain("v").alias("removed"),
                       (fails - gain("v")).alias("redundant"), at("only", "i").alias("unique_fails"), gain("good").alias("good_lost"),
                       gain("toxic").alias("toxic_lost"), at("values", "i").alias("shapley"))
