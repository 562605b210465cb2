"""Operator 8: Order MinHash fingerprints. DataFrame functions only.

A text is its sequence of word k-mers, each numbered by how often it has occurred
before. ``BINS`` permutations order the hashes of (k-mer, number); each selects its
two minimal ones, puts them back into text order and hashes the pair. Two texts agree
in a permutation when the same k-mers are minimal there and stand in the same order,
so the likeness (share of agreeing permutations) falls with the edit distance, also
when words are only moved, in short texts too.

Hashes fall into ``BINS`` bins. Permutation j puts the k-mers of bin j first, by
their hash, and after them all others by a hash of their own for j. So a bin of two
or more k-mers gives its pair at once, and only for the other bins, which are few in
long texts, all k-mers of the text are hashed again.

The document that follows in descending id order is found without a global sort:
documents are cut into ranges of about ``RANGE_ROWS`` rows, a range looks ahead within
itself, and the first document of a range also goes, as a guest, to the range
that needs it. Ranges follow the counts: ``KNOTS`` quantiles of the ids cut them into intervals of equal counts, each
interval into equal widths, so outlying ids widen one interval only. An id that fills an interval by itself (null too) is
cut by the hash of its texts, and a text that fills one by row numbers. The texts move in one shuffle, or twice where
the guests (one document a range) are too many to broadcast.

Defined results: a null text is an empty one; an empty text has an empty
fingerprint, and the likeness of two empty fingerprints is 1; a text of fewer
than k words has one k-mer, all its words; null ids follow all others; equal ids
follow each other by a hash of their text; a table of one row is its own next
document; an empty table gives an empty result; only id and text are read. Positions of all words count: a text has
2^31 bytes at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import BLANKS, materialise

K = 2
BINS = 64
RANGE_ROWS = 64
KNOTS = 1024

_POS = 30  # low bits of a packed value hold the position
_MASK = (1 << _POS) - 1
_LOWEST = -(1 << 63)
_HIGHEST = (1 << 63) - 1


def _right(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def with_components(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with an array<int> column of the fingerprint's components of column ``text``.

    Helper columns are staged, so that each array is computed once.
    """
    w, grams, runs, starts, order, pairs, poor = (f"__{out}_{k}" for k in ("w", "grams", "runs", "starts", "order", "pairs", "poor"))
    c = F.col
    df = df.withColumn(w, F.array_remove(F.split(c(text), BLANKS), ""))
    first = F.sequence(F.lit(1), F.greatest(F.size(c(w)) - (K - 1), F.lit(1)))
    none = F.array().cast("array<bigint>")
    # hashed word by word: the same number as that of a slice, which would be copied for every k-mer
    packed = F.transform(first, lambda i: F.xxhash64(*[F.get(c(w), i + (k - 1)) for k in range(K)]).bitwiseAND(F.lit(~_MASK)).bitwiseOR(F.least(i, F.lit(_MASK)).cast("long")))
    df = df.withColumn(grams, F.when(F.size(c(w)) > 0, F.array_sort(packed)).otherwise(none))
    # equal k-mers stand together, in text order: number them within their run
    begins = lambda a: lambda x, i: (i == 0) | (_right(F.get(a, i - 1), _POS) != _right(x, _POS))
    df = df.withColumn(starts, F.filter(F.transform(c(grams), lambda x, i: F.when(begins(c(grams))(x, i), i + 1)), lambda i: i.isNotNull()))
    run = lambda b, j: F.slice(c(grams), b, F.coalesce(F.get(c(starts), j + 1), F.size(c(grams)) + 1) - b)
    numbered = lambda p, k: F.xxhash64(_right(p, _POS), k).bitwiseAND(F.lit(~_MASK)).bitwiseOR(p.bitwiseAND(F.lit(_MASK)))
    df = df.withColumn(runs, F.flatten(F.transform(c(starts), lambda b, j: F.transform(run(b, j), numbered))))
    df = df.withColumn(order, F.array_sort(c(runs)))
    shift = 64 - (BINS - 1).bit_length()
    bin_of = lambda x: _right(x, shift)

    def component(bin_no: Column, a: Column, b: Column) -> Column:
        a_key, b_key = _right(a, _POS), _right(b, _POS)
        ordered = F.when(a.bitwiseAND(F.lit(_MASK)) <= b.bitwiseAND(F.lit(_MASK)), F.xxhash64(a_key, b_key)).otherwise(F.xxhash64(b_key, a_key))
        value = F.when(b.isNull(), F.xxhash64(a_key)).otherwise(ordered)
        return (bin_no * 65536 + value.bitwiseAND(F.lit(65535))).cast("int")

    at = lambda j: F.get(c(order), j)
    # the first two of each bin that has two
    heads = F.filter(F.transform(c(order), lambda x, j: F.when(
        ((j == 0) | (bin_of(at(j - 1)) != bin_of(x))) & (bin_of(at(j + 1)) == bin_of(x)), j)), lambda j: j.isNotNull())
    df = df.withColumn(pairs, F.transform(heads, lambda j: F.struct(bin_of(at(j)).alias("bin"), at(j).alias("a"), at(j + 1).alias("b"))))
    # for the others, k-mers of the bin are below 0 and all others, hashed again, are not
    again = lambda x, k: F.xxhash64(_right(x, _POS), k).bitwiseAND(F.lit(_HIGHEST & ~_MASK)).bitwiseOR(x.bitwiseAND(F.lit(_MASK)))
    permuted = lambda k: F.sort_array(F.transform(c(order), lambda x: F.when(bin_of(x) == k, x.bitwiseOR(F.lit(_LOWEST))).otherwise(again(x, k))))
    lacking = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), F.transform(c(pairs), lambda p: p["bin"]))
    df = df.withColumn(poor, F.when(F.size(c(order)) > 0, F.transform(lacking, lambda k: F.struct(k.alias("bin"), F.slice(permuted(k), 1, 2).alias("ab"))))
                       .otherwise(F.array().cast("array<struct<bin:bigint,ab:array<bigint>>>")))
    parts = F.concat(F.transform(c(pairs), lambda p: component(p["bin"], p["a"], p["b"])),
                     F.transform(c(poor), lambda p: component(p["bin"], F.get(p["ab"], F.lit(0)), F.get(p["ab"], F.lit(1)))))
    return df.withColumn(out, F.sort_array(parts)).drop(w, grams, runs, starts, order, pairs, poor)


def as_text(components: Column) -> Column:
    """Fingerprint string: six hex digits per permutation, its number in the first two."""
    return F.array_join(F.transform(components, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Agreeing permutations as a share of those that either fingerprint has; 1 for two empty ones."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 16)), F.transform(b, lambda x: F.shiftright(x, 16))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_components(d, "text", "parts").select("doc_id", as_text(F.col("parts")).alias("fingerprint"))


def _place(x: Column, knots: list[int]) -> Column:
    """How many of the sorted ``knots`` are at or below ``x``, by halving steps."""
    table = F.array(*[F.lit(k).cast("long") for k in knots])

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = F.get(table, mid) <= x
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(knots)).alias("hi"))
    return F.aggregate(F.array(*[F.lit(0)] * (len(knots).bit_length() + 1)), start, halve)["lo"]


def _share(h: Column, parts: int) -> Column:
    """Which of ``parts`` equal stretches of all 64-bit numbers ``h`` lies in; grows with ``h``."""
    return F.floor((h.cast("double") / 2.0 ** 64 + 0.5) * parts).cast("long")


def ranges(docs: DataFrame) -> Column:
    """The range of a row (doc_id, tie, number) as a struct that grows along the descending order of the documents."""
    count, n_null = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    share = max(count // KNOTS, RANGE_ROWS)  # rows of an interval
    points = docs.agg(F.percentile_approx("doc_id", [k / KNOTS for k in range(KNOTS + 1)], 20 * KNOTS)).first()[0] or []
    knots = sorted(set(points))
    # ids that fill intervals by themselves, and the texts that do
    heavy = {k: points.count(k) * share for k in knots if points.count(k) > 2} | ({None: n_null} if n_null > share else {})
    is_heavy = F.col("doc_id").isin([k for k in heavy if k is not None]) | (F.col("doc_id").isNull() & F.lit(None in heavy))
    often = docs.where(is_heavy).groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where(F.col("n") > share).collect() if heavy else []
    parts = lambda n: max(1, n // RANGE_ROWS)
    by_tie, by_number = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k, n in heavy.items():
        by_tie = F.when(F.col("doc_id").eqNullSafe(F.lit(k)), _share(F.col("tie"), parts(n))).otherwise(by_tie)
    for r in often:
        by_number = F.when(F.col("doc_id").eqNullSafe(F.lit(r.doc_id)) & (F.col("tie") == r.tie), _share(F.xxhash64("number"), parts(r.n))).otherwise(by_number)
    none = F.struct(F.lit(_HIGHEST).alias("interval"), F.lit(0).cast("long").alias("step"), by_tie.alias("tie"), by_number.alias("number"))
    if not knots:
        return none
    place = _place(F.col("doc_id"), knots)
    widths = [max(1, (b - a) // max(1, share // RANGE_ROWS)) for a, b in zip(knots, knots[1:])] + [1 << 62]
    first, width = (F.array(*[F.lit(v).cast("long") for v in values]) for values in (knots, widths))
    at = F.greatest(place - 1, F.lit(0))
    # the difference of two ids may pass 2^63: halves are taken first
    step = F.when(place == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", F.shiftright("doc_id", 1) - F.shiftright(F.get(first, at), 1), F.greatest(F.shiftright(F.get(width, at), 1), F.lit(1).cast("long"))))
    some = F.struct((-place).cast("long").alias("interval"), (-step).alias("step"), by_tie.alias("tie"), by_number.alias("number"))
    return F.when(F.col("doc_id").isNull(), none).otherwise(some)


def _guests(ids: DataFrame) -> DataFrame:
    """(range, first, host) of rows (doc_id, tie, number, range): the first row of each range in the order of the documents, and
    the range that needs it: the one before, and for the first range the last."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("down"), "tie", "number")
    tops = ids.groupBy("range").agg(F.min(order).alias("o")).withColumn("interval", F.col("range.interval"))
    inside = F.lag("range").over(Window.partitionBy("interval").orderBy("range"))
    # one row an interval: their number is bounded
    ends = tops.groupBy("interval").agg(F.max("range").alias("last"))
    w = Window.orderBy("interval")
    ends = ends.select(F.col("interval").alias("i"), F.lag("last").over(w).alias("before"), F.last("last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"))
    out = tops.withColumn("inside", inside).join(ends, F.col("interval") == F.col("i"))
    return out.select(F.col("range").alias("of"), F.col("o.down").alias("down"), F.col("o.tie").alias("first_tie"), F.col("o.number").alias("first_number"),
                      F.coalesce("inside", "before", "lowest").alias("host"))


def with_next(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with next_<c> for each c of ``keep``: the next document in descending id order."""
    d = docs.withColumn("tie", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    ids = materialise(d.select("doc_id", "tie", "number"), "ids")
    in_range = ranges(ids)
    guests = materialise(_guests(ids.withColumn("range", in_range)), "guests")
    d = d.withColumn("range", in_range)
    # rows that agree in id and text are alike: any of a range may be its guest, and several do no harm
    same = (d["range"] == guests["of"]) & F.bitwise_not(d["doc_id"]).eqNullSafe(guests["down"]) & (d["tie"] == guests["first_tie"])
    d = d.join(guests, same, "left").drop("of", "down", "first_tie", "first_number")
    home = F.struct(F.col("range"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))
    alone = F.col("host").isNull()
    d = d.withColumn("at", F.explode(F.when(alone, F.array(home)).otherwise(F.array(home, visit))))
    w = Window.partitionBy("at.range").orderBy("at.guest", F.col("doc_id").desc_nulls_last(), "tie", "number")
    d = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in keep})
    return d.where(~F.col("at.guest")).drop("at", "range", "host", "tie", "number")


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last half replaced by the beginning of the next document.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(with_components(d, "text", "own"), ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = with_components(d, "edited", "changed")
    return d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                    likeness(F.col("own"), F.col("next_own")).alias("near_next"))
