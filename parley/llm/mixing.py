"""Operator 3: mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken ``target / source size`` times. The
whole part is taken for certain. The fractions are rounded in pairs: mass moves
between two documents of a source, weighted by their sizes, until one of the two
is whole, so the words taken from the source stay as they were. Documents are
dealt over leaves by a hash of their id. A leaf ends with at most one unrounded
document per source; these move up a reduction tree, a fixed number of leaves to
a node, until one is left per source, which goes to the nearer side, so a source
misses its target by at most half of one document. Longer documents are paired
first, which leaves a short one for the end. All draws come from hashes of ids,
so reruns agree, and a hot source is spread over all leaves.

Rows that agree in id, text and source have equal shares: of r such rows, the whole part of r * share are taken once
more for certain, and one row with the fraction that is left goes to the tree. So a row that makes up much of a table
leaves its source no further off its target than any other.

Defined results: a null text has size 0, as an empty one; documents of size 0
take 0 words and are never unrounded; a null source is a source of its own and
the last in order; null ids are ids like others; long texts are counted whole; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import BLANKS, fresh, materialise

#: Weights by the sources' order, repeating; share of all sizes to take; most copies of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents to a leaf, and leaves (or nodes) to a node of the tree.
LEAF_DOCS = 20_000
FAN_IN = 16
SEED = 20_011

KEY = ["doc_id", "text_hash", "source"]


def text_size(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, BLANKS, -1))  # blanks at either end leave an empty part there
    return (parts - F.when(t.rlike(r"^[\x20\x09-\x0D]|^$"), 1).otherwise(0) - F.when(t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Targets in proportion to weight, none above ``most`` times its source, the
    excess shared again by weight. Sources ordered by cap per weight are capped
    up to the first one whose uncapped share fits: running sums over one row per
    source give that share.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))))
    per = per.withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("source", "source_size", "weight", "cap",
                     (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
                     (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("heavy"),
                     F.row_number().over(by_cap).alias("place"))
    # the first source in this order that is not capped sets the level for all after it
    fits = F.col("weight") * F.col("left") / F.col("heavy") <= F.col("cap")
    last = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(fits, F.struct("place", (F.col("left") / F.col("heavy")).alias("level")))).over(last)
    per = per.withColumn("level", level)
    capped = F.col("level").isNull() | (F.col("place") < F.col("level.place"))
    return per.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("level.level")).alias("target"))


def pivot(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions of one source's documents in order; returns them and the place left unrounded (or -1).

    Of the pair (carried document, next document) either side can become whole:
    both outcomes keep ``size * share`` in sum, and the draw picks them so that
    each share keeps its expectation.
    """
    x = share.astype(float).copy()
    carried = -1
    for k in range(len(x)):
        if x[k] <= 0.0 or x[k] >= 1.0:
            x[k] = round(x[k])
            continue
        if carried < 0:
            carried = k
            continue
        a, b = float(size[carried]), float(size[k])
        up = min((1.0 - x[carried]) * a, x[k] * b)  # mass that can move to the carried one
        down = min(x[carried] * a, (1.0 - x[k]) * b)  # and away from it
        move = up if draw[k] * (up + down) < down else -down
        x[carried] += move / a
        x[k] -= move / b
        whole = [abs(x[i] - round(x[i])) < 1e-9 for i in (carried, k)]
        if not any(whole):  # rounding errors only
            whole = [abs(x[carried] - round(x[carried])) <= abs(x[k] - round(x[k])), True]
        for i, w in zip((carried, k), whole):
            if w:
                x[i] = round(x[i])
        carried = -1 if all(whole) else (k if whole[0] else carried)
    return x, carried


def _round_nodes(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
    """Pair up within each (node, source) of one partition; the rows come sorted by them."""
    carried: pd.DataFrame | None = None

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        x, left = pivot(pdf["size"].to_numpy(), pdf["share"].to_numpy(), pdf["draw"].to_numpy())
        open_ = np.zeros(len(pdf), bool)
        if left >= 0:
            if last:
                x[left] = float(x[left] >= 0.5)
            else:
                open_[left] = True
        return pdf.assign(share=x, open=open_)

    for pdf in batches:
        if carried is not None:
            pdf = pd.concat([carried, pdf], ignore_index=True)
        pdf = pdf.reset_index(drop=True)
        if not len(pdf):
            continue
        group = pd.factorize(pd.MultiIndex.from_arrays([pdf["node"], pdf["source"].fillna(""), pdf["source"].isna()]))[0]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        ends = np.append(starts[1:], len(pdf))
        for a, b in zip(starts[:-1], ends[:-1]):
            yield settle(pdf.iloc[a:b])
        # the last group may go on in the next batch: keep only its unrounded document
        tail = settle(pdf.iloc[starts[-1]:]) if not last else pdf.iloc[starts[-1]:].assign(open=True)
        yield tail[~tail["open"]]
        carried = tail[tail["open"]].drop(columns="open")
    if carried is not None and len(carried):
        yield settle(carried)


def round_shares(items: DataFrame, n_items: int) -> DataFrame:
    """(KEY, copies) of items (KEY, size, copies double): fractions rounded along the reduction tree."""
    whole = F.floor("copies").cast("double")
    h = F.xxhash64(F.lit(SEED), *KEY)
    frame = items.select(*KEY, "size", whole.alias("whole"), (F.col("copies") - whole).alias("share"),
                         h.alias("h"), (F.pmod(F.xxhash64(F.lit(SEED + 1), *KEY), F.lit(2 ** 52)) / 2.0 ** 52).alias("draw"))
    nodes = max(1, -(-n_items // LEAF_DOCS))
    frame = frame.withColumn("node", F.pmod(F.col("h"), F.lit(nodes)))
    schema = f"{frame.schema.simpleString()[7:-1]},open:boolean".replace(":", " ").replace(",", ", ")
    done: list[DataFrame] = []
    while True:
        last = nodes == 1
        ready = frame.repartition("node").sortWithinPartitions("node", "source", F.desc("size"), "h", "doc_id")
        level = materialise(ready.mapInPandas(lambda it, last=last: _round_nodes(it, last), schema), "mix")
        done.append(level.where(~F.col("open")))
        if last:
            break
        nodes = -(-nodes // FAN_IN)
        frame = level.where("open").drop("open").withColumn("node", F.pmod(F.col("node"), F.lit(nodes)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*KEY, (F.col("whole") + F.col("share")).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies, extra, repeats): one row per document.

    ``text_hash`` is xxhash64 of the text; rows that agree in the first three are
    one document with ``repeats`` rows. Each is taken ``copies`` times, and ``extra`` of them once more.
    """
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", text_size(F.col("text")).alias("size"))
    sized = materialise(sized.groupBy(*KEY, "size").agg(F.count("*").alias("repeats")), "sizes")
    targets = materialise(source_targets(sized.select("source", (F.col("size") * F.col("repeats")).alias("size"))), "targets")
    t = targets.withColumnRenamed("source", "target_source")
    items = sized.join(t, sized["source"].eqNullSafe(t["target_source"])).drop("target_source")
    ratio = F.least(F.lit(MOST_COPIES), F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    share = F.when(F.col("size") > 0, ratio).otherwise(F.lit(0.0))
    items = items.withColumn("copies", F.floor(share).cast("long")).withColumn("more", (share - F.floor(share)) * F.col("repeats"))
    items = items.withColumn("certain", F.floor("more").cast("long"))
    rounded = round_shares(items.select(*KEY, "size", (F.col("more") - F.col("certain")).alias("copies")), sized.count())
    rounded = rounded.withColumnRenamed("copies", "last")
    same = [items[k].eqNullSafe(rounded[k]) for k in KEY]
    return items.join(rounded, same[0] & same[1] & same[2]).select(
        *[items[k] for k in KEY], "size", "source_size", "target", "copies", (F.col("certain") + F.col("last")).alias("extra"), "repeats")


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of ``docs``."""
    m = mix(docs).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    copies = F.col("copies") + (F.col("row") <= F.col("extra")).cast("long")
    return m.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def _repeated(df: DataFrame, n: str) -> DataFrame:
    return df.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: none, one or two copies of each, all columns kept."""
    m = mix(docs)
    names = {k: fresh(docs, f"mix_{k}") for k in (*KEY, "copies", "extra", "repeats")}
    n, before, own = fresh(docs, "mix_rows"), fresh(docs, "mix_before"), fresh(docs, "own_hash")
    m = m.select(*[F.col(k).alias(v) for k, v in names.items()])
    d = docs.withColumn(own, F.xxhash64("text"))
    on = d["doc_id"].eqNullSafe(m[names["doc_id"]]) & (d[own] == m[names["text_hash"]]) & d["source"].eqNullSafe(m[names["source"]])
    copies, extra, repeats = (F.col(names[k]) for k in ("copies", "extra", "repeats"))
    joined = d.join(m.where((copies > 0) | (extra > 0)), on)
    single = joined.where(repeats == 1).withColumn(n, copies + extra).where(F.col(n) > 0).select(*[d[c] for c in docs.columns], n)
    # rows that agree in id, text and source: equal ones are counted, and the extra copies dealt to them in order
    equal = joined.where(repeats > 1).groupBy(*[d[c] for c in docs.columns], own, names["copies"], names["extra"]).agg(F.count("*").alias(n))
    w = Window.partitionBy("doc_id", own, "source").orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn(before, F.coalesce(F.sum(n).over(w), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col(n), extra - F.col(before)))
    equal = equal.withColumn(n, F.col(n) * copies + more).where(F.col(n) > 0).select(*docs.columns, n)
    return _repeated(single.unionByName(equal), n)
