"""Order-dependent operators over (key, position) rows, safe under key skew.

A single session (key) may hold a large share of all rows. A plain window
``partitionBy(key).orderBy(pos)`` would funnel that session through one task,
so every operator here works in two levels: first within (key, chunk of
positions), where chunks spread a hot key over many tasks, then across the few
chunk summaries of each key.

* :func:`ordered_concat`  - A1: texts joined in position order.
* :func:`running_sum`     - cumulative sums (segment offsets, progress).
* :func:`merge_runs`      - T6 window form: gaps-and-islands run merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1024


def _chunk(pos: str, chunk_size: int) -> Column:
    return F.floor(F.col(pos) / F.lit(chunk_size)).cast("long")


def sorted_join(pos: Column, text: Column, sep: str) -> Column:
    """Aggregate: ``text`` values joined by ``sep`` in ``pos`` order."""
    items = F.array_sort(F.collect_list(F.struct(pos.alias("p"), text.alias("t"))))
    return F.array_join(F.transform(items, lambda x: x["t"]), sep)


def ordered_concat(df: DataFrame, key: str, pos: str, text: str, sep: str = " ",
                   chunk_size: int = DEFAULT_CHUNK, out: str = "text") -> DataFrame:
    """A1: one row per key with ``out`` = texts joined by ``sep`` in position
    order (empty texts still contribute a separator), plus ``n_items``.

    Level 1 joins at most ``chunk_size`` items per (key, chunk) task; level 2
    joins the chunk pieces of each key.
    """
    pieces = (df.withColumn("_chunk", _chunk(pos, chunk_size))
              .groupBy(key, "_chunk")
              .agg(sorted_join(F.col(pos), F.col(text), sep).alias("_piece"),
                   F.count(F.lit(1)).alias("_n")))
    return (pieces.groupBy(key)
            .agg(sorted_join(F.col("_chunk"), F.col("_piece"), sep).alias(out),
                 F.sum("_n").alias("n_items")))


def running_sum(df: DataFrame, key: str, pos: str, value: str, out: str = "running",
                chunk_size: int = DEFAULT_CHUNK, inclusive: bool = True) -> DataFrame:
    """Cumulative sum of ``value`` in position order within ``key``.

    Chunk totals are prefix-summed per key (few rows per key), joined back and
    added to the running sum inside each (key, chunk) window.
    """
    rows = df.withColumn("_chunk", _chunk(pos, chunk_size))
    totals = rows.groupBy(key, "_chunk").agg(F.sum(value).alias("_total"))
    wk = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_chunk", F.coalesce(F.sum("_total").over(wk), F.lit(0)).alias("_offset"))
    upper = Window.currentRow if inclusive else -1
    wl = Window.partitionBy(key, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, upper)
    local = F.coalesce(F.sum(value).over(wl), F.lit(0))
    return (rows.join(offsets, [key, "_chunk"])
            .withColumn(out, F.col("_offset") + local)
            .drop("_chunk", "_offset"))


def merge_runs(df: DataFrame, key: str, pos: str, tag: str, text: str, sep: str = " ",
               chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """T6 (window form): drop empty texts, then merge consecutive rows of the
    same tag into one run. Returns (key, run_pos, tag, text, n_blocks) where
    ``run_pos`` is the position of the run's first row.

    Run starts are found with ``lag`` inside each (key, chunk); the first row of
    a chunk compares with the last tag of the previous non-empty chunk. Rows
    before the first start of a chunk continue a run opened in an earlier chunk,
    found by a carry-forward over the chunk summaries.
    """
    rows = df.where(F.length(F.col(text)) > 0).withColumn("_chunk", _chunk(pos, chunk_size))
    wk = Window.partitionBy(key).orderBy("_chunk")
    edges = (rows.groupBy(key, "_chunk")
             .agg(F.max_by(tag, pos).alias("_last_tag"))
             .withColumn("_prev_tag", F.lag("_last_tag").over(wk))
             .drop("_last_tag"))
    wl = Window.partitionBy(key, "_chunk").orderBy(pos)
    rows = (rows.join(edges, [key, "_chunk"])
            .withColumn("_prev", F.coalesce(F.lag(tag).over(wl), F.col("_prev_tag")))
            .withColumn("_start", F.col("_prev").isNull() | (F.col("_prev") != F.col(tag)))
            .withColumn("_run", F.max(F.when(F.col("_start"), F.col(pos)))
                        .over(wl.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    carry = (rows.groupBy(key, "_chunk")
             .agg(F.max(F.when(F.col("_start"), F.col(pos))).alias("_last_start"))
             .withColumn("_carry", F.last("_last_start", ignorenulls=True)
                         .over(wk.rowsBetween(Window.unboundedPreceding, -1)))
             .select(key, "_chunk", "_carry"))
    rows = (rows.join(carry, [key, "_chunk"])
            .withColumn("_run", F.coalesce(F.col("_run"), F.col("_carry"))))
    pieces = (rows.groupBy(key, "_run", "_chunk")
              .agg(F.first(tag).alias("_tag"),
                   sorted_join(F.col(pos), F.col(text), sep).alias("_piece"),
                   F.count(F.lit(1)).alias("_n")))
    return (pieces.groupBy(key, "_run")
            .agg(F.first("_tag").alias(tag),
                 sorted_join(F.col("_chunk"), F.col("_piece"), sep).alias(text),
                 F.sum("_n").alias("n_blocks"))
            .withColumnRenamed("_run", "run_pos"))


def ordered_collect(df: DataFrame, key: str, pos: str, value: Column, out: str,
                    chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Array of ``value`` per key in position order, built in two levels like
    :func:`ordered_concat` (per (key, chunk), then the chunk arrays)."""
    items = (df.withColumn("_chunk", _chunk(pos, chunk_size))
             .groupBy(key, "_chunk")
             .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v")))).alias("_items")))
    return (items.groupBy(key)
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("c"),
                                                                            F.col("_items").alias("i")))),
                                       lambda x: F.transform(x["i"], lambda y: y["v"]))).alias(out)))
