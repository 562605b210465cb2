"""Incremental stage layer: names, target filters, skip-done, run report
(P1-P3, J1, J3, A7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import _col

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
PRESENTATION_SUFFIX = "_presentation"
QA_SUFFIX = "_q_and_a"
AUDIO_GLOB = "*.{mp3,wav,m4a}"


def stem(name) -> Column:
    """File name without its last extension (a leading dot is not one)."""
    return F.regexp_replace(_col(name), r"^(.+)\.[^.]+$", "$1")


def base_name(stem_col) -> Column:
    """Stem without one trailing ``_q_and_a``."""
    return F.regexp_replace(_col(stem_col), QA_SUFFIX + "$", "")


def is_derived(stem_col) -> Column:
    """Stems written by the structuring stage."""
    s = _col(stem_col)
    return s.endswith(PRESENTATION_SUFFIX) | s.endswith(QA_SUFFIX)


def matches_targets(name, targets: Sequence[str] | None) -> Column:
    """The name contains ANY target, case-insensitively. No targets: all."""
    if not targets:
        return F.lit(True)
    arr = F.array(*[F.lit(t.lower()) for t in targets])
    lname = F.lower(_col(name))
    return F.exists(arr, lambda t: F.contains(lname, t))


def filter_targets(df: DataFrame, name_col: str, targets: Sequence[str] | None) -> DataFrame:
    """P2 on a DataFrame. Target lists are user input of bounded size, so the
    test is an in-row ``exists`` (no join)."""
    return df.where(matches_targets(F.col(name_col), targets)) if targets else df


#: Characters of the stretch by which a target is looked up; short ones are in too many names.
GRAM = 8


def _grams(text: Column, size: Column) -> Column:
    """Distinct stretches of ``size`` characters of a text that has so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def filter_targets_by_index(df: DataFrame, name_col: str, targets: DataFrame, target_col: str = "target") -> DataFrame:
    """P2 for long target lists, which are a table: rows whose name contains any of them, case-insensitively.

    Each target is looked up by one stretch of ``GRAM`` characters (all of it, if it is shorter), the one that the
    fewest names have; names meet the targets in an equi-join on their own stretches of the lengths that targets are
    looked up by, and ``contains`` confirms. Stretches outnumber names many times, which Spark's estimate of their size
    does not see: their joins are sort-merge joins, never broadcast. An empty target is in every name; an empty list keeps all rows."""
    spread = F.monotonically_increasing_id()
    rows = store_rows(df.withColumn("_id", spread))
    wanted = targets.select(F.lower(F.col(target_col)).alias("_target")).where(F.col("_target").isNotNull()).distinct()
    size = F.least(F.length("_target"), F.lit(GRAM))
    sizes = wanted.agg(F.collect_set(size)).first()[0]  # GRAM + 1 numbers at most
    lookups = [n for n in sizes if n > 0]
    if not sizes:
        return rows.drop("_id")
    if not lookups:
        return rows.where(F.col(name_col).isNotNull()).drop("_id")
    names = rows.select("_id", F.lower(F.col(name_col)).alias("_name")).where(F.length("_name") > 0)
    lengths = F.explode(F.array(*[F.lit(n) for n in sorted(lookups)])).alias("_n")
    grams = (names.select("_id", "_name", lengths).where(F.length("_name") >= F.col("_n"))
             .select("_id", "_name", F.explode(_grams(F.col("_name"), F.col("_n"))).alias("_gram")))
    keyed = wanted.where(F.length("_target") > 0).withColumn("_n", size)
    keyed = keyed.select("_target", F.explode(_grams(F.col("_target"), F.col("_n"))).alias("_gram"))
    often = grams.groupBy(F.col("_gram").alias("_g")).agg(F.count(F.lit(1)).alias("_often"))
    # a stretch that no name has finds nothing, and tells so at once
    rarest = keyed.hint("merge").join(often, F.col("_gram") == F.col("_g"), "left").groupBy("_target").agg(
        F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), F.col("_gram"))).alias("_key"))
    hits = grams.hint("merge").join(rarest, F.col("_gram") == F.col("_key")).where(F.contains("_name", F.col("_target"))).select("_id").distinct()
    kept = rows.join(hits.withColumn("_hit", F.lit(True)), "_id", "left")
    return kept.where(F.coalesce("_hit", F.lit(False)) | (F.lit(0 in sizes) & F.col(name_col).isNotNull())).drop("_id", "_hit")


def store_rows(df: DataFrame) -> DataFrame:
    """Row numbers must not change between the two places where they are read."""
    from parley.sources import store

    return store.stage_table(df, "names")


def completed_keys(outputs: DataFrame, key: str, kind_col: str, required: Sequence[str]) -> DataFrame:
    """Keys whose outputs include *every* required kind (a half-written result
    does not count). Partial aggregation per key bounds a hot key's cost."""
    req = list(required)
    return (outputs.where(F.col(kind_col).isin(req))
            .groupBy(key).agg(F.count_distinct(kind_col).alias("_kinds"))
            .where(F.col("_kinds") == len(req))
            .select(key))


def skip_done(inputs: DataFrame, outputs: DataFrame, key: str, kind_col: str,
              required: Sequence[str]) -> DataFrame:
    """Inputs whose required outputs do not all exist (left-anti join).

    Spark picks the strategy: broadcast of the completed-key set when measured
    small, otherwise a sort-merge anti join that AQE splits on skewed keys."""
    return inputs.join(completed_keys(outputs, key, kind_col, required), key, "left_anti")


def select_work(inputs: DataFrame, outputs: DataFrame, key: str, name_col: str, kind_col: str,
                required: Sequence[str], targets: Sequence[str] | None = None) -> DataFrame:
    """J3 + J1: explicit targets bypass the done check; otherwise skip done."""
    if targets:
        return filter_targets(inputs, name_col, targets)
    return skip_done(inputs, outputs, key, kind_col, required)


def run_report(found: DataFrame, todo: int, failed: int, stage: str) -> DataFrame:
    """(stage, status, n) for found / skipped / processed / failed rows; ``todo`` and ``failed`` were counted
    while the stage's rows were written."""
    n = found.agg(F.count(F.lit(1)).alias("found"))
    counts = {"found": F.col("found"), "skipped": F.col("found") - todo, "processed": F.lit(todo - failed), "failed": F.lit(failed)}
    rows = F.array(*[F.struct(F.lit(k).alias("status"), v.cast("long").alias("n")) for k, v in counts.items()])
    return n.select(F.lit(stage).alias("stage"), F.explode(rows).alias("s")).select("stage", "s.status", "s.n")


def stage_report(staged: DataFrame, outputs: DataFrame, key: str, stage_col: str, kind_col: str, bad_col: str,
                 required: dict[str, Sequence[str]]) -> DataFrame:
    """A7 for many stages in one pass: (stage, status, n).

    ``staged`` has one row per input and stage and whether it fails; ``required``
    the output kinds that mark an input of a stage as done. Kinds are few, so the
    set per key is small; inputs meet it in one join."""
    kinds = outputs.groupBy(key).agg(F.collect_set(kind_col).alias("_kinds"))
    done = F.lit(False)
    for stage, need in required.items():
        done = F.when(F.col(stage_col) == stage, F.size(F.array_intersect("_kinds", F.array(*[F.lit(k) for k in need]))) == len(need)).otherwise(done)
    done = F.coalesce(done, F.lit(False))
    marked = staged.join(kinds, key, "left").select(stage_col, done.alias("_done"), F.col(bad_col).alias("_bad"))
    n = lambda c: F.count(F.when(c, 1)).cast("long")
    counts = marked.groupBy(F.col(stage_col).alias("_of")).agg(
        F.count(F.lit(1)).cast("long").alias("found"), n(F.col("_done")).alias("skipped"),
        n(~F.col("_done") & ~F.col("_bad")).alias("processed"), n(~F.col("_done") & F.col("_bad")).alias("failed"))
    stages = staged.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in required])).alias("stage"))
    status = F.explode(F.array(*[F.struct(F.lit(c).alias("status"), F.coalesce(c, F.lit(0)).cast("long").alias("n"))
                                 for c in ("found", "skipped", "processed", "failed")])).alias("s")
    return stages.join(counts, F.col("stage") == F.col("_of"), "left").select("stage", status).select("stage", "s.status", "s.n")
