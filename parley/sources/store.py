"""Result tables that reruns never damage (K1-K4 storage).

Every run writes one folder of its own, ``run_id=<id>``; readers take the latest run of
each key. Writing again under the same id (a retry after a crash) replaces that run
only, so nothing is lost or doubled, and no run rewrites the results of others. Run ids
sort by time, and a run counts once it is finished.

Keyed tables deal their rows over buckets of the key, one file per bucket and run, so a
lookup reads the files of one bucket. :func:`compact` merges the finished runs into a base,
one file per bucket, and publishes a manifest that names the base and the runs it
covers; a reader sees either all of the change or none of it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.spark import work_path

#: Buckets of a new table. A bucket of a run, or of the base, is one file: choose so many that one is a gigabyte or less.
BUCKETS = 64
MANIFESTS, LAYOUT = "_manifest", "_layout"


def new_run_id(kind: str = "t") -> str:
    return f"{kind}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") == 1).drop("_row")


def _last_first(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Sort order of the rows of a key: the last by ``order`` first; equal ones are told apart by content."""
    return [*[F.col(c).desc() for c in order], F.xxhash64(*df.columns)]


def one_per_key(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """The last row of each key by ``order``; equal ones are told apart by content."""
    return _first_row(df, [key], _last_first(df, order))


# ---------------------------------------------------------------- small files beside the runs
def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _publish(spark: SparkSession, path: str, body: dict) -> None:
    """A new file, or an error if there is one of that name."""
    fs, p = _path(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def buckets_of(spark: SparkSession, path: str, wanted: int | None = None) -> int:
    """Buckets of the table at ``path``, fixed when its first run is written."""
    if "buckets.json" not in _names(spark, f"{path}/{LAYOUT}"):
        _publish(spark, f"{path}/{LAYOUT}/buckets.json", {"buckets": wanted or BUCKETS})
    return _read(spark, f"{path}/{LAYOUT}/buckets.json")["buckets"]


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------- runs
def write_run(df: DataFrame, path: str, run_id: str | None = None, partition_by: Sequence[str] = ()) -> str:
    """Write one run's rows; returns its id."""
    run_id = run_id or new_run_id()
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/run_id={run_id}")
    return run_id


def write_keyed(df: DataFrame, path: str, key: str, run_id: str | None = None, buckets: int | None = None,
                last_by: Sequence[str] | None = None) -> str:
    """Write one run of a keyed table, a file per bucket, sorted by key. With ``last_by`` (empty or not) only the last row
    of each key is written, as :func:`one_per_key` tells it: a bucket has all rows of its keys, so the rows move once."""
    n = buckets_of(df.sparkSession, path, buckets)
    by_rank = None if last_by is None else _last_first(df, last_by)
    if "from_run" not in df.columns:
        df = df.withColumn("from_run", F.lit(None).cast("string"))
    rows = df.withColumn("bucket", bucket(F.col(key), n)).repartition("bucket")
    if by_rank is not None:
        rows = _first_row(rows, ["bucket", key], by_rank)
    return write_run(rows.sortWithinPartitions("bucket", key), path, run_id, ["bucket"])


def manifest(spark: SparkSession, path: str) -> dict:
    """{"base": the compacted run or null, "covers": the runs in it}."""
    names = _names(spark, f"{path}/{MANIFESTS}")
    return _read(spark, f"{path}/{MANIFESTS}/{names[-1]}") if names else {"base": None, "covers": []}


def live_runs(spark: SparkSession, path: str) -> list[str]:
    """Finished runs that make up the table: the base and the runs it does not cover."""
    known = manifest(spark, path)
    runs = [n.removeprefix("run_id=") for n in _names(spark, path) if n.startswith("run_id=")]
    mine = [r for r in runs if r == known["base"] or not r.startswith("c") and r not in known["covers"]]
    fs, _ = _path(spark, path)
    return [r for r in mine if fs.exists(_path(spark, f"{path}/run_id={r}/_SUCCESS")[1])]


def read_runs(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """Rows of all live runs (or of those named), with the ``run_id`` that wrote them."""
    runs = live_runs(spark, path) if runs is None else runs
    df = spark.read.option("basePath", path).parquet(*[f"{path}/run_id={r}" for r in runs])
    run = F.col("run_id").cast("string")
    if "from_run" in df.columns:
        return df.withColumn("run_id", F.coalesce("from_run", run)).drop("from_run")
    return df.withColumn("run_id", run)


def latest(rows: DataFrame, key: str, order: Sequence[str] = ("run_id",), columns: Sequence[Column] | None = None) -> DataFrame:
    """The latest row of each key. ``columns`` is what to return of it (all by default): they are computed
    where the rows are read, so that no more than they, the key and ``order`` is shuffled."""
    by = [F.col(f"_by{i}").desc() for i in range(len(order))]
    kept = rows.select(*(["*"] if columns is None else columns), F.col(key).alias("_key"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)])
    return _first_row(kept, ["_key"], by).drop("_key", *[f"_by{i}" for i in range(len(order))])


def done_keys(spark: SparkSession, path: str, key: str, without_run: str | None = None) -> DataFrame | None:
    """Keys with a good result in a finished run of a table with folders by status; None before the first run."""
    runs = [r for r in live_runs(spark, path) if r != without_run]
    return read_runs(spark, path, runs).where("status = 'ok'").select(key).distinct() if runs else None


def compact(spark: SparkSession, path: str, key: str, order: Sequence[str] = ("run_id",)) -> str:
    """Merge the live runs of a keyed table into a new base; returns its id. Nothing changes for readers until the
    manifest stands; a compaction that dies before leaves a folder that nobody reads. Of two at the same time
    the second fails."""
    runs, known = live_runs(spark, path), manifest(spark, path)
    number = len(_names(spark, f"{path}/{MANIFESTS}"))
    rows = latest(read_runs(spark, path, runs), key, order).drop("bucket").withColumnRenamed("run_id", "from_run")
    base = write_keyed(rows, path, key, new_run_id("c"))
    _publish(spark, f"{path}/{MANIFESTS}/{number:012d}.json", {"base": base, "covers": sorted({*known["covers"], *runs})})
    return base


def purge(spark: SparkSession, path: str) -> list[str]:
    """Delete the runs that the base covers, once no reader uses them; returns their ids."""
    known = manifest(spark, path)
    gone = [n.removeprefix("run_id=") for n in _names(spark, path) if n.removeprefix("run_id=") in known["covers"]]
    for r in gone:
        fs, p = _path(spark, f"{path}/run_id={r}")
        fs.delete(p, True)
    return gone


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Store a stage's rows in a folder of its own under the shared checkpoint folder."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
