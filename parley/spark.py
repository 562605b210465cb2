"""Session construction and shared-storage helpers.

Everything that persists intermediate data (stage tables, streaming checkpoints,
lineage cuts) goes under the folder the cluster names in ``spark.checkpoint.dir``.
That folder is shared by all executors on a real cluster; a local default is
only installed when the setting is missing (tests, laptops).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session defaults that every job relies on: UTC timestamps (ISO round trips),
# AQE for runtime coalescing / skew-join splitting / broadcast conversion.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # binary payloads and long texts: keep Arrow batches small in Python workers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "parley", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data: the one that ``spark.checkpoint.dir``
    names, or that the context was given. Only a local master may do without; a
    cluster that names none is an error, since executors do not share local disks."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path and sc.getCheckpointDir():
        path = sc.getCheckpointDir().rsplit("/", 1)[0]  # the context adds a folder of its own
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="parley-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one run of one job."""
    return "/".join([_work_root(spark), *parts, uuid.uuid4().hex])


def _work_root(spark: SparkSession) -> str:
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "parley", spark.sparkContext.applicationId])


def remove_work(spark: SparkSession) -> None:
    """Delete what this application stored in the shared folder. Results that are still to be read go with it: call it
    when the application's results are written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as ``--py-files`` would: executors need no
    installed copy of it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = os.path.dirname(os.path.abspath(__file__))
        held = tempfile.mkdtemp(prefix="parley-code-")  # on the driver, which serves it to the executors
        copy = shutil.copytree(root, os.path.join(held, "src", "parley"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(held, "parley"), "zip", os.path.dirname(copy)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text stages at least one task per core.

    Inputs read as fewer splits than cores (small files, one row group) are
    round-robin repartitioned; inputs with enough splits, as on a cluster
    reading large tables, are returned unchanged, so no shuffle is added
    there. Only planning metadata is inspected (no job runs)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
