"""Step timing (A6): the log of a run's steps, and durations and outcomes per step."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parley.sources import store

LOG = "run_id string, step string, started_at timestamp, duration_s double, n long, failed long"


class StepLog:
    """Steps of one run. A step's rows are counted while they are stored (``DataFrame.observe``), not by another pass."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id, self.records = spark, run_id, []

    def step(self, name: str, df: DataFrame, write: Callable[[DataFrame], object], failed: str = "false"):
        """``write(df)``, timed; rows for which the condition ``failed`` holds count as failed."""
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(failed), 1)).alias("failed"))
        started, t = datetime.now(timezone.utc), time.monotonic()
        out = write(observed)
        self.records.append((self.run_id, name, started, time.monotonic() - t, seen.get["n"], seen.get["failed"]))
        return out

    def stored(self, name: str, df: DataFrame, failed: str = "false") -> DataFrame:
        """The rows of a step as a stored table."""
        return self.step(name, df, lambda d: store.stage_table(d, name), failed)

    def save(self, path: str) -> None:
        """Append the steps to the log table at ``path``, as one run of it."""
        store.write_run(self.spark.createDataFrame(self.records, LOG).coalesce(1), path, self.run_id)


def step_timing(log: DataFrame, step: str = "step", duration: str = "duration_s", failed: str = "failed") -> DataFrame:
    """(step, n_runs, n_failed, avg/max/total duration) from a stage log.

    One aggregate per step: partial aggregation keeps a hot step cheap."""
    return (log.groupBy(step)
            .agg(F.count(F.lit(1)).alias("n_runs"),
                 F.sum(F.col(failed).cast("long")).alias("n_failed"),
                 F.round(F.avg(duration), 6).alias("avg_s"),
                 F.round(F.max(duration), 6).alias("max_s"),
                 F.round(F.sum(duration), 6).alias("total_s")))
