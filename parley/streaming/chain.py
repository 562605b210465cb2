"""Continuous hand-off between stages (R1-R5) with Structured Streaming.

A stage is a streaming transformation between two tables of files. Its sink is Spark's file
sink, whose log names the files of each finished micro-batch; the next stage, and
every reader, sees the files of that log only. A batch that is replayed after a crash is
either in the log already (then nothing is written) or its earlier files are not (then
nobody has read them), so every input row has one result in each sink. Rows with an
``error_class`` go to the folder ``status=failed`` (R5), the others to ``status=ok``.

Rows of one session may arrive in many files. :func:`assemble` keeps them in the state
store, by session, until the row with the end mark has come and all that it counts;
then the session leaves as one row. Rows that come after that are reported as ``LateRows``.

``availableNow`` processes what is there and stops, like a batch run;
``processingTime`` with ``max_files`` paces external providers (R4) and returns the
running queries, all at work at the same time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.spark import work_path

# the process that Spark starts for a stateful operator does not see the files sent to the workers: its code goes by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a streaming transformation; rows can fail if it adds an ``error_class`` column
Transform = Callable[[DataFrame], DataFrame]

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fields_of(spark: SparkSession, schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _with_status(spark: SparkSession, schema) -> T.StructType:
    return T.StructType([*fields_of(spark, schema).fields, T.StructField("status", T.StringType())])


def committed(spark: SparkSession, sink: str, schema, status: str = "ok") -> DataFrame:
    """Rows of a status that finished micro-batches stored."""
    rows = spark.read.schema(_with_status(spark, schema)).parquet(sink)
    return rows.where(F.col("status") == status).drop("status")


def files_stream(spark: SparkSession, source: str, schema, fmt: str = "parquet", max_files: int | None = None,
                 path_glob: str | None = None, recursive: bool = False) -> DataFrame:
    """New files of ``source``, a folder or a single file."""
    fs, p = _fs(spark, source)
    if not fs.getFileStatus(p).isDirectory():
        source, path_glob = p.getParent().toString(), p.getName()
    reader = spark.readStream.schema(schema)
    for option, value in (("maxFilesPerTrigger", max_files), ("pathGlobFilter", path_glob), ("recursiveFileLookup", recursive or None)):
        if value:
            reader = reader.option(option, value)
    return reader.format(fmt).load(source)


def committed_stream(spark: SparkSession, sink: str, schema, max_files: int | None = None) -> DataFrame:
    """Good rows of another stage's sink, as its micro-batches finish."""
    return files_stream(spark, sink, _with_status(spark, schema), max_files=max_files).where("status = 'ok'").drop("status")


def run_stage(rows: DataFrame, sink: str, checkpoint: str, processing_time: str | None = None) -> StreamingQuery:
    """Write the streaming ``rows`` to ``sink``. Without ``processing_time`` the call returns when the available
    input is done."""
    spark = rows.sparkSession
    fs, log = _fs(spark, f"{sink}/_spark_metadata")
    fs.mkdirs(log)  # readers that start first then know that only its files count
    failed = F.col("error_class").isNotNull() if "error_class" in rows.columns else F.lit(False)
    out = rows.withColumn("status", F.when(failed, F.lit("failed")).otherwise(F.lit("ok")))
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).partitionBy("status")
    # state has a store for each partition and is written for each micro-batch: no more than two to a core; a stage that
    # goes on from a checkpoint keeps the number it began with
    width = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # a micro-batch lists its files once more, by default in a task for each of up to 10,000 files
    wanted = {STATE_STORE: ROCKSDB, "spark.sql.shuffle.partitions": str(width), LISTING: str(2 * spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if processing_time is None:
        query.awaitTermination()
    return query


def chain(rows: DataFrame, stages: Sequence[tuple[str, Transform, object]], root: str | None = None, name: str = "chain",
          max_files: int | None = None, processing_time: str | None = None) -> tuple[str, list[StreamingQuery]]:
    """R1 -> R2 -> ...: (name, transform, output schema) stages over the streaming ``rows``, each reading the
    committed good rows of the one before. Returns the last sink and the queries. ``root`` (a shared folder) keeps
    sinks and checkpoints between runs."""
    spark = rows.sparkSession
    base = root or work_path(spark, name)
    queries, sink = [], ""
    for i, (stage, fn, schema) in enumerate(stages):
        sink = sink_of(base, i, stage)
        queries.append(run_stage(fn(rows), sink, f"{base}/{i}_{stage}/checkpoint", processing_time))
        if i + 1 < len(stages):
            rows = committed_stream(spark, sink, schema, max_files)
    return sink, queries


def sink_of(root: str, number: int, stage: str) -> str:
    return f"{root}/{number}_{stage}/data"


# ---------------------------------------------------------------- sessions that come in parts
class _Assembler(StatefulProcessor):
    """State of a session: its rows, how many have come, how many there will be, and whether it has left."""

    def __init__(self, key: str, pos: str, total: str, fields: T.StructType):
        self.key, self.pos, self.total, self.fields = key, pos, total, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.fields)
        self.progress = handle.getValueState("progress", "have long, need long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        have, need, done = self.progress.get() or (0, None, False)
        new = []
        for pdf in rows:
            marks = pdf[self.total].dropna()
            need = int(marks.max()) if len(marks) else need
            new += list(pdf[self.fields.names].astype(object).where(pdf[self.fields.names].notna(), None).itertuples(index=False, name=None))
        have += len(new)
        if done:
            yield self._left(key, new, "LateRows")
        elif need is not None and have >= need:
            yield self._left(key, [*self.rows.get(), *new], None)
            self.rows.clear()
            done = True
        else:
            self.rows.appendList(new)
        self.progress.update((have, need, done))

    def _left(self, key, rows: list, error: str | None) -> pd.DataFrame:
        at = self.fields.names.index(self.pos)
        ordered = sorted((tuple(r) for r in rows), key=lambda r: r[at])
        return pd.DataFrame({self.key: [key[0]], "rows": [[dict(zip(self.fields.names, r)) for r in ordered]], "error_class": [error]})

    def close(self) -> None:
        pass


def assemble(rows: DataFrame, key: str, pos: str, total: str) -> DataFrame:
    """(key, rows, error_class): a session once all of its streaming ``rows`` have come, in whatever files and order.

    ``total`` is null but for the row with the session's end mark, where it is the number of the session's rows.
    ``rows`` is an array of the other columns, in the order of ``pos``."""
    fields = T.StructType([f for f in rows.schema.fields if f.name not in (key, total)])
    out = T.StructType([rows.schema[key], T.StructField("rows", T.ArrayType(fields)), T.StructField("error_class", T.StringType())])
    return rows.groupBy(key).transformWithStateInPandas(_Assembler(key, pos, total, fields), out, "Append", "None")


def end_marked(rows: DataFrame, key: str, pos: str, total: str) -> DataFrame:
    """Batch rows with the end mark that :func:`assemble` waits for: their number, on the last row of each session."""
    last = rows.groupBy(key).agg(F.max(pos).alias("_last"), F.count(F.lit(1)).alias("_n"))
    return (rows.join(last, key).withColumn(total, F.when(F.col(pos) == F.col("_last"), F.col("_n"))).drop("_last", "_n"))
