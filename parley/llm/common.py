"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.spark import work_path

#: Fixed by the contracts: a word is a run of anything but these blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimizer the true size of the table.
    """
    spark = df.sparkSession
    path = work_path(spark, "llm", label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A small driver-side table as a JSON literal, without an RDD behind it."""
    import json

    body = F.from_json(F.lit(json.dumps(rows)), T.ArrayType(schema))
    return spark.range(1).select(F.inline(body))


def labelled_ids(labels: DataFrame, label: str, learn: Column, max_rows: int, salt: int) -> DataFrame:
    """(doc_id, label) of at most about ``max_rows`` labelled documents.

    ``learn`` is a condition on ``doc_id`` that says which rows may be learned
    from. Rows are thinned by a hash of their id, so reruns take the same ones.
    Rows with a null id or label are not learned from.
    """
    keys = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn)
    total = keys.count()
    if total > max_rows:
        share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1_000_000))
        keys = keys.where(share < int(1_000_000 * max_rows / total))
    return keys


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents of ``labelled_ids``, which are few enough to broadcast."""
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of the same names, where null equals null; the keys stand once in the result."""
    renamed = {k: fresh(left, f"{k}_right") for k in keys}
    right = right.withColumnsRenamed(renamed)
    on = [left[k].eqNullSafe(right[r]) for k, r in renamed.items()]
    return left.join(right, on, how).drop(*renamed.values())


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut sorted batches of one partition into one frame per key, across batch borders."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys]
        new = (k != k.shift()).any(axis=1).to_numpy()
        if held:
            new[0] = tuple(held[-1][keys].iloc[-1]) != tuple(k.iloc[0])
        starts = new.nonzero()[0]
        if not len(starts):
            held.append(pdf)
            continue
        if starts[0] > 0:
            held.append(pdf.iloc[: starts[0]])
        if held:
            yield pd.concat(held, ignore_index=True)
        for a, b in zip(starts[:-1], starts[1:]):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[starts[-1]:]]
    if held:
        yield pd.concat(held, ignore_index=True)
