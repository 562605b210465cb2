"""Operator 11: benchmark decontamination with an FM-index per training shard.

Consecutive documents of a scan partition form shards of about ``SHARD_WORDS`` words. A
shard's distinct texts become one string of word symbols with an FM-index, stored once
in the shared folder; it knows nothing of the benchmark and can be searched again for
another one. A text longer than a shard goes on in the next, which repeats its last
words, so no window is cut in two.

Test phrases are windows of ``WINDOW`` words of the benchmark texts (shorter texts are one
window). They are the query set: distinct (window, item) pairs, dealt into blocks of about
``BLOCK_PAIRS`` by hash, and each block is sent to all shards. Backward search through
wavelet-tree ranks finds the suffixes that begin with a phrase, sampled suffix
positions locate them, and overlapping occurrences merge into removal spans. Spans and
items of a document from several shards or blocks meet by its row number.

Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words and are never hit; benchmark texts
without words are no items; an item with a null id is searched, but not counted or
listed; rows that repeat an item's id are one item; repeated document rows get equal
results each; rows with a null id are searched like others; long texts are searched whole;
an empty benchmark hits nothing; an empty table gives an empty result; only id and text
are read of either table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import fmindex, wordhash
from parley.llm.common import fresh, join_same, materialise

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_PAIRS = 200_000
#: Row numbers of one scan partition (its number stands above them).
ROW_BITS = 40


class Shard:
    """Texts of the shard that is being filled."""

    def __init__(self):
        self.units: list[np.ndarray] = []  # word hashes of distinct texts, or of stretches of a long one
        self.unit_of: dict[tuple, int] = {}
        self.held: list[tuple[int, int, int]] = []  # row, its unit, words of the text before the unit
        self.rows: list[dict] = []
        self.size = 0

    def add(self, row: int, words: np.ndarray, before: int, key: tuple | None) -> None:
        unit = self.unit_of.get(key)
        if unit is None:
            unit = len(self.units)
            self.units.append(words)
            self.size += len(words)
            if key:
                self.unit_of[key] = unit
        self.held.append((row, unit, before))

    def stored(self) -> bytes | None:
        """The index over all units."""
        if not self.units:
            return None
        sizes = np.array([len(u) for u in self.units])
        codes, seen = pd.factorize(np.concatenate(self.units))
        by = np.argsort(seen)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        start = np.cumsum(sizes + 1) - sizes - 1
        ends = start + sizes
        s = np.empty(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(s), bool)
        inside[ends] = False
        s[inside] = len(sizes) + place[codes]
        s[ends] = np.arange(len(sizes))
        held = np.array(self.held, np.int64)
        return fmindex.store(fmindex.FMIndex.arrays(s, len(sizes) + len(seen)) | {
            "words": seen[by], "start": start, "row": held[:, 0], "unit": held[:, 1], "before": held[:, 2]})


def fill(batches: Iterator[pa.RecordBatch], shard_words: int, first_row: int) -> Iterator[Shard]:
    """Shards of consecutive (doc_id, text_hash, text) rows."""
    shard, row = Shard(), first_row
    for batch in batches:
        ids, hashes, texts = (batch.column(i) for i in range(3))
        data, offsets = wordhash.buffers(texts)
        ids, hashes = ids.to_pylist(), hashes.to_pylist()
        now, parts, before, have = 0, [], 0, 0  # the text that is being read, its words so far, and how many of them went to earlier stretches

        def finish(text: int) -> None:
            nonlocal parts, before, have, now, row
            if have:
                # whole texts that are equal share a unit
                key = (hashes[text], int(offsets[text + 1] - offsets[text])) if not before else None
                shard.add(row, np.concatenate(parts), before, key)
            shard.rows.append({"row": row, "doc_id": ids[text], "text_hash": hashes[text], "n_words": before + have})
            parts, before, have, now, row = [], 0, 0, text + 1, row + 1

        for words in wordhash.cut(data, offsets):
            cuts = np.flatnonzero(np.diff(words.text)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words.text)]):
                if a == b:
                    continue
                while now < words.text[a]:
                    finish(now)
                    if shard.size >= shard_words:
                        yield shard
                        shard = Shard()
                parts.append(words.hash[a:b])
                have += b - a
                while have > shard_words + WINDOW:  # a long text: a stretch of it, whose last words begin the next one
                    whole = np.concatenate(parts)
                    shard.add(row, whole[:shard_words], before, None)
                    kept = shard_words - (WINDOW - 1)
                    parts, before, have = [whole[kept:]], before + kept, have - kept
                    yield shard
                    shard = Shard()
        while now < len(ids):
            finish(now)
            if shard.size >= shard_words:
                yield shard
                shard = Shard()
    if shard.rows or shard.units:
        yield shard


def index_shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(rows, index): a row per shard, with the documents that end there and the stored FM-index."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << ROW_BITS
        schema = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = pa.struct([("row", pa.int64()), ("doc_id", b.schema.field(0).type), ("text_hash", pa.int64()), ("n_words", pa.int64())])
                yield b

        for shard in fill(typed(), shard_words, first):
            yield pa.RecordBatch.from_arrays([pa.array([shard.rows], pa.list_(schema)), pa.array([shard.stored()], pa.binary())], ["rows", "index"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        build, f"rows array<struct<row:bigint,doc_id:{kind},text_hash:bigint,n_words:bigint>>, index binary")


def phrases(benchmark: DataFrame) -> DataFrame:
    """(window, item): distinct windows of word hashes (8 bytes each) and the items they come from."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wordhash.buffers(batch.column(1))
            found = list(wordhash.cut(data, offsets))
            text, h = (np.concatenate([getattr(w, k) for w in found] or [np.zeros(0, np.int64)]) for k in ("text", "hash"))
            ids, out, of = batch.column(0).to_pylist(), [], []
            for i, a, b in zip(range(len(ids)), np.searchsorted(text, np.arange(len(ids))), np.searchsorted(text, np.arange(len(ids)), side="right")):
                for k in range(a, max(b - WINDOW + 1, a + 1) if b > a else a):
                    out.append(h[k:min(k + WINDOW, b)].astype("<u8").tobytes())
                    of.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(of, pa.string())], ["window", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(windows, "window binary, item string").distinct()


class Phrases:
    """One block of the query set: windows by their length, and the items of each."""

    def __init__(self, windows: list[bytes], items: list[str | None]):
        self.items = sorted({i for i in items if i is not None})
        place = {i: k for k, i in enumerate(self.items)}
        of: dict[bytes, list[int]] = {}
        for w, i in zip(windows, items):
            of.setdefault(w, []).extend([place[i]] if i is not None else [])
        self.groups = []
        for n in sorted({len(w) for w in of}):
            mine = [w for w in of if len(w) == n]
            sizes = np.array([len(of[w]) for w in mine])
            self.groups.append((np.frombuffer(b"".join(mine), "<u8").reshape(len(mine), -1), np.cumsum(sizes) - sizes, sizes,
                                np.array([i for w in mine for i in of[w]], np.int64)))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``start`` and have ``size`` numbers."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def search_shard(a: dict[str, np.ndarray], block: Phrases) -> tuple[np.ndarray, ...]:
    """Occurrences in a stored shard: merged spans (unit, start, stop within it), and distinct (unit, item) pairs."""
    fm, words, start = fmindex.FMIndex.of(a), a["words"], a["start"]
    change = np.zeros(fm.n + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for windows, first, sizes, items in block.groups:
        at = np.searchsorted(words, windows)
        known = np.flatnonzero((words[np.minimum(at, len(words) - 1)] == windows).all(axis=1))
        row, low, high = fm.search(at[known] + len(start))
        where = fm.locate(spread(low, high - low))
        np.add.at(change, where, 1)
        np.add.at(change, where + windows.shape[1], -1)
        unit = np.searchsorted(start, where, side="right") - 1
        row = known[np.repeat(row, high - low)]
        pairs.append(np.unique(np.repeat(unit, sizes[row]) * len(block.items) + items[spread(first[row], sizes[row])]))
    hit = np.cumsum(change) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    opens, closes = edge[::2], edge[1::2]
    unit = np.searchsorted(start, opens, side="right") - 1
    pair = np.unique(np.concatenate(pairs))
    return unit, opens - start[unit], closes - start[unit], pair // max(len(block.items), 1), pair % max(len(block.items), 1)


def search(index: DataFrame, windows: list[bytes], items: list[str | None]) -> DataFrame:
    """(row, starts, stops, items) of the documents in which windows of one block occur."""
    shared = index.sparkSession.sparkContext.broadcast(Phrases(windows, items))  # at most about BLOCK_PAIRS pairs
    schema = pa.schema([("row", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for data in batch.column(0):
                if not data.is_valid:
                    continue
                a = fmindex.load(data.as_py())
                unit, opens, closes, item_unit, item = search_shard(a, block)
                names = np.array(block.items, object)[item] if len(item) else np.zeros(0, object)
                out: list[list] = [[], [], [], []]
                mine = np.flatnonzero(np.isin(a["unit"], unit))
                for row, u, before in zip(a["row"][mine].tolist(), a["unit"][mine], a["before"][mine]):
                    s, e = np.searchsorted(unit, [u, u + 1])
                    i, j = np.searchsorted(item_unit, [u, u + 1])
                    for column, v in zip(out, (row, opens[s:e] + before, closes[s:e] + before, names[i:j].tolist())):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return index.select("index").mapInArrow(found, "row long, starts array<long>, stops array<long>, items array<string>")


def merge(starts: pd.Series, stops: pd.Series) -> pd.Series:
    """Union of intervals, in order."""
    out = []
    for a, b in zip(starts, stops):
        by = np.argsort(a, kind="stable")
        a, b = np.asarray(a)[by], np.maximum.accumulate(np.asarray(b)[by])
        new = np.concatenate([[True], a[1:] > b[:-1]])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
        out.append([{"start": s, "stop": e} for s, e in zip(a[new].tolist(), b[last].tolist())])
    return pd.Series(out)


def contamination(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of every document: merged spans of hit words, and the items found."""
    index = materialise(index_shards(docs, shard_words), "fm_index")
    query = materialise(phrases(benchmark), "fm_phrases")
    blocks = max(1, -(-query.count() // block_pairs))
    found = []
    for k in range(blocks):
        block = query.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).toArrow()
        found.append(search(index, block["window"].to_pylist(), block["item"].to_pylist()))
    per = reduce(DataFrame.unionAll, found).groupBy(F.col("row").alias("hit_row")).agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.pandas_udf(merge, "array<struct<start:bigint,stop:bigint>>")
    per = per.select("hit_row", merged("starts", "stops").alias("spans"), "items")
    rows = index.select(F.explode("rows").alias("r")).select("r.*")
    out = rows.join(per, F.col("row") == F.col("hit_row"), "left")
    none = lambda c: F.coalesce(c, F.array().cast(per.schema[c].dataType)).alias(c)
    return out.select("doc_id", "text_hash", "n_words", none("spans"), none("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the words of the spans cut out of their texts, from each span's first byte to its last;
    other texts and all other columns stay as they are."""
    own, spans, right_id = fresh(docs, "own_hash"), fresh(docs, "spans"), fresh(docs, "hit_id")
    hit = found.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(right_id), F.col("text_hash").alias(own)).agg(F.first("spans").alias(spans))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            data, offsets = wordhash.buffers(pa.array([text]))
            found = list(wordhash.cut(data, offsets))
            first, last = (np.concatenate([getattr(w, k) for w in found]) for k in ("start", "stop"))
            raw, at, kept = data.tobytes(), 0, []
            for c in cuts:
                kept.append(raw[at:first[c["start"]]])
                at = int(last[c["stop"] - 1])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out)

    marked = join_same(docs.withColumn(own, F.xxhash64("text")).withColumn(right_id, F.col("doc_id")), hit, [right_id, own])
    dirty = marked.where(F.col(spans).isNotNull()).withColumn("text", without("text", spans))
    return marked.where(F.col(spans).isNull()).unionByName(dirty).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = contamination(docs, benchmark).withColumn("n_hit", n_hit(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
