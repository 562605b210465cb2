"""Operator 9: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of 5-word shingles; two are linked at a Jaccard similarity of
0.8 or more. Equal sets are one class and are compared once. Banded MinHash keys
propose candidates: all classes that meet in some band lie in one candidate
component. The pairs of a component are compared block against block: MinHash
values in steps of 32, dropping a pair when the posterior probability that its
similarity reaches the threshold falls below ``TOLERANCE`` (uniform prior); pairs
that survive are verified exactly by counting common shingles. A large component
is spread over many tasks, one for each pair of its blocks. Tasks return counts
of links and one edge per class, never the pairs of a group.

With 48 bands of 6 values a pair at the threshold is missed with probability
below 1e-6 (and then only if no third class brings the two together).

Defined results: a document of one to four words has one shingle, all its words;
a null or empty text, or one without words, has no shingles and no links, and is
a class of its own; copies are linked to each other; rows with a null id take
part and count as links, and a class of only such rows has a null id; repeated
rows count as copies; long texts are compared whole; an empty table gives an
empty result; extra columns are not read (or are kept by the filter).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fresh, materialise, runs_of
from parley.llm.graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 48, 6
#: MinHash values compared by the pruning, and how many at a time.
PRUNE_VALUES, PRUNE_STEP = 128, 32
TOLERANCE = 1e-7
#: Classes to a block of a large component; tasks over which the rows of one component meet its size.
BLOCK, SALTS = 256, 64

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_rng = np.random.default_rng(9)
_MULT = _rng.integers(1, 2 ** 63, BANDS * BAND_ROWS // 2, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2 ** 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words, remembered in ``known`` (bounded)."""
    if len(known) > 400_000:
        known.clear()
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        for w in {w for w in words if w not in known}:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return np.array([known[w] for w in words], np.uint64)


def shingles(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    w = _words(text or "")
    if not w:
        return np.zeros(0, np.uint64)
    h = word_hashes(w, known)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total += mix64(h[k:k + n] ^ _PLACE[k]) * _PLACE[k]
    return np.unique(mix64(total))


def min_hashes(s: np.ndarray, values: int) -> np.ndarray:
    """The first ``values`` MinHash values of a non-empty set; long sets in pieces.

    Both halves of a 64-bit product serve as a hash of the (already random) member.
    """
    out = np.full(values, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(s), 512):
        part = s[a:a + 512, None] * _MULT[None, :values // 2]
        np.minimum(out, part.view(np.uint32).min(axis=0), out=out)
    return out


def least_matches() -> dict[int, int]:
    """For n compared values, the fewest matches with which a pair is kept.

    P(similarity >= threshold | m of n match) under a uniform prior is the upper
    tail of Beta(m + 1, n - m + 1), which is a binomial sum.
    """
    need = {}
    for n in range(PRUNE_STEP, PRUNE_VALUES + 1, PRUNE_STEP):
        for m in range(n + 1):
            tail = sum(math.comb(n + 1, i) * THRESHOLD ** i * (1 - THRESHOLD) ** (n + 1 - i) for i in range(m + 1))
            if tail >= TOLERANCE:
                need[n] = m
                break
    return need


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for pdf in batches:
        h, n, bands = [], [], []
        for text in pdf["text"]:
            s = shingles(text, known)
            if not len(s):
                h.append(None), n.append(0), bands.append(None)
                continue
            m = min_hashes(s, BANDS * BAND_ROWS).astype(np.uint64).reshape(BANDS, BAND_ROWS)
            key = np.arange(BANDS, dtype=np.uint64)
            for r in range(BAND_ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
            h.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)))
            n.append(len(s))
            bands.append(key.astype(np.int64))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "class": pd.array(h, "Int64"), "n": n, "bands": bands})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class, n, bands): class is a hash of the shingle set, null without shingles."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(
        _sketch, "doc_id long, text_hash long, class long, n int, bands array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b) of classes that share a band key: each class with the smallest one of its key."""
    keys = classes.select("class", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    return keys.join(hubs, "key").where(F.col("class") != F.col("hub")).select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: which pairs of sets reach the threshold. Bayesian pruning, then exact counts."""
    need = least_matches()
    alive = np.ones((len(left), len(right)), bool)
    sig = np.stack([min_hashes(s, PRUNE_VALUES) for s in sets])
    same = np.zeros(alive.shape, np.int16)
    for a in range(0, PRUNE_VALUES, PRUNE_STEP):
        for k in range(a, a + PRUNE_STEP):
            same += sig[left, k][:, None] == sig[right, k][None, :]
        alive &= same >= need[a + PRUNE_STEP]
    if not alive.any():
        return alive
    used = np.unique(np.concatenate([left[alive.any(axis=1)], right[alive.any(axis=0)]]))
    _, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    shared = np.bincount(place) > 1
    owner, place = owner[shared[place]], (np.cumsum(shared) - 1)[place[shared[place]]]
    common = np.zeros((len(left), len(right)), np.float32)
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for a in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(place, (a, a + 8192))
        grid = np.zeros((len(used) + 1, 8192), np.float32)  # the last row stands for sets without a live pair
        grid[owner[lo:hi], place[lo:hi] - a] = 1
        common += grid[row[left]] @ grid[row[right]].T
    size = np.array([len(s) for s in sets], np.float64)
    either = size[left][:, None] + size[right][None, :] - common
    return alive & (common >= THRESHOLD * either - 1e-9)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the classes of each pair of blocks; one row per class and pair of blocks."""
    known: dict[str, int] = {}
    out: list[pd.DataFrame] = []
    rows = 0
    for group in runs_of(batches, ["label", "i", "j"]):
        group = group.drop_duplicates("class")
        sets = [shingles(t, known) for t in group["text"]]
        block, cls, copies = group["block"].to_numpy(), group["class"].to_numpy(), group["copies"].to_numpy()
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        yes = linked(sets, left, right)
        pairs = np.zeros((len(sets), len(sets)), bool)
        pairs[np.ix_(left, right)] = yes
        pairs |= pairs.T
        np.fill_diagonal(pairs, False)
        root = cls.copy()
        while True:  # smallest class that can be reached
            near = np.where(pairs, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            new = np.minimum(root, near)
            if (new == root).all():
                break
            root = new
        out.append(pd.DataFrame({"class": cls, "links": pairs @ copies, "root": root}))
        rows += len(cls)
        if rows > 5000:
            yield pd.concat(out)
            out, rows = [], 0
    if out:
        yield pd.concat(out)


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links): one row per row of ``docs``.

    ``class_id`` is the smallest id of the documents that links connect, and
    ``n_links`` the number of other documents with a similarity of at least 0.8.
    """
    found = materialise(sketches(docs), "sketches")
    classes = found.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    proposed = connected_components(candidate_edges(classes))
    # only components of more than one block need their size; their rows meet it under many salts
    large = proposed.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    large = large.select(F.col("label").alias("of"), "members", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sized = proposed.join(large, (F.col("label") == F.col("of")) & (F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(SALTS)) == F.col("salt")), "left")
    members = sized.join(classes.select(F.col("class").alias("node"), "doc_id", "copies"), "node")
    blocks = F.ceil(F.coalesce("members", F.lit(1)) / BLOCK)
    members = members.select("label", F.col("node").alias("class"), "doc_id", "copies", blocks.cast("int").alias("blocks"),
                             F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    members = materialise(members, "members")
    # the row of the class's own document; where ids are repeated, the hash of the set tells which
    own = found.select(F.col("doc_id").alias("own_id"), F.col("class").alias("own_class"), "text_hash")
    own = own.where("own_class is not null").groupBy("own_class").agg(F.min_by("text_hash", F.coalesce("own_id", F.lit(2 ** 63 - 1))).alias("text_hash"))
    texts = docs.select(F.col("doc_id").alias("text_id"), F.xxhash64("text").alias("own_hash"), "text")
    wanted = members.join(own, members["class"] == own["own_class"])
    rows = texts.join(wanted, texts["text_id"].eqNullSafe(wanted["doc_id"]) & (texts["own_hash"] == wanted["text_hash"]))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = rows.select("label", "class", "copies", "block", "text", other).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "copies", "text")
    compared = pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInPandas(
        _compare, "class long, links long, root long")
    compared = materialise(compared, "compared")
    links = compared.groupBy("class").agg(F.sum("links").alias("links"))
    groups = connected_components(compared.select(F.col("class").alias("a"), F.col("root").alias("b")).distinct())
    per = classes.select("class", "doc_id", "copies").join(groups.withColumnRenamed("node", "class"), "class", "left")
    per = per.withColumn("label", F.coalesce("label", "class")).join(links, "class", "left")
    per = materialise(per.select("class", "label", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    first = per.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = per.join(first, "label").select("class", "class_id", "n_links")
    out = found.select("doc_id", "text_hash", "class").join(named, "class", "left")
    return out.select("doc_id", "text_hash", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each connected group, the one with the smallest id; all columns kept.

    Documents without words stay; a group without any id keeps one row.
    """
    names = {k: fresh(docs, k) for k in ("own_hash", "first_id", "first_hash", "n")}
    found = join_documents(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias(names["first_id"]), F.col("text_hash").alias(names["first_hash"])).distinct()
    d = docs.withColumn(names["own_hash"], F.xxhash64("text"))
    kept = d.join(first, d["doc_id"].eqNullSafe(first[names["first_id"]]) & (d[names["own_hash"]] == first[names["first_hash"]]), "left_semi")
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", names["own_hash"]).orderBy(F.lit(1))
    return kept.withColumn(names["n"], F.row_number().over(w)).where(F.col(names["n"]) == 1).drop(names["n"], names["own_hash"])
