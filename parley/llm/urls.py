"""Operator 5: URL filters by Bloom filter cascades.

A cascade answers exactly, for every key of the corpus, whether it is listed.
Its first level is a Bloom filter of the listed keys; the second one of the
unlisted keys of the corpus that the first lets through; the third one of the
listed keys that the second lets through, and so on until nothing is let through
wrongly. A key is listed if the first level that lacks it is an even one. Levels
are built by tasks (partial bit maps, merged by bitwise or) over the complete key
universe, and only bit maps, whose size follows the list, reach the driver.

The keys of a url are the last labels of its host joined with the prefixes of its
path, for the numbers of labels and lengths that rules have. The longest listed
key is the rule; one cascade holds the allowing rules, one the blocking ones, and
one the blocked hosts: a table of hosts where one is given, or the hosts of the corpus of which a part is a listed word.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and is allowed; rules of equal length: the one with the longer host;
repeated urls get equal rows; long urls are read whole, and their number of keys
depends on the rules only; an empty table gives an empty result; only the id and
the url are read. An empty list gives a cascade without levels, which lists nothing.

A cascade of more than ``MAX_BITS`` is cut into shards by the keys' hashes, each a cascade of its own, which are built
and broadcast one after the other; membership stays exact and needs no join at any size of the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialise

#: host, path, verdict
Rule = tuple[str, str, str]
MAX_BITS = 1 << 27

#: Words that block a host when one of its parts (between dots and hyphens) is one of them.
BLOCKED_WORDS = (
    "ad", "ads", "adult", "banner", "bet", "bets", "betting", "bingo", "casino", "escort", "farm", "gambling", "jackpot",
    "loan", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker",
    "viagra", "warez", "xxx",
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter: ``hashes`` probes into ``bits`` bits, salted by its place in the cascade."""

    place: int
    bits: int
    hashes: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def probes(self, h: np.ndarray) -> np.ndarray:
        """keys x hashes: bit numbers of keys given as two hashes each."""
        step = _mix(h[:, 1] ^ _mix(np.array([self.place + 1], np.uint64))) | np.uint64(1)
        return np.stack([_mix(h[:, 0] + np.uint64(i + 1) * step) % np.uint64(self.bits) for i in range(self.hashes)], axis=1)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = self.probes(h)
        return (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).all(axis=1)


class Cascade:
    """Levels whose first lack decides: at an even place (from 0) unlisted, at an odd one listed."""

    def __init__(self, levels: Sequence[Level] = ()):
        self.levels = list(levels)

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Whether every level has the key."""
        ok = np.ones(len(h), bool)
        for level in self.levels:
            at = np.flatnonzero(ok)
            ok[at] = level.has(h[at])
        return ok

    def listed(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        open_ = np.arange(len(h))
        for k, level in enumerate(self.levels):
            has = level.has(h[open_])
            out[open_[~has]] = k % 2 == 1
            open_ = open_[has]
        out[open_] = len(self.levels) % 2 == 1
        return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of hash of a key."""
    return F.xxhash64(key), F.xxhash64(F.lit(77), key)


def _level_bits(keys: DataFrame, level: Level) -> np.ndarray:
    """Bit map of the keys (h1, h2): partial maps from tasks, merged by or."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.unique(level.probes(pdf[["h1", "h2"]].to_numpy(np.int64).astype(np.uint64)))
            word, at = np.unique(p >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (p & np.uint64(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.astype(np.int64)})

    rows = keys.mapInPandas(partial, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((level.bits + 63) // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def level_size(place: int, n_in: int, n_out: int) -> tuple[int, int]:
    """Bits and hashes of a level for ``n_in`` keys that must pass and ``n_out`` that should not."""
    # the first level lets through about as many unlisted keys as there are listed ones
    rate = min(0.5, max(1e-6, 0.7 * n_in / max(n_out, 1))) if place == 0 else 0.5
    bits = max(64, math.ceil(n_in * math.log(1 / rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / n_in * math.log(2))) if n_in > 8 else 4


def shards_for(n_in: int, n_out: int, max_bits: int) -> int:
    """Shards of which each cascade keeps to about ``max_bits``: the first level, and half as many keys again for the others."""
    return max(1, math.ceil((level_size(0, n_in, n_out)[0] + 3 * n_in) / max_bits)) if n_in else 1


def build(keys: DataFrame) -> Cascade:
    """Cascade of distinct keys (h1, h2, listed)."""
    cascade = Cascade()
    left = keys.select("h1", "h2", "listed")
    while True:
        inside = F.col("listed") == F.lit(len(cascade.levels) % 2 == 0)
        n_in, n_out = left.agg(F.count_if(inside), F.count_if(~inside)).first()
        if not n_in:
            return cascade
        level = Level(len(cascade.levels), *level_size(len(cascade.levels), n_in, n_out))
        level.words = _level_bits(left.where(inside).select("h1", "h2"), level)
        cascade.levels.append(level)

        @F.pandas_udf("boolean")
        def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
            return pd.Series(level.has(np.stack([h1, h2], axis=1).astype(np.int64).astype(np.uint64)))

        # keys that the new level encodes stay as those that the next one must not let through
        left = materialise(left.where(inside | passes("h1", "h2")), "cascade")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return (F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The keys under which rules can list a url, longest host first."""
    labels = F.split(host, r"\.", -1)
    depths = sorted({h.count(".") + 1 for h, _, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    keys = []
    for d in depths:
        tail = F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), "."))
        for n in lengths:
            keys.append(F.when(F.length(path) >= n, F.concat(tail, F.substring(path, 1, n))))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def member(cascade: Cascade, keys: Column, spark) -> Column:
    """array<boolean>: which keys of an array are listed."""
    shared = spark.sparkContext.broadcast(cascade)  # about MAX_BITS

    @F.pandas_udf("array<boolean>")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        n = np.array([len(x) for x in h1])
        if not n.sum():
            return pd.Series([np.zeros(0, bool)] * len(n))
        h = np.stack([np.concatenate(h1.tolist()), np.concatenate(h2.tolist())], axis=1).astype(np.int64).astype(np.uint64)
        return pd.Series(np.split(shared.value.listed(h), np.cumsum(n)[:-1]))

    return test(F.transform(keys, lambda k: key_hashes(k)[0]), F.transform(keys, lambda k: key_hashes(k)[1]))


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(h1, F.lit(shards))


def _listed_keys(df: DataFrame, keys: str, universe: DataFrame, listed: Column, max_bits: int) -> DataFrame:
    """``df`` with the array column ``keys`` replaced by those of its keys that are listed.

    ``universe`` holds all distinct keys (key); ``listed`` is a condition on them.
    """
    u = materialise(universe.select(key_hashes(F.col("key"))[0].alias("h1"), key_hashes(F.col("key"))[1].alias("h2"), listed.alias("listed")), "universe")
    shards = shards_for(*u.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first(), max_bits)
    for shard in range(shards):
        cascade = build(u.where(_shard(F.col("h1"), shards) == shard))
        elsewhere = F.transform(keys, lambda k: _shard(key_hashes(k)[0], shards) != shard)  # keys of other shards wait for theirs
        flags = member(cascade, F.col(keys), df.sparkSession)
        kept = F.filter(F.arrays_zip(F.col(keys).alias("k"), flags.alias("f"), elsewhere.alias("e")), lambda x: x["f"] | x["e"])
        df = df.withColumn(keys, F.transform(kept, lambda x: x["k"]))
        if shard + 1 < shards:
            df = materialise(df, "sharded")  # one cascade at a time
    return df


def blocked_by_words(hosts: DataFrame, words: Sequence[str] = BLOCKED_WORDS) -> DataFrame:
    """(host) of the rows (host) of which a part, between dots and hyphens, is one of ``words``."""
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    return hosts.where(F.coalesce(bad, F.lit(False))).select("host").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule], blocked_words: Sequence[str] = BLOCKED_WORDS, max_bits: int = MAX_BITS,
          blocked_hosts: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url. ``blocked_hosts`` (host) is a list of hosts to block; without it
    the hosts of the corpus that ``blocked_words`` block are listed."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("allowing", rule_keys(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("blocking", F.col("allowing")).withColumn("hosts", F.array("host"))
    by = {v: [h + p for h, p, w in rules if w == v] for v in ("allow", "block")}
    keys = materialise(parts.select(F.explode("allowing").alias("key")).distinct(), "keys")
    hosts = materialise(parts.select("host").distinct(), "hosts")
    is_in = lambda v: F.col("key").isin(by[v]) if by[v] else F.lit(False)
    out = _listed_keys(parts, "allowing", keys, is_in("allow"), max_bits)
    out = _listed_keys(out, "blocking", keys, is_in("block"), max_bits)
    bad = (blocked_by_words(hosts, blocked_words) if blocked_hosts is None else blocked_hosts.select("host").where(F.col("host").isNotNull()).distinct())
    universe = hosts.join(bad.select(F.col("host").alias("bad")), F.col("host") == F.col("bad"), "left")
    out = _listed_keys(out, "hosts", universe.select(F.col("host").alias("key"), F.col("bad").isNotNull().alias("is_bad")), F.col("is_bad"), max_bits)
    rank = lambda k, v: F.struct(F.length(k).alias("n"), F.instr(F.concat(k, F.lit("/")), "/").alias("host"), k.alias("rule"), F.lit(v).alias("verdict"))
    best = F.array_max(F.concat(F.transform("allowing", lambda k: rank(k, "allow")), F.transform("blocking", lambda k: rank(k, "block"))))
    out = out.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(
        F.col("best.verdict"), F.when(F.size("hosts") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
