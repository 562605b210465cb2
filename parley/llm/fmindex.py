"""FM-index of a shard of texts, in numpy: suffix order, wavelet matrix, sampled positions.

A shard is a string of symbols in which each text ends with a symbol of its own, so
all suffixes differ. The last column of the sorted suffixes (BWT) stands in a wavelet
matrix, whose ranks extend a pattern to the left, all patterns at once. Every
``STEP``-th position of the string is kept at its suffix; other suffixes walk to the
left until they meet one.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

STEP = 16


def suffix_order(s: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of ``s`` in the order of their suffixes, by doubling: each round sorts only
    suffixes that are still equal, by the order of what follows the part already compared."""
    n = len(s)
    bits = max(1, int(symbols - 1).bit_length())
    depth = max(1, 62 // bits)
    key = s.astype(np.int64)
    for t in range(1, depth):
        key = key << bits | np.concatenate([s[t:], s[:t]])[:n] if t < n else key << bits
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of two or more
    while len(open_):
        at = order[open_]
        key = rank[at] * n + rank[(at + depth) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, len(at))))
        open_ = open_[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, bitorder="little")
        return np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


@dataclass
class FMIndex:
    n: int
    levels: list[Bits]
    zeros: list[int]
    shift: np.ndarray  # of a symbol: from its place below the last level to its first suffix
    marked: Bits
    kept: np.ndarray

    @classmethod
    def arrays(cls, s: np.ndarray, symbols: int) -> dict[str, np.ndarray]:
        """The parts of an index over ``s``, as arrays to store."""
        order = suffix_order(s, symbols)
        column = s[order - 1]
        depth = max(1, int(symbols - 1).bit_length())
        levels, zeros, cur = [], [], column
        for level in range(depth - 1, -1, -1):
            bit = (cur >> level & 1).astype(bool)
            levels.append(Bits.pack(bit))
            zeros.append(len(bit) - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        marked = order % STEP == 0
        count = np.bincount(s, minlength=symbols)
        first = np.cumsum(count) - count
        below = np.zeros(symbols, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], cur[1:] != cur[:-1]]))
        below[cur[starts]] = starts
        return {"n": np.array([len(s)]), "levels": np.stack(levels), "zeros": np.array(zeros), "shift": (first - below).astype(np.int32),
                "marked": Bits.pack(marked), "kept": order[marked].astype(np.int32)}

    @classmethod
    def of(cls, a: dict[str, np.ndarray]) -> FMIndex:
        return cls(int(a["n"][0]), [Bits(w) for w in a["levels"]], a["zeros"].tolist(), a["shift"].astype(np.int64), Bits(a["marked"]), a["kept"].astype(np.int64))

    def extend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """For a bound ``i`` of suffixes: the same bound among those that ``c`` precedes."""
        top = len(self.levels) - 1
        for k, (bits, z) in enumerate(zip(self.levels, self.zeros)):
            one = bits.ones(i)
            i = np.where(c >> (top - k) & 1, z + one, i - one)
        return i + self.shift[c]

    def left(self, i: np.ndarray) -> np.ndarray:
        """The suffixes that begin one symbol earlier."""
        c = np.zeros(len(i), np.int64)
        for bits, z in zip(self.levels, self.zeros):
            one, b = bits.ones(i), bits.get(i)
            c = c << 1 | b
            i = np.where(b, z + one, i - one)
        return i + self.shift[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows, all of one length) that occur: their rows, and their first and last-but-one suffixes."""
        row = np.arange(len(patterns))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        for t in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[row, t]
            both = self.extend(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = both[:len(c)], both[len(c):]
            some = low < high
            row, low, high = row[some], low[some], high[some]
        return row, low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Positions of suffixes in the string."""
        out = np.empty(len(suffixes), np.int64)
        at, i, walked = np.arange(len(suffixes)), suffixes, 0
        while len(at):
            here = self.marked.get(i)
            out[at[here]] = self.kept[self.marked.ones(i[here])] + walked
            at, i, walked = at[~here], self.left(i[~here]), walked + 1
        return out


def store(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))
