"""Words of many texts as 64-bit hashes, cut with numpy straight from Arrow's buffers.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as
a-z. Work proceeds in pieces of bounded size that end between words, so a long text
needs no more memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 21

_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
_VALUE = np.random.default_rng(11).integers(1, 2 ** 63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2 ** 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for b in (_ODD, _ODD_INVERSE):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, and where each text begins (one more for the end); null texts are empty."""
    texts = pa.array(["" if t is None else t for t in texts.to_pylist()], pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


@dataclass
class Words:
    """Words in order: number of the text, first byte and the byte after the last (within the column), hash."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> Iterator[Words]:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``, piece by piece."""
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    a = 0
    while a < len(data):
        b = min(a + piece, len(data))
        while b < len(data):  # to the end of the word, or of the text
            ahead = np.flatnonzero(~_WORD[data[b:b + 4096]] | begins[b:min(b + 4096, len(data))])
            if len(ahead):
                b += int(ahead[0])
                break
            b = min(b + 4096, len(data))
        yield _cut_piece(data[a:b], begins[a:b + 1], offsets, a)
        a = b


def _cut_piece(data: np.ndarray, begins: np.ndarray, offsets: np.ndarray, base: int) -> Words:
    inside = _WORD[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:-1]
    closes[:-1] &= ~inside[1:] | begins[1:-1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(offsets, start + base, side="right") - 1
    return Words(text, start + base, stop + base, _hashed(data, start, stop, 0))


def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the stretches of ``data``."""
    power, inverse = _tables(max(PIECE, len(data) + 1))
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUE[data] * power[:len(data)], out=total[1:])
        return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * np.uint64(_ODD) + np.uint64(kind))


def beginnings(data: np.ndarray, words: Words, which: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, in letters: the places in ``which`` of words that are longer, and hashes of their beginnings."""
    size = words.stop[which] - words.start[which]
    first = np.cumsum(size) - size
    own = data[np.repeat(words.start[which] - first, size) + np.arange(size.sum())]  # the bytes of these words only
    letters = np.flatnonzero((own & 0xC0) != 0x80)  # first bytes of characters
    at = np.searchsorted(letters, first)
    n = np.searchsorted(letters, first + size) - at
    out = []
    for k in lengths:
        longer = np.flatnonzero(n > k)
        out.append((longer, _hashed(own, first[longer], letters[at[longer] + k], k)))
    return out
