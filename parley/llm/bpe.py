"""Operator 4: byte-level BPE encoding and decoding.

Batched numpy merge rounds. The distinct words of a batch lie in one flat symbol
array. In each round the ranks of all neighbouring pairs are found by binary
search over the sorted pair keys, every word merges its lowest-ranked pair, and
words without a mergeable pair leave the array. Words already encoded by a worker
are remembered (bounded), so a frequent word is encoded once.

Defined results: a null or empty text has no tokens and decodes to the empty
text; long texts are encoded whole (a text's words are in memory at once, and a batch of texts in groups of
bounded size); repeated rows each get their own row; extra columns do not matter, only the id and the text
are read. Special tokens that stand in a text become their ids, and decoding
gives their text back. Decoding replaces malformed UTF-8 by U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the byte-level pre-tokenizer: its word pattern, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))

#: Texts are handled in pieces of about so many characters, and so many words are remembered.
PIECE_CHARS = 1_500_000
KEPT_WORDS = 300_000


def byte_letters() -> list[str]:
    """The letter that the vocabulary uses for each byte value."""
    letters, spare = {b: chr(b) for b in PRINTABLE}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Bpe:
    """A vocabulary as sorted arrays: small, of fixed size, cheap to ship to workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.base = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        pieces: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.pieces = pieces

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or a very large number) and position of each pair, by binary search."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        rank = np.where(self.keys[at] == want, self.ranks[at], np.iinfo(np.int64).max)
        return rank, at

    def encode_words(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each word."""
        lengths = np.array([len(x) for x in items], np.int64)
        symbols = self.base[np.frombuffer(b"".join(items), np.uint8)]
        word = np.repeat(np.arange(len(items)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.iinfo(np.int64).max
        while len(symbols):
            rank = np.full(len(symbols), none)
            at = np.zeros(len(symbols), np.int64)
            rank[:-1], at[:-1] = self.lookup(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = none
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            spans = np.diff(np.append(first, len(symbols)))
            ended = np.repeat(least == none, spans)
            if ended.any():
                done.append((word[ended], symbols[ended]))
            least_here = np.repeat(least, spans)
            hit = (rank == least_here) & ~ended
            # a run of overlapping hits (as in "aaaa") merges every second one, from the left
            at_hit = np.flatnonzero(hit)
            if len(at_hit):
                new_run = np.concatenate(([True], np.diff(at_hit) != 1))
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at_hit)), 0))
                at_hit = at_hit[(np.arange(len(at_hit)) - start) % 2 == 0]
            symbols = symbols.copy()
            symbols[at_hit] = self.merged[at[at_hit]]
            keep = ~ended
            keep[at_hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(items), np.int64)
        who = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])
        order = np.argsort(who, kind="stable")
        return ids[order], np.bincount(who, minlength=len(items))


class Codec:
    """Encodes and decodes texts in one worker; remembers the words it has met."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.words = regex.compile(PATTERN).findall
        marks = sorted(bpe.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split if marks else None
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, np.ndarray] = {}
        self.text: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens stand as pieces of their own."""
        if self.split is None:
            return self.words(text)
        parts = self.split(text)
        if len(parts) == 1:
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)  # no pre-token starts with NUL and goes on with other than symbols
            else:
                out += self.words(part)
        return out

    def learn(self, fresh: list[str]) -> None:
        """Encode words not met before, and decode their ids again."""
        plain = []
        for w in fresh:
            if w[0] == "\0" and w[1:] in self.bpe.special:
                self.keep(w, np.array([self.bpe.special[w[1:]]]))
            else:
                plain.append(w)
        if plain:
            ids, counts = self.bpe.encode_words([w.encode("utf-8") for w in plain])
            for w, own in zip(plain, np.split(ids, np.cumsum(counts)[:-1])):
                self.keep(w, own)

    def keep(self, w: str, ids: np.ndarray) -> None:
        own = ids.tolist()
        self.ids[w] = ids.astype(np.int32)
        self.text[w] = ",".join(map(str, own))
        self.back[w] = b"".join([self.bpe.pieces[i] for i in own])

    def batch(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """Pieces of the texts, group by group; the words of a group are known when it comes."""
        group: list[list[str]] = []
        chars = 0
        for t in texts:
            group.append(self.pieces(t) if t else [])
            chars += len(t or "")
            if chars >= PIECE_CHARS:
                yield self.known(group)
                group, chars = [], 0
        if group:
            yield self.known(group)

    def known(self, group: list[list[str]]) -> list[list[str]]:
        if len(self.ids) > KEPT_WORDS:
            self.clear()
        new = set()
        for p in group:
            new.update(p)
        new -= self.ids.keys()
        if new:
            self.learn(sorted(new))
        return group


def decode_ids(bpe: Bpe, ids: list[int]) -> str:
    """Text of token ids; ids outside the vocabulary give nothing."""
    pieces = bpe.pieces
    return b"".join([pieces[i] for i in ids if 0 <= i < len(pieces)]).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per vocabulary and worker process; several batches and tasks share it."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, digests: bool = True, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its arrays
    have a fixed size (a few MB) and are broadcast. ``ids`` adds the token ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Bpe(vocabulary))
    schema = "doc_id long, n_tokens long"
    schema += ", ids_sha256 string, decoded_sha256 string" if digests else ""
    schema += ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for group in codec.batch(batch.column(1).to_pylist()):
                cols = {"doc_id": batch.column(0).slice(at, len(group)).cast(pa.int64())}
                at += len(group)
                if digests or not ids:
                    joined = [",".join([codec.text[w] for w in p]) for p in group]
                    counts = [s.count(",") + 1 if s else 0 for s in joined]
                else:
                    counts = [sum(len(codec.ids[w]) for w in p) for p in group]
                cols["n_tokens"] = pa.array(counts, pa.int64())
                if digests:
                    cols["ids_sha256"] = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in joined])
                    texts = [b"".join([codec.back[w] for w in p]).decode("utf-8", "replace") for p in group]
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
                if ids:
                    flat = [codec.ids[w] for p in group for w in p]
                    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids array<int>); null ids give the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Bpe(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(shared.value, [i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
