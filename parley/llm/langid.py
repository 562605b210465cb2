"""Operator 10: language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text.
A text is parsed against it into phrases, each the longest match with the sample
from where the last one ended. Phrases times the logarithm of the sample's length
is the number of bits that the text costs given that language; the language with
the fewest wins. Many texts are parsed at once: stretches of the texts are lanes
of an array, and all lanes take one step through the automaton together.

Texts are lower-cased, and whatever is not a letter (or a numeral sign like ½) becomes
one blank. They are read whole, in stretches of ``STRETCH`` bytes (a phrase ends with its stretch,
alike for all languages).

Only the fit takes a bounded sample: about ``MAX_DOCS`` documents per language with at
most ``DOC_BYTES`` bytes each, and ``TRAIN_BYTES`` in sum. Every language met there can be predicted. Samples are a stored
table; languages are dealt into groups whose automata fit ``GROUP_BYTES``, and texts pass one group after the other,
carrying the best language so far, so memory does not grow with the number of languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and
so is every text when nothing could be learned; ties go to the first language in
code point order; a row with a null id is predicted, and is neither held out nor
learned from; repeated rows get equal rows; an empty table gives an empty result;
only id, text and (for learning) lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, materialise

MAX_DOCS, DOC_BYTES, TRAIN_BYTES = 300, 1500, 40_000
#: Bytes of the automata that a worker holds at a time.
GROUP_BYTES = 256_000_000
STRETCH = 512
#: Lanes that step together, and bytes of text handled at a time.
LANES, PIECE_BYTES = 16_384, 4_000_000

_not_letters = re.compile(r"[\W\d_]+").sub


def normalise(text: str | None) -> bytes:
    """Lower-cased letters in UTF-8, single blanks for everything else; empty without letters."""
    kept = _not_letters(" ", (text or "").lower()).strip()
    return kept.encode("utf-8", "ignore") if any(map(str.isalpha, kept)) else b""


def suffix_automaton(data: np.ndarray, classes: int) -> np.ndarray:
    """states x classes: the next state, or -1 where the sample does not go on so."""
    blank = [-1] * classes
    go = [blank[:]]
    link, length = [-1], [0]
    last = 0
    for c in data.tolist():
        new = len(go)
        go.append(blank[:]), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and go[p][c] < 0:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # split: the shorter strings of q get a state of their own
                own = len(go)
                go.append(go[q][:]), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and go[p][c] == q:
                    go[p][c] = own
                    p = link[p]
                link[q] = link[new] = own
        last = new
    return np.array(go, np.int32)


@dataclass
class Parser:
    """One language: steps[state * width + class] is the next state, or its complement where a phrase ends."""

    language: str
    steps: np.ndarray
    width: int
    bits: float  # that a phrase costs

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each lane (rows of classes; the last class is padding)."""
        out = np.zeros(len(lanes), np.int32)
        for a in range(0, len(lanes), LANES):
            part = np.ascontiguousarray(lanes[a:a + LANES].T)
            state = np.zeros(part.shape[1], np.int32)
            count = np.zeros(part.shape[1], np.int32)
            for column in part:
                state *= self.width
                state += column
                state = self.steps[state]
                ended = state >> 31  # -1 where a phrase ended
                count -= ended
                state ^= ended
            out[a:a + LANES] = count + (state > 0)
        return out


@dataclass
class Model:
    """Samples of a group of languages, small enough to ship; automata are grown once per worker."""

    samples: dict[str, bytes]

    def parsers(self) -> tuple[list[np.ndarray], list[Parser]]:
        """Classes of the bytes (and of the padding, last) and parser of each language."""
        tables, out = [], []
        for language in sorted(self.samples):
            data = self.samples[language]
            seen = sorted(set(data))
            width = len(seen) + 2
            classes = np.full(257, len(seen), np.int32)  # bytes not seen in the sample: a class without steps
            classes[seen] = np.arange(len(seen))
            classes[256] = width - 1
            go = suffix_automaton(classes[np.frombuffer(data, np.uint8)], width)
            # a byte that the sample lacks is a phrase of its own: a last state that nothing leaves
            restart = np.where(go[0] >= 0, go[0], len(go))  # after a phrase, the byte begins the next one
            go = np.vstack([go, np.full((1, width), -1, np.int32)])
            steps = np.where(go >= 0, go, ~restart[None, :])
            steps[0] = restart
            steps[:, -1] = np.arange(len(go))  # padding
            tables.append(classes.astype(np.uint8 if width < 256 else np.int32))
            out.append(Parser(language, steps.astype(np.int32).ravel(), width, float(np.log2(len(data) + 1))))
        return tables, out


@dataclass
class Languages:
    """Samples of all languages: a table (lang, data), and (lang, bytes of its automaton) in order."""

    table: DataFrame
    sizes: list[tuple[str, int]]

    def groups(self, most: int = GROUP_BYTES) -> Iterator[Model]:
        held: list[str] = []
        total = 0
        for lang, size in [*self.sizes, (None, most + 1)]:
            if held and total + size > most:
                yield Model({r.lang: bytes(r.data) for r in self.table.where(F.col("lang").isin(held)).collect()})
                held, total = [], 0
            held.append(lang)
            total += size


def parse_batch(texts: list[bytes], classes: list[np.ndarray], parsers: list[Parser]) -> np.ndarray:
    """texts x languages: bits that each text costs."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    lanes_of = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), lanes_of)
    first = np.repeat(np.cumsum(sizes) - sizes, lanes_of) + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of))
    ends = np.repeat(np.cumsum(sizes), lanes_of)
    at = first[:, None] + np.arange(STRETCH)[None, :]
    lanes = np.append(raw.astype(np.uint16), 256)[np.where(at < ends[:, None], at, len(raw))]
    return np.stack([np.bincount(owner, p.phrases(c[lanes]), len(texts)) * p.bits for c, p in zip(classes, parsers)], axis=1)


_GROWN: dict[tuple, tuple] = {}


def best_of(texts: list[str | None], model: Model) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language of the fewest bits of each text, those bits, and the sum of 2^(those bits - bits) over the languages;
    None for texts without a letter."""
    key = tuple(sorted((k, hash(v)) for k, v in model.samples.items()))
    if key not in _GROWN:
        _GROWN.clear()
        _GROWN[key] = model.parsers()
    classes, parsers = _GROWN[key]
    names: list[str | None] = [None] * len(texts)
    least, total = np.full(len(texts), np.inf), np.zeros(len(texts))
    group: list[int] = []
    held: list[bytes] = []
    size = 0

    def settle() -> None:
        bits = parse_batch(held, classes, parsers)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(held)), best]
        least[group], total[group] = low, np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(axis=1)
        for i, b in zip(group, best):
            names[i] = parsers[b].language

    for i, t in enumerate(texts if parsers else []):
        b = normalise(t)
        if not b:
            continue
        group.append(i), held.append(b)
        size += len(b)
        if size >= PIECE_BYTES:
            settle()
            group, held, size = [], [], 0
    if held:
        settle()
    return names, least, total


def fit(docs: DataFrame, learn: Column) -> Languages:
    """Samples of each language from labelled documents; ``learn`` says which ids may be learned from."""
    labelled = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy(F.col("lang").alias("l")).agg((F.lit(1_000_000 * MAX_DOCS) / F.count("*") + 1).cast("long").alias("share"))
    order = F.xxhash64(F.lit(10), "doc_id")
    drawn = labelled.join(counts, F.col("lang") == F.col("l")).where(F.pmod(order, F.lit(1_000_000)) < F.col("share"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, lang, text in zip(pdf["key"], pdf["lang"], pdf["text"]):
                data = normalise(text)
                start = int(key) % max(1, len(data) - DOC_BYTES + 1)
                if data:
                    rows.append((key, lang, data[start:start + DOC_BYTES]))
            yield pd.DataFrame(rows, columns=["key", "lang", "data"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        have = b""
        for _, data in sorted(zip(pdf["key"], map(bytes, pdf["data"]))):
            if len(have) < TRAIN_BYTES and data not in have:
                have = (have + b" " + data)[:TRAIN_BYTES] if have else data
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "data": [have], "size": [8 * len(have) * (len(set(have)) + 2)]})

    # about MAX_DOCS pieces a language, equal ones once: a document that is repeated often is one piece
    pieces = drawn.select(order.alias("key"), "lang", "text").mapInPandas(cut, "key long, lang string, data binary").distinct()
    table = materialise(pieces.groupBy("lang").applyInPandas(together, "lang string, data binary, size long"), "languages")
    return Languages(table, [(r.lang, r["size"]) for r in table.select("lang", "size").orderBy("lang").collect()])


def _better(model: Model):
    def better(batch: pd.Series, best: pd.DataFrame) -> pd.DataFrame:
        names, bits, total = best_of(batch.tolist(), model)
        had = best["bits"].fillna(np.inf).to_numpy(float)
        low = np.minimum(had, bits)
        at = np.where(np.isfinite(low), low, 0.0)
        old = best["total"].fillna(0.0).to_numpy(float) * np.exp2(np.clip(at - np.where(np.isfinite(had), had, at), -1000, 0))
        new = total * np.exp2(np.clip(at - np.where(np.isfinite(bits), bits, at), -1000, 0))
        # equal bits stay with the earlier language
        return pd.DataFrame({"lang": [n if b < h else o for n, b, h, o in zip(names, bits, had, best["lang"])],
                             "bits": np.where(np.isfinite(low), low, np.nan), "total": old + new})

    return better


def identify(docs: DataFrame, languages: Languages | Model, parts: int = 5, held: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document. The score is the winner's share of 2^-bits."""
    groups = [languages] if isinstance(languages, Model) else list(languages.groups(group_bytes))
    state = "lang string, bits double, total double"
    d = docs.select("doc_id", "text", F.lit(None).cast(f"struct<{state.replace(' ', ':')}>".replace(",:", ",")).alias("best"))
    for k, model in enumerate(groups):
        d = d.withColumn("best", F.pandas_udf(_better(model), state)("text", "best"))
        if k + 1 < len(groups):
            d = materialise(d, "identified")
    return d.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"),
                    F.coalesce("best.lang", F.lit("und")).alias("lang_pred"), F.coalesce(F.when(F.col("best.lang").isNotNull(), 1 / F.col("best.total")), F.lit(0.0)).alias("score"))
