"""Operator 7: toxicity by the nearest labelled examples.

Terms are words and beginnings of words, as 64-bit hashes. The vocabulary holds each term
that enough of the examples have (one in a hundred), whatever their labels: a term of one
or two examples is near nothing. Document frequencies are counted over all
documents. A term weighs its count times its inverse document frequency, to the power (``IDF_POWERS``)
under which the examples tell each other's labels best. Examples are unit vectors in an inverted index, cut into blocks of examples, with the largest
weight of each term in each block. Terms that many examples have stand in a dense table, the
others in posting lists. The lists are added up first; a block whose upper bound
cannot beat the k-th best cosine is then left out, so the k nearest are exact. Their votes,
weighted by cosine, and the cosines of the nearest of either label are all that a
logistic curve turns into the probability; it is fitted on the examples, each left out of
its own vote. The ids and cosines of the neighbours are returned as evidence.

The texts are cut into words once: the vocabulary's terms in each document are stored, and
frequencies, votes and scores read those. Votes of the examples are taken by tasks; the
driver holds the index (at most ``MAX_ENTRIES`` weights) and a few numbers per example.

Only the fit takes a bounded sample (``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled
documents, fewer if they have more than ``MAX_ENTRIES`` terms in sum); all documents count for
the frequencies, and all are scored.

Defined results: a null or empty text, or one without any term of the vocabulary, has no
neighbours and gets the rate of label 1 among such examples; ties between equal
cosines go to the earlier example in the index; repeated rows get equal scores; rows
with a null id are scored, and are neither held out nor learned from; with no
usable label the score is 0.5 without evidence; long texts count whole; an empty
table gives an empty result; only id and text are read of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import wordhash
from parley.llm.common import fold, labelled_ids, labelled_texts, materialise

MAX_POSITIVE, MAX_NEGATIVE, MAX_ENTRIES = 2_500, 5_000, 8_000_000
#: Beginnings of words, in letters, that are terms besides the words; a term stands in at least one in so many examples.
PREFIXES = (4, 5, 6)
MIN_SHARE, MIN_EXAMPLES = 100, 2
IDF_POWERS = (1, 2, 3)
#: Neighbours that vote, examples to a block, blocks taken first (then the others).
NEIGHBOURS, BLOCK, ROUND = 25, 32, 8
#: A term is in the dense table if at least one in so many examples has it; queries searched together.
DENSE, QUERIES = 16, 64
#: Room for rounding in single precision; what comes within it is compared in double precision.
ROUNDING = 1e-5
#: Closer cosines than this may change places by the rounding of the dense table's weights.
CLOSE = 1e-6
THRESHOLD = 0.7


def term_counts(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, count), sorted by text and term. With ``known`` (sorted hashes), terms are places there and others are left out.

    The terms of a word are looked up once for each piece of text."""
    data, offsets = wordhash.buffers(pc.utf8_lower(texts))
    out = []
    for w in wordhash.cut(data, offsets):
        own, which = np.unique(w.hash, return_inverse=True)
        first = np.empty(len(own), np.int64)
        first[which] = np.arange(len(which))  # a place where the word stands
        terms = np.zeros((len(own), 1 + len(PREFIXES)), np.uint64)
        terms[:, 0] = own
        there = terms > 0
        there[:, 0] = True
        for k, (at, h) in enumerate(wordhash.beginnings(data, w, first, PREFIXES), 1):
            terms[at, k], there[at, k] = h, True
        if known is None:
            known_terms, term = np.unique(terms[there], return_inverse=True)
        else:
            at = np.searchsorted(known, terms)
            there &= known[np.minimum(at, len(known) - 1)] == terms if len(known) else False
            known_terms, term = known, at[there]
        number = np.zeros(terms.shape, np.int64)
        number[there] = term
        width = max(len(known_terms), 1)
        key = (w.text[:, None] * width + number[which])[there[which]]
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        text, term = np.divmod(key[start], width)
        new = text, known_terms[term] if known is None else term, np.diff(np.append(start, len(key)))
        if out and len(text) and len(out[-1][0]) and out[-1][0][-1] == text[0]:  # a text that began in the piece before
            a, b = np.searchsorted(out[-1][0], text[0]), np.searchsorted(text, text[0], side="right")
            seam = counted(*[np.concatenate([x[a:], y[:b]]) for x, y in zip(out[-1], new)])
            out[-1] = tuple(x[:a] for x in out[-1])
            new = tuple(np.concatenate([x, y[b:]]) for x, y in zip(seam, new))
        out.append(new)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def counted(text: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``n`` by (text, term), in their order."""
    by = np.lexsort((term, text))
    text, term = text[by], term[by]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])]))
    return text[first], term[first], np.add.reduceat(n[by], first)


def unit(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1."""
    w = counts * idf[ids]
    return w / np.sqrt((w ** 2).sum()) if len(w) else w


Vector = tuple[np.ndarray, np.ndarray]


def spans(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows`` in lists that begin at ``start``, and the length of each row."""
    n = start[rows + 1] - start[rows]
    return np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass
class BlockMaxIndex:
    """Examples by row; from them, on first use, the dense table, its largest weights per block, and the posting lists."""

    n: int
    terms: int
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    built: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    @classmethod
    def of(cls, vectors: list[Vector], terms: int) -> BlockMaxIndex:
        start = np.concatenate([[0], np.cumsum([len(v[0]) for v in vectors])]).astype(np.int64)
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0)]).astype(np.int32)
        return cls(len(vectors), terms, start, term, np.concatenate([v[1] for v in vectors] or [np.zeros(0)]))

    def tables(self) -> tuple:
        if self.built is None:
            blocks = -(-self.n // BLOCK)
            who = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.start))
            common = np.flatnonzero(DENSE * np.bincount(self.term, minlength=self.terms) >= max(self.n, 1))
            column = np.full(self.terms, -1, np.int32)
            column[common] = np.arange(len(common))
            dense = np.zeros((blocks * BLOCK, len(common)), np.float32)
            at = column[self.term] >= 0
            dense[who[at], column[self.term[at]]] = self.weight[at]
            top = dense.reshape(blocks, BLOCK, -1).max(axis=1)
            term, who, weight = self.term[~at], who[~at], self.weight[~at]
            order = np.argsort(term, kind="stable")
            start = np.searchsorted(term[order], np.arange(self.terms + 1))
            self.built = column, dense, top, start, who[order].astype(np.int64), weight[order], np.zeros(self.terms)
        return self.built

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> Vector:
        """The k examples of the highest cosine (above 0), and their cosines."""
        return self.nearest_of([(ids, weights)], k, [skip])[0]

    def nearest_of(self, queries: list[Vector], k: int, skip: list[int] | None = None) -> list[Vector]:
        """The same of each query; ``skip`` has an example that a query does not meet, or -1."""
        out: list[Vector] = []
        for a in range(0, len(queries), QUERIES):
            out += self._search(queries[a:a + QUERIES], k, (skip or [-1] * len(queries))[a:a + QUERIES])
        return out

    def _search(self, queries: list[Vector], k: int, skip: list[int]) -> list[Vector]:
        none = np.zeros(0, np.int64), np.zeros(0)
        if not self.n:
            return [none] * len(queries)
        column, dense, top, start, who, weight, _ = self.tables()
        q, size = np.zeros((len(queries), dense.shape[1])), len(dense)
        rare = np.zeros((len(queries), size))
        for i, (ids, w) in enumerate(queries):
            c = column[ids]
            q[i, c[c >= 0]] = w[c >= 0]
            t = ids[c < 0]
            lists = list(zip(start[t].tolist(), start[t + 1].tolist()))
            if lists:
                rare[i] = np.bincount(np.concatenate([who[a:b] for a, b in lists]), np.repeat(w[c < 0], start[t + 1] - start[t]) * np.concatenate([weight[a:b] for a, b in lists]), size)
            if skip[i] >= 0:
                rare[i, skip[i]] = -np.inf
        score, narrow = rare.astype(np.float32), q.astype(np.float32)
        # all weights are above 0, so what is added up so far is a lower bound of each cosine
        bound = narrow @ top.T + score.reshape(len(queries), -1, BLOCK).max(axis=2)
        order = np.argsort(-bound.sum(axis=0), kind="stable")
        for blocks in (order[:ROUND], order[ROUND:]):
            beaten = self._kth(score, k) - ROUNDING
            for b in blocks:
                rows = np.flatnonzero(bound[:, b] >= beaten)
                if len(rows):
                    part = slice(None) if len(rows) == len(q) else rows
                    score[part, b * BLOCK:(b + 1) * BLOCK] += narrow[part] @ dense[b * BLOCK:(b + 1) * BLOCK].T
        least = np.maximum(self._kth(score, k) - ROUNDING, 0)
        return [self._nearest(v, np.flatnonzero((s >= m) & (s > 0)), k, r, x) for v, s, m, r, x in zip(queries, score, least, rare, q)]

    def _nearest(self, query: Vector, who: np.ndarray, k: int, rare: np.ndarray, q: np.ndarray) -> Vector:
        """The k nearest of the examples ``who``: sums in double precision of the stored weights, and of the weights
        themselves where the k-th place is too close to call."""
        cos = rare[who] + self.tables()[1][who] @ q
        first = np.lexsort((who, -cos))
        if len(who) > k and cos[first[k - 1]] - cos[first[k]] < CLOSE:
            return self._exact(query, who, k)
        return who[first[:k]], np.minimum(cos[first[:k]], 1.0)

    @staticmethod
    def _kth(score: np.ndarray, k: int) -> np.ndarray:
        return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.zeros(len(score), np.float32)

    def _exact(self, query: Vector, who: np.ndarray, k: int) -> Vector:
        """The k nearest of the examples ``who``, in double precision."""
        wide = self.tables()[-1]
        wide[query[0]] = query[1]
        at, n = spans(self.start, who)
        cos = np.bincount(np.repeat(np.arange(len(who)), n), wide[self.term[at]] * self.weight[at], len(who))
        wide[query[0]] = 0
        first = np.lexsort((who, -cos))[:k]
        return who[first], np.minimum(cos[first], 1.0)


def features(label: np.ndarray, mass: np.ndarray, cos: np.ndarray) -> list[float]:
    """Vote of the neighbours, and how near the nearest of either label are."""
    w = cos * mass
    vote = float((w * label).sum() / w.sum())
    near1, near0 = float((cos * label).max()), float((cos * (1 - label)).max())
    return [vote, near1, near0, vote * near1]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (constant first) by Newton's method; a step is halved until the loss falls."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.01] + [1.0] * (x.shape[1] - 1))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + b @ keep @ b / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(b))
        step, now = np.linalg.solve(h, g), loss(b)
        while loss(b - step) > now and abs(step).max() > 1e-9:
            step = step / 2
        b = b - step
        if abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    power: int
    idf: np.ndarray  # to that power
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    mass: np.ndarray  # how many labelled documents an example stands for
    curve: np.ndarray
    without: float  # score of texts without any term of the vocabulary
    counts: DataFrame | None = None  # stored terms of the documents that were counted

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def scores(self, found: list[Vector]) -> list[tuple[float, list[int], list[float]]]:
        """Score, evidence and its cosines of each (terms, counts)."""
        out = []
        for a in range(0, len(found), QUERIES):
            part = found[a:a + QUERIES]
            for who, cos in self.index.nearest_of([(ids, unit(ids, n, self.idf)) for ids, n in part], NEIGHBOURS):
                if not len(who):
                    out.append((self.without, [], []))
                    continue
                f = features(self.labels[who], self.mass[who], cos)
                p = 1 / (1 + np.exp(-np.clip(self.curve[0] + np.dot(self.curve[1:], f), -30, 30)))
                out.append((float(p), self.ids[who].tolist(), cos.round(6).tolist()))
        return out


def vocabulary_of(sample: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of the terms that at least so many examples have: no more than their mean number of terms / share."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, term, _ = term_counts(batch.column(0))
            term, n = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

    often = sample.select("text").mapInArrow(terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(often.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


def with_counts(docs: DataFrame, terms: Broadcast, *keep: str) -> DataFrame:
    """The columns ``keep``, and the vocabulary's terms and counts in each text, packed."""
    kept = docs.select(*keep, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, term, n = term_counts(batch.column(len(keep)), terms.value)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            pairs = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([packed(v[a:b]) for a, b in pairs], pa.binary()) for v in (term, n)]], [*keep, "ids", "counts"])

    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(count, f"{schema}, ids binary, counts binary")


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the first byte says how many."""
    size = 1 if not len(v) or v.max() < 1 << 8 else 2 if v.max() < 1 << 16 else 4
    return bytes([size]) + v.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def vectors(batch: pa.RecordBatch) -> list[Vector]:
    return [(unpacked(i), unpacked(n).astype(float)) for i, n in zip(batch["ids"].to_pylist(), batch["counts"].to_pylist())]


def document_frequencies(counts: DataFrame, terms: int) -> np.ndarray:
    """Over all documents: how many have each term, and (last) how many there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 1, np.int64)
        for batch in batches:
            ids = batch["ids"].to_pylist()
            total[:-1] += np.bincount(np.concatenate([unpacked(i) for i in ids] or [np.zeros(0, np.int64)]), minlength=terms)
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(terms + 1)
    found = counts.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def left_out(examples: DataFrame, model: Broadcast) -> pd.DataFrame:
    """Features of each example, without its own vote; none for those without neighbours."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            places = batch["place"].to_numpy()
            near = m.index.nearest_of([(ids, unit(ids, n, m.idf)) for ids, n in vectors(batch)], NEIGHBOURS, places.tolist())
            rows = [(int(p), features(m.labels[who], m.mass[who], cos)) for p, (who, cos) in zip(places, near) if len(who)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["place", "features"])

    return examples.select("place", "ids", "counts").mapInArrow(vote, "place long, features array<double>").toPandas().sort_values("place")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Model:
    """Examples, index and curve from a bounded sample of labelled documents."""
    spark = docs.sparkSession
    share_of = dict(labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect())
    drawn = [labelled_ids(labels.where(F.col(label) == v), label, learn, most, salt=7 + v)
             for v, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    sample = labelled_texts(docs, drawn[0].unionByName(drawn[1])).withColumn("h", F.xxhash64("text"))
    # one of each text and label, the one of the least id
    sample = materialise(sample.groupBy("h", "label").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("r")).select("r.doc_id", "r.text", "label"), "examples")
    terms = vocabulary_of(sample, max(MIN_EXAMPLES, -(-sample.count() // MIN_SHARE)))
    shared = spark.sparkContext.broadcast(terms)
    examples = materialise(with_counts(sample, shared, "doc_id", "label"), "example_terms")
    counts = materialise(with_counts(docs, shared, "doc_id"), "document_terms")
    total = document_frequencies(counts, len(terms))
    shared.unpersist()
    idf = np.log((total[-1] + 1) / (total[:-1] + 1)) + 0.01
    entries = examples.agg(F.sum(F.octet_length("ids"))).first()[0] or 0  # no more terms than bytes
    if entries > MAX_ENTRIES:
        draw = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(1_000_000))
        examples = examples.where(draw < int(1_000_000 * MAX_ENTRIES / entries))
    table = examples.toArrow().to_pandas().sort_values(["doc_id", "label"], ignore_index=True)
    size = table["ids"].map(len).to_numpy() - 1 if len(table) else np.zeros(0, int)
    y_all = table["label"].to_numpy(float)
    mass_of = {v: share_of.get(v, 0) / max(1, int((y_all == v).sum())) for v in (0, 1)}
    n1, n0 = (mass_of[v] * int(((size == 0) & (y_all == v)).sum()) for v in (1, 0))
    without = (n1 + 0.5 * (not len(table))) / (n1 + n0 + 1) if len(table) else 0.5
    full = table[size > 0].reset_index(drop=True)
    found = [(unpacked(i), unpacked(n).astype(float)) for i, n in zip(full["ids"], full["counts"])]
    y = full["label"].to_numpy(float)
    mass = np.array([mass_of[int(v)] for v in y])
    best: tuple[float, Model] | None = None
    for power in IDF_POWERS if len(full) else IDF_POWERS[:1]:
        weight = idf ** power
        vec = [(ids, unit(ids, n, weight)) for ids, n in found]
        # examples with the same strongest term stand together, which sharpens the bounds of their blocks
        order = sorted(range(len(vec)), key=lambda i: (int(vec[i][0][vec[i][1].argmax()]), i))
        model = Model(terms, power, weight, BlockMaxIndex.of([vec[i] for i in order], len(terms)), full["doc_id"].to_numpy()[order], y[order], mass[order], np.zeros(5), float(without), counts)
        loss = 0.0
        if len(full):
            placed = spark.createDataFrame(pd.DataFrame({"example_id": model.ids, "example_label": model.labels, "place": np.arange(len(order))}))
            mine = examples.join(F.broadcast(placed), (F.col("doc_id") == F.col("example_id")) & (F.col("label") == F.col("example_label")))
            votes = left_out(mine, shared := spark.sparkContext.broadcast(model))
            shared.unpersist()
            if len(votes):
                at, x = votes["place"].to_numpy(), np.stack(votes["features"])
                model.curve = fit_logistic(x, model.labels[at], model.mass[at])
                z = model.curve[0] + x @ model.curve[1:]
                loss = float((model.mass[at] * (np.logaddexp(0, z) - model.labels[at] * z)).sum() / model.mass[at].sum())
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def score_documents(docs: DataFrame, model: Model, parts: int = 3, held: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence_ids, evidence_cosines) of every document.

    ``counts`` are the stored terms of ``docs`` where the model was fitted on the same documents (``model.counts``)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MAX_ENTRIES weights
    kind = docs.schema["doc_id"].dataType.simpleString()
    if counts is None:
        counts = with_counts(docs, spark.sparkContext.broadcast(model.terms), "doc_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.scores(vectors(batch))
            score, ids, cosines = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                                             ["doc_id", "score", "evidence_ids", "evidence_cosines"])

    d = counts.select("doc_id", "ids", "counts").mapInArrow(scored, f"doc_id {kind}, score double, evidence_ids array<long>, evidence_cosines array<double>")
    return d.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")
