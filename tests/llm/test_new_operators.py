"""Decontamination, filter audit and conversation repair against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from math import factorial

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import audit, conversations, decontaminate, fmindex, wordhash
from parley.llm.queries import ORACLES
from tests.llm.test_operators import CLASHES, ROWS, make_docs, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate(LOWER))


# ---------------------------------------------------------------- words and index
@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 20])
def test_words_are_cut_alike_in_pieces_of_any_size(piece):
    texts = ["Hello, wörld! A_b x1", None, "", "no--sep漢字 foo", "hello WÖRLD", "x", "x" * 300, "\x00\x7f", "a b"]
    data, offsets = wordhash.buffers(pa.array(texts))
    found = list(wordhash.cut(data, offsets, piece=piece))
    got = [(int(t), bytes(data[a:b]).decode().translate(LOWER), int(h)) for w in found for t, a, b, h in zip(w.text, w.start, w.stop, w.hash)]
    assert [g[:2] for g in got] == [(i, w) for i, t in enumerate(texts) for w in bench_words(t)]
    assert len({g[2] for g in got}) == len({g[1] for g in got})  # equal words have equal hashes, others do not
    heads = defaultdict(set)
    for w in found:
        for at, h in zip(*wordhash.beginnings(data, w, np.arange(len(w.hash)), (2,))[0]):
            heads[bytes(data[w.start[at]:w.stop[at]]).decode().translate(LOWER)[:2]].add(int(h))
    assert all(len(v) == 1 for v in heads.values()) and set(heads) == {w[:2] for t in texts for w in bench_words(t) if len(w) > 2}


def test_index_finds_what_a_scan_finds():
    r = np.random.default_rng(0)
    for _ in range(25):
        texts = [r.integers(0, 4, r.integers(0, 60)) for _ in range(r.integers(1, 8))]
        s = np.concatenate([np.append(t + len(texts), i) for i, t in enumerate(texts)])
        assert [list(s[i:]) for i in fmindex.suffix_order(s, len(texts) + 4)] == sorted(list(s[i:]) for i in range(len(s)))
        index = fmindex.FMIndex.of(fmindex.load(fmindex.store(fmindex.FMIndex.arrays(s, len(texts) + 4))))
        patterns = r.integers(0, 4, (40, 3)) + len(texts)
        got = {(int(k), int(p)) for k, a, b in zip(*index.search(patterns)) for p in index.locate(np.arange(a, b))}
        assert got == {(k, p) for k in range(40) for p in range(len(s) - 2) if (s[p:p + 3] == patterns[k]).all()}


# ---------------------------------------------------------------- 11 decontamination
def brute_hits(docs, items):
    query = defaultdict(set)
    for i, text in items:
        w = bench_words(text)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            query[tuple(w[k:k + 10])].add(i)
    out = []
    for doc_id, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(q) for q in query}:
            for k in range(len(w) - n + 1):
                if (q := tuple(w[k:k + n])) in query:
                    hit.update(range(k, k + n)), found.update(query[q])
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return sorted(out, key=str)


PASSAGE = prose(40, 77)
ITEMS = [(1, PASSAGE), (2, prose(30, 78)), (2, prose(12, 79)), (None, prose(15, 80)), (7, "zebra quagga"), (8, ""), (9, None), (10, PASSAGE), (11, "!!! ..."),
         (12, " ".join(PASSAGE.split()[20:]))]
DOCS = [(i, t) for i, t, *_ in ROWS] + [
    (100, "x " + PASSAGE.upper() + " y"), (101, prose(500, 81) + " " + PASSAGE + " " + prose(500, 82)), (102, "a ZEBRA--quagga b zebra, quagga"), (103, PASSAGE),
    (103, PASSAGE), (104, prose(15, 80)), (None, PASSAGE[:120]), (105, (prose(90, 83) + " " + PASSAGE + " ") * 6), (106, " ".join(PASSAGE.split()[:9])),
    (107, " ".join(PASSAGE.split()[5:15] + PASSAGE.split()[:12]))]


@pytest.mark.parametrize("shard_words, block_pairs", [(1 << 19, 200_000), (64, 200_000), (37, 11)])
def test_hits_equal_a_scan_of_all_windows(spark, shard_words, block_pairs):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit(-1) for c in (*CLASHES, "row", "spans")}).repartition(2)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    found = decontaminate.contamination(docs, bench, shard_words, block_pairs).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest())
                  for r in found), key=str)
    assert got == brute_hits(DOCS, ITEMS)
    assert all(a.stop < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))


def test_spans_are_cut_out_and_clean_texts_stay(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("own_hash", F.lit("x"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontaminate.remove_spans(docs, decontaminate.contamination(docs, bench))
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    got = defaultdict(list)
    for r in clean.collect():
        got[r.doc_id].append(r.text)
    assert got[100] == ["x  y"] and got[102] == ["a  b "] and got[103] == ["", ""] and got[14] == [dict(DOCS)[14]]
    assert all(c[2] == 0 for c in brute_hits([(i, t) for i, v in got.items() for t in v if i != 107], ITEMS))


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS[:3], []), (DOCS[:3], [(1, None)])])
def test_nothing_to_search(spark, docs, items):
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in got)


# ---------------------------------------------------------------- 12 filter audit
def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, text, _, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)}
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                                                    sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_a_run_of_every_order(spark):
    rows = ROWS + [(200 + i, prose(220, 200 + i % 5) + (" #" if i % 3 else "") + " ABCDEF" * (10 * (i % 2)), "en", "ab"[i % 2]) for i in range(20)]
    labels = [(r[0], k % 2, k // 2 % 2) for k, r in enumerate(rows)] + [(1, 1, None), (999, 1, 1), (None, 1, 1)]
    docs = make_docs(spark, rows).withColumns({c: F.lit(-1) for c in (*CLASHES, "part", "mask", "good", "h1")})
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for *_, s in rows})


def test_least_squares_gives_shapley_values():
    r = np.random.default_rng(4)
    for n in (2, 3, 5):
        v = [Fraction(0), *[Fraction(int(x)) for x in r.integers(-50, 50, 2 ** n - 1)]]
        plain = [sum(v[(m := sum(1 << j for j in p[:p.index(i) + 1]))] - v[m & ~(1 << i)] for p in itertools.permutations(range(n))) / factorial(n) for i in range(n)]
        assert [sum(w * x for w, x in zip(row, v)) for row in audit.shapley_weights(n)] == plain


def test_audit_of_an_empty_table(spark):
    assert audit.audit(make_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# ---------------------------------------------------------------- 13 conversation repair
def brute_repair(turns):
    """Cheapest, ASCII-least audit by a walk over the grammar's states, all audits kept as strings."""
    def insert(best):
        for _ in range(3):
            for a, b in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if a in best and (new := (best[a][0] + 2, best[a][1] + "I")) < best.get(b, (1e9, "")):
                    best[b] = new
        return best

    best = insert({0: (0, "")})
    for x, bad, cut in turns:
        new = {s: (c + 3, a + "D") for s, (c, a) in best.items()}
        for letter, a, b in () if bad else (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("a", 2, 3), ("u", 3, 2)):
            if a in best and (x == letter or letter != "s"):
                way = (best[a][0] + cut + 2 * (x != letter), best[a][1] + ("K" if x == letter else "R"))
                new[b] = min(new.get(b, (1e9, "")), way)
        best = insert(new)
    return min(best[s] for s in (0, 3) if s in best)


def test_alignment_equals_brute_force_whole_and_in_pieces():
    r = np.random.default_rng(6)
    for _ in range(600):
        n = int(r.choice([1, 2, 3, 5, 8, 12, 40]))
        turns = [(x, bool(b), bool(c) and not b) for x, b, c in zip(r.choice(list("suuaaax"), n), r.random(n) < 0.2, r.random(n) < 0.2)]
        want = brute_repair(turns)
        assert min(conversations.transfers(turns, (0,), (0, 3)).values()) == want
        size, joined = int(r.integers(1, 6)), None
        for i in range(0, n, size):
            piece = conversations.transfers(turns[i:i + size], (0, 1, 2, 3), (0, 1, 2, 3))
            joined = piece if joined is None else conversations.join_pieces(joined, piece)
        assert min(f for (a, b), f in joined.items() if a == 0 and b in (0, 3)) == want


def brute_conversations(rows):
    out, ids = [], {r[0] for r in rows}
    for conv in ids:
        after = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            after += [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
        after.sort()
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in after:
            w = WORD.findall(text)
            fault = "blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1][-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        known = {t for k, t, *_ in after if k}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits = brute_repair(turns) if turns else (0, "")
        lines, said = [], iter(after)
        odd, place = len(edits.replace("D", "")) % 2, 0
        for e in edits:
            row = next(said) if e != "I" else None
            if e != "D":
                role = ("user", "assistant")[(place - odd) % 2]
                lines.append(f"{row[2] if e == 'K' else role}:{row[3] if row else ''}")
                place += 1
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(conv, n, seed):
    r = np.random.default_rng(seed)
    roles = ["system"] * (seed % 3 == 0) + ["user", "assistant"] * n
    return [(conv, int(k + (r.random() < 0.05)), str(role if r.random() > 0.1 else r.choice(["user", "assistant", "tool", "system"])),
             f"{'same' if r.random() < 0.1 else prose(4, seed * 100 + k)}{r.choice(['.', '!', '?', '', ' ', '. ]'])}") for k, role in enumerate(roles[:n])]


TALKS = [row for c in range(60) for row in talk(c, 1 + c % 9, c)] + talk(1000, 400, 1000) + [
    (None, 0, "user", "a."), (None, 1, "assistant", "b."), (2000, None, "user", "x"), (2000, None, None, None), (2000, 5, "", "y."), (2000, 5, "user", "z."),
    (2001, 3, "user", None), (2002, 7, "user", " \n\t"), *[(2003, 4, "user", "again.")] * 30, (2004, 0, "user", prose(20_000, 9) + ".")]


@pytest.mark.parametrize("piece", [conversations.PIECE, 7])
def test_repair_equals_brute_force(spark, piece):
    rows = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(-1) for c in ("kind", "n", "audit", "copy", "k", "h1")})
    got = conversations.repair(conversations.damage(rows), rows, piece)
    want = brute_conversations(TALKS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    grammar = re.compile("(s?(ua)+)?")
    faults = conversations.materialise(conversations.faults(conversations.damage(rows)), "faults")
    told = defaultdict(list)
    for r in conversations.repaired_turns(faults, conversations.audits(faults)).collect():
        told[r.conv_id].append((r.place, r.role, r.text))
    for conv, *_, digest in want:
        mine = sorted(told[conv])
        assert grammar.fullmatch("".join(role[:1] for _, role, _ in mine))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in mine).encode()).hexdigest() == digest


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(none), none).count() == 0


def test_repair_twin_agrees_with_brute_force():
    con = duckdb.connect()
    rows = pa.table({k: [r[i] for r in TALKS] for i, k in enumerate(("conv_id", "turn", "role", "text"))})
    con.register("conversations", rows)
    assert sorted(con.execute(ORACLES["op13_conversation_repair"]).fetchall(), key=str) == brute_conversations(TALKS)
