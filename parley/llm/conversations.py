"""Operator 13: repair of conversations by alignment to an alternating grammar.

A conversation should read ``(system)? (user assistant)+``, or be empty. Its turns are
aligned to the grammar's strings of every feasible length by Wagner and Fischer's table
(keep, rerole, delete, insert). Strings of all lengths agree when read from their ends,
so one table over what is left of turns and string serves all lengths that end alike. A
narrow band around the diagonal gives a first cost; Ukkonen's band of this incumbent
holds every alignment that is as cheap. The audits of all lengths of the least cost are
traced back, letter by letter the least in ASCII that stays cheapest, and compared.

Rows are dealt over tasks by ranges of (conversation, turn), so a conversation that
holds a large part of the table goes to many tasks. They align pieces of at most
``PIECE`` rows: for each state of the grammar before the piece and after it, the cheapest
audit. Pieces join in order, state by state (audits of equal cost consume the same rows,
so neither begins the other, and the least one stays least). Faults are counted before rows
are dealt; equal rows of a turn count as one row with a number. Only the text of one
batch, and a conversation's audit, stand in memory when the repaired text is read off.

Defined results: null roles and texts count as one blank; turns that are null come first;
rows of one turn are taken by role and text, equal rows next to each other; a null
conversation id is a conversation of its own; blank and repeated turns must go; long texts
are read whole; a conversation without rows has zeros, an empty audit and the hash of an
empty text; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WORD, join_same, materialise

PIECE = 1024
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: Half-width of the first band, in cost.
NARROW = 8
ROLES = {"u": "user", "a": "assistant"}
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)

#: (initial of the role, whether it must go, whether it is cut off)
Turn = tuple[str, bool, bool]
Found = tuple[int, str]


class Table:
    """Least costs of turning the last r turns into the last k letters of the alternating string that ends with ``end``,
    within the band of cells that cost at most ``limit``."""

    def __init__(self, turns: list[Turn], end: str, limit: int):
        self.turns, self.limit = turns, limit
        self.letters = ("u" if end == "a" else "a", end)  # by the number of letters left, even or odd
        fewer, more = limit // DELETE, limit // INSERT
        self.rows: list[tuple[int, list[float]]] = [(0, [INSERT * k for k in range(more + 1)])]
        for r in range(1, len(turns) + 1):
            initial, bad, cut_off = turns[-r]
            below, under = self.rows[-1]
            lo, out = max(0, r - fewer), []
            before = float("inf")
            for k in range(lo, r + more + 1):
                i = k - below
                cost = under[i] + DELETE if i < len(under) else float("inf")
                if k and not bad and i > 0:
                    cost = min(cost, under[i - 1] + cut_off * CUT_OFF + (0 if initial == self.letters[k & 1] else REROLE))
                before = min(cost, before + INSERT)
                out.append(before)
            self.rows.append((lo, out))

    def cost(self, r: int, k: int) -> float:
        lo, row = self.rows[r]
        return row[k - lo] if 0 <= k - lo < len(row) else float("inf")

    def lengths(self, r: int, odd: int) -> range:
        lo, row = self.rows[r]
        return range(lo + (lo & 1 != odd), lo + len(row), 2)

    def audit(self, r: int, k: int) -> str:
        """The least audit of the least cost."""
        out = []
        while r or k:
            cost = self.cost(r, k)
            if r and self.cost(r - 1, k) + DELETE == cost:
                out.append("D")
                r -= 1
            elif k and self.cost(r, k - 1) + INSERT == cost:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.turns[-r][0] == self.letters[k & 1] else "R")
                r, k = r - 1, k - 1
        return "".join(out)


def align(turns: list[Turn], entry: int, exit_: int, tables: dict[str, Table]) -> Found | None:
    """Cheapest cost and least audit from one state of the grammar to another, within the tables' band."""
    n = len(turns)
    if exit_ in (START, SYSTEM):  # one letter at most: the last system turn of the least cost, or nothing
        if entry == exit_:
            return DELETE * n, "D" * n
        kept = [(DELETE * (n - 1) + cut_off * CUT_OFF, "D" * i + "K" + "D" * (n - 1 - i)) for i, (initial, bad, cut_off) in enumerate(turns) if initial == "s" and not bad]
        return min(kept, default=None) if (entry, exit_) == (START, SYSTEM) else None
    odd = int((exit_ == USER) != (entry == USER))  # letters from what the entry expects to what the exit ends with
    t = tables[exit_]
    ways = [(t.cost(n, k), -1, n, k) for k in t.lengths(n, odd) if k or entry == exit_]  # cost, deleted turns before a system turn (or -1), turns and letters left
    if entry == START:
        for i, (initial, bad, cut_off) in enumerate(turns):
            if DELETE * i > t.limit:
                break
            if initial == "s" and not bad:
                head, left = DELETE * i + cut_off * CUT_OFF, n - i - 1
                ways += [(head + t.cost(left, k), i, left, k) for k in t.lengths(left, odd) if k]
    least = min((w[0] for w in ways), default=float("inf"))
    if least == float("inf"):
        return None
    audits = [("" if i < 0 else "D" * i + "K") + t.audit(left, k) for cost, i, left, k in ways if cost == least]
    return int(least), min(audits)


def transfers(turns: list[Turn], entries: tuple[int, ...], exits: tuple[int, ...]) -> dict[tuple[int, int], Found]:
    """The cheapest audit of each pair of states before and after the turns."""
    limit = NARROW + DELETE * sum(bad for _, bad, _ in turns)
    ends = [b for b in exits if b in (USER, ASSISTANT)]
    while True:
        tables = {b: Table(turns, "u" if b == USER else "a", limit) for b in ends}
        out = {(a, b): f for a in entries for b in exits if (f := align(turns, a, b, tables))}
        known = [out[a, b][0] for a in entries for b in ends if (a, b) in out]
        incumbent = max(known, default=0) if len(known) == len(entries) * len(ends) else 2 * limit
        if incumbent <= limit:
            return out
        limit = incumbent


def join_pieces(first: dict[tuple[int, int], Found], then: dict[tuple[int, int], Found]) -> dict[tuple[int, int], Found]:
    out: dict[tuple[int, int], Found] = {}
    for (a, b), (cost, audit) in first.items():
        for (c, d), (more, rest) in then.items():
            if b == c:
                new = (cost + more, audit + rest)
                if (a, d) not in out or new < out[a, d]:
                    out[a, d] = new
    return out


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_NONE = object()
PIECES = "conv_id {id}, part int, first string, last string, illegal bigint, moves array<struct<entry:int,exit:int,cost:bigint,audit:string>>"


def _pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """One row per conversation and task: its pieces joined."""
    part, kind = TaskContext.get().partitionId(), None
    held: list = []  # the conversation so far: id, first and last initial, illegal pairs, moves, whether the task begins with it
    turns: list[Turn] = []

    def settle(all_states: bool, last: bool) -> None:
        nonlocal turns
        if turns:
            entries, exits = (START, SYSTEM, USER, ASSISTANT), (START, SYSTEM, USER, ASSISTANT)
            if not all_states:
                entries = (START,) if held[4] is None else entries
                exits = (START, ASSISTANT) if last else exits
            moves = transfers(turns, entries, exits)
            held[4] = moves if held[4] is None else join_pieces(held[4], moves)
            turns = []

    def row() -> pa.RecordBatch:
        moves = [{"entry": a, "exit": b, "cost": c, "audit": s} for (a, b), (c, s) in held[4].items()]
        return pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([part], pa.int32()), *[pa.array([held[i]]) for i in (1, 2)],
                                           pa.array([held[3]], pa.int64()), pa.array([moves], pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))],
                                          ["conv_id", "part", "first", "last", "illegal", "moves"])

    begins = True  # the first conversation of a task may have begun in the one before
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, initial, gone, cut_off, n in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0] != conv:
                settle(begins, True)
                yield row()
                held, begins = [], False
            if not held:
                held = [conv, initial, None, 0, None]
            for i in range(n):
                if held[2] is not None and not legal(held[2], initial):
                    held[3] += 1
                held[2] = initial
                turns.append((initial, gone or i > 0, cut_off and not gone and not i))
                if len(turns) == piece:
                    settle(begins, False)
    if held:
        settle(True, False)  # it may go on in the next task
        yield row()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit of each conversation from its rows of all tasks, in order."""
    held: list = []

    def row(kind) -> pa.RecordBatch:
        cost, audit = min(f for (a, b), f in held[3].items() if a == START and b in (START, ASSISTANT))
        return pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([held[2]], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit])],
                                          ["conv_id", "illegal", "cost", "audit"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, _, first, last, illegal, moves in zip(*[c.to_pylist() for c in batch.columns]):
            moves = {(m["entry"], m["exit"]): (m["cost"], m["audit"]) for m in moves}
            if held and held[0] == conv:
                held[2] += illegal + (not legal(held[1], first))
                held[1], held[3] = last, join_pieces(held[3], moves)
                continue
            if held:
                yield row(kind)
            held = [conv, last, illegal, moves]
    if held:
        yield row(kind)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, from an audit and the (role, text) rows in order."""
    odd = (len(audit) - audit.count("D")) & 1
    place = 0

    def role() -> str:
        return ROLES["ua"[(place - odd) & 1]]

    for edit in audit:
        if edit == "I":
            yield edit, role(), ""
        else:
            own, text = next(rows)
            if edit == "D":
                continue
            yield edit, own if edit == "K" else role(), text
        place += 1


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(id, illegal, cost, audit, iterator over its (role, text) rows) of conversations whose first row has the audit."""
    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        conv, _, illegal, cost, audit = ahead[:5]

        def turns():
            nonlocal ahead
            while (ahead := next(source, None)) is not None and ahead[1]:
                for _ in range(ahead[7]):
                    yield ahead[5], ahead[6]

        mine = turns()
        yield conv, illegal, cost, audit, mine
        for _ in mine:
            pass


def ordered(df: DataFrame, *first: str) -> DataFrame:
    return df.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*first, "turn", "role", "text")])


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, blank, gone, cut_off): equal rows with their number; whether the first of them
    must go, or is cut off. Later ones repeat it."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = materialise(t.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("n")), "turns")
    same = ["conv_id", "role", "h1", "h2", "size"]
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(13), "text"), "size": F.length("text"),
                             "place": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))})
    earliest = rows.groupBy(*same).agg(F.min("place").alias("earliest"), F.count("*").alias("times")).where("times > 1").drop("times")
    rows = join_same(rows, materialise(earliest, "earliest"), same)  # stored, so that Spark can split hot texts
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    blank = ~F.col("text").rlike(WORD)
    repeated = F.coalesce(F.col("place") > F.col("earliest"), F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", "n", blank.alias("blank"), (blank | repeated).alias("gone"),
                       (~blank & ~repeated & ~last.isin(".", "!", "?")).alias("cut_off"))


def audits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation in the rows of ``faults``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")])
    narrow = ordered(dealt, "conv_id").select("conv_id", F.substring("role", 1, 1).alias("initial"), "gone", "cut_off", "n")
    pieces = narrow.mapInArrow(partial(_pieces, piece=piece), PIECES.format(id=kind))
    together = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return together.mapInArrow(_join, f"conv_id {kind}, illegal bigint, cost bigint, audit string")


def with_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after one that carries its audit."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    head = found.select("conv_id", F.lit(0).alias("kind"), "illegal", "cost", "audit", none("role", "string"), none("text", "string"),
                        F.lit(0).alias("n"), none("turn", rows.schema["turn"].dataType))
    body = rows.select("conv_id", F.lit(1).alias("kind"), none("illegal", "bigint"), none("cost", "bigint"), none("audit", "string"), "role", "text", "n", "turn")
    return ordered(head.unionByName(body).repartition("conv_id"), "conv_id", "kind").drop("turn")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each repaired conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                id_type[:] = [b.schema.field(0).type]
                yield b

        for conv, _, _, audit, turns in _conversations(typed()):
            held: list = []
            for place, (edit, role, text) in enumerate(edited(audit, turns)):
                held.append((conv, place, edit, role, text))
                if len(held) == PIECE:
                    yield batch_of(held, id_type[0])
                    held = []
            if held:
                yield batch_of(held, id_type[0])

    def batch_of(held: list, id_type) -> pa.RecordBatch:
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                          ["conv_id", "place", "edit", "role", "text"])

    return with_turns(rows, found).mapInArrow(read_off, f"conv_id {kind}, place bigint, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, repaired_sha256): the repaired ``role:text`` lines of each conversation, hashed as they pass."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_rows, id_type in _grouped(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch_rows), (id_type, pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    def _grouped(batches: Iterator[pa.RecordBatch]):
        id_type, held = [], []

        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                id_type[:] = [b.schema.field(0).type]
                yield b

        for conv, illegal, cost, audit, turns in _conversations(typed()):
            h, between = hashlib.sha256(), b""
            for _, role, text in edited(audit, turns):
                h.update(between + f"{role}:{text}".encode())
                between = b"\n"
            held.append((conv, illegal, cost, audit, h.hexdigest()))
            if len(held) == PIECE:
                yield held, id_type[0]
                held = []
        if held:
            yield held, id_type[0]

    return with_turns(rows, found).mapInArrow(hashed, f"conv_id {kind}, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation
    of ``turns`` (conv_id, turn, role, text), and of the ids in ``conversations`` that have no turn."""
    rows = materialise(faults(turns), "faults")
    n, first = F.col("n").cast("long"), (~F.col("gone")).cast("long")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), F.sum(F.when(F.col("blank"), n).otherwise(F.lit(0))).alias("blank"),
        F.sum(F.when(~F.col("blank"), n - first).otherwise(F.lit(0))).alias("duplicate"), F.sum(F.col("cut_off").cast("long")).alias("truncated"))
    found = materialise(audits(rows, piece), "audits")
    out = join_same(digests(rows, found), counts, ["conv_id"])
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    out = join_same(ids, out, ["conv_id"])
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): turns damaged by a hash of their id and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text: Column = shown("text")
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    d = conversations.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"), k.alias("k"))
    return d.where("k <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
