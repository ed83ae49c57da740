"""Repair of the turn structure of conversations by the cheapest edits.

A repaired conversation is empty or reads as an optional system turn followed by user and assistant turns in
alternation, ending with an assistant.  Each row is kept, given the other role, or deleted, and empty turns are
inserted where one is missing; blank rows and repeats have to go.  To the edits a row is one of nine symbols: its
role's initial (s, u, a, other) with or without a cut-off end, or "has to go".

**Run-length dynamic programme.**  Equal consecutive symbols are one run.  A symbol is a min-plus matrix over the
four states (start, after system, after user, after assistant); a run of L is advanced through the cached
binary powers of its matrix, backwards, which gives the cost to the end before every run.  Walking forwards,
the choices inside a run are unrolled: of the cheapest edits the one least in ASCII (Delete, Insert, Keep,
Rerole).

**Spread.**  Rows are range-sorted by (conversation, turn), so a long conversation lies over many tasks.  Each
task turns its piece of a conversation into runs.  Where a conversation has several pieces, their matrices (16
numbers) are chained to get the cost behind each piece, every piece is unrolled from all four states, and
the chain of states picks one.  A repeat is found by joining the first turn of every (conversation, role, text)
digest, a key that is unique on both sides.  Only the digest of a whole repaired conversation reads its texts
in one task, row by row, as a hash of one text must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches as arrow_batches
from tidemark.llm.common import cut

# The prices of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60
ROLES = {"s": 0, "u": 1, "a": 2}
GONE = 8
#: State after a row of a role, by state and role; -1 where the role may not follow.
FOLLOWS = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
#: State after an inserted row, or one with a new role, and that role.
NEXT = (2, 2, 3, 2)
GIVEN = ("user", "user", "assistant", "user")
#: Cost to the end after the last row, and the inserts that it takes.
END = (0, 2 * INSERT, INSERT, 0)
CLOSING = ("", "II", "I", "")

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, price, next state) of a row, least edit first."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        role, extra = symbol >> 1, TRUNCATED * (symbol & 1)
        if role < 3 and FOLLOWS[state][role] >= 0:
            found.append(("K", extra, FOLLOWS[state][role]))
        found.append(("R", REROLE + extra, NEXT[state]))
    return found


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(4)), FAR) for j in range(4)) for i in range(4))


def _before(m: Matrix, after: Vector) -> Vector:
    return tuple(min(min(row[k] + after[k] for k in range(4)), FAR) for row in m)


@cache
def power(symbol: int, k: int) -> Matrix:
    """The transition of two to the power of ``k`` rows of a symbol, inserts before each row included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    inserts = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        one = NEXT[state]
        for at, price in ((one, INSERT), (NEXT[one], 2 * INSERT)):
            inserts[state][at] = min(inserts[state][at], price)
        for _, price, then in _options(symbol, state):
            row[state][then] = min(row[state][then], price)
    return _times(tuple(map(tuple, inserts)), tuple(map(tuple, row)))


def advanced(symbol: int, length: int, after: Vector) -> Vector:
    """Cost to the end before a run, from the cost after it."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            after = _before(power(symbol, k), after)
    return after


def matrix_of(runs: list[tuple[int, int]]) -> Matrix:
    """The transition of a piece, column by column."""
    columns = []
    for j in range(4):
        after = tuple(0 if i == j else FAR for i in range(4))
        for symbol, length in reversed(runs):
            after = advanced(symbol, length, after)
        columns.append(after)
    return tuple(zip(*columns))


@cache
def _step_back(symbol: int, after: Vector) -> Vector:
    """The cost before one row, less its least entry: choices do not depend on a constant."""
    before = _before(power(symbol, 0), after)
    low = min(before)
    return tuple(min(v - low, FAR) for v in before)


@cache
def _choose(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The edits up to and including a row from a state, and the state then."""
    cost, edits = _before(power(symbol, 0), after), ""
    while True:
        options = _options(symbol, state)
        options.insert(1, ("I", INSERT, -1))
        for edit, price, then in options:
            if price + (cost[NEXT[state]] if edit == "I" else after[then]) == cost[state]:
                break
        edits += edit
        if edit != "I":
            return edits, then
        state = NEXT[state]


def _level(v: Vector) -> Vector:
    low = min(v)
    return tuple(min(x - low, FAR) for x in v)


def unrolled(runs: list[tuple[int, int]], state: int, after: Vector) -> tuple[str, int]:
    """Edits of a piece from a state, given the cost after it, and the state then."""
    behind = [_level(after)]
    for symbol, length in reversed(runs):
        behind.append(_level(advanced(symbol, length, behind[-1])))
    out = []
    for i, (symbol, length) in enumerate(runs):
        rest = [behind[len(runs) - 1 - i]]
        for _ in range(length - 1):
            rest.append(_step_back(symbol, rest[-1]))
        for v in reversed(rest):
            edits, state = _choose(symbol, state, v)
            out.append(edits)
    return "".join(out), state


def cost_before(runs: list[tuple[int, int]], after: Vector) -> Vector:
    for symbol, length in reversed(runs):
        after = advanced(symbol, length, after)
    return after


def _runs(row) -> list[tuple[int, int]]:
    return list(zip(row.symbols, np.frombuffer(row.lengths, "<i8").tolist()))


# ---------------------------------------------------------------- rows to runs

_KEYS = ["turn", "role", "head"]
_MET = "[^\\x20\\x09-\\x0D]"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) broken by a hash of (conv_id, turn): dropped, emptied, without stops,
    repeated, or given the user role; ``copies`` is 2 for repeated ones, else 1."""
    action = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(action == 1, "").when(action == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    filled = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    return filled.where(action != 0).select(
        "conv_id", "turn", F.when(action == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(action == 3, 2).otherwise(1).alias("copies"))


def _slim(rows: DataFrame) -> DataFrame:
    """What the edits need of a row: order keys, digest, blank and cut-off marks."""
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    return rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"),
        F.unhex(F.md5(F.concat("role", F.lit("\x00"), "text").cast("binary"))).alias("digest"), "copies",
        (~F.col("text").rlike(_MET)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))


_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("symbols", pa.binary()), ("lengths", pa.binary()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("first_role", pa.int32()), ("last_role", pa.int32())])
_SEGMENT_SQL = (
    "conv_id long, part long, symbols binary, lengths binary, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first_role int, last_role int")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Piece:
    """Runs and counts of one conversation's rows in one task."""

    def __init__(self, conv, part):
        self.conv, self.part = conv, part
        self.symbols, self.lengths = bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def _run(self, symbol, length):
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += length
        elif length:
            self.symbols.append(symbol)
            self.lengths.append(length)

    def add(self, turn, role, copies, blank, truncated, first):
        kind = ROLES.get(role[:1], 3)
        if self.last_role is None:
            self.first_role = kind
        else:
            self.illegal += (self.last_role, kind) not in _LEGAL
        self.last_role = kind
        self.illegal += copies - 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if blank:
            self.blank += copies
            self._run(GONE, copies)
        elif first:
            self.truncated += truncated
            self.duplicate += copies - 1
            self._run(2 * kind + truncated, 1)
            self._run(GONE, copies - 1)
        else:
            self.duplicate += copies
            self._run(GONE, copies)

    def row(self):
        return (self.conv, self.part, bytes(self.symbols), np.array(self.lengths, "<i8").tobytes(), self.blank, self.duplicate, self.truncated,
                self.illegal, self.turns, self.first_turn, self.last_turn, self.first_role, self.last_role)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows():
        piece = None
        for batch in batches:
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        yield piece.row()
                    piece = _Piece(conv, part)
                piece.add(*row)
        if piece is not None:
            yield piece.row()

    return arrow_batches(batches, _SEGMENT, rows())


def segments(rows: DataFrame) -> DataFrame:
    """Pieces of conversations: runs of symbols and counts, in order of (conv_id, part)."""
    keys = ["conv_id", "turn", "role", "head", "digest"]
    every = _slim(rows).groupBy(*keys).agg(
        F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    # a null turn comes first, as the least pair (false, null) does
    seen = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    every = cut(every)
    firsts = every.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(seen).alias("at")).select("c", "d", "at.turn", F.lit(True).alias("first"))
    firsts = firsts.withColumnRenamed("turn", "t")
    marked = every.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    laid = marked.select(*keys, "copies", "blank", "truncated", F.coalesce("first", F.lit(False)).alias("first"))
    laid = laid.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(laid.select("conv_id", "turn", "role", "copies", "blank", "truncated", "first").mapInArrow(_pieces, _SEGMENT_SQL))


# ---------------------------------------------------------------- runs to edits

def _each(fn, fields: list[str]):
    """A function over pandas batches from one over rows."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([fn(r) for r in pdf.itertuples(index=False)], columns=fields)

    return run


def _whole(r) -> tuple:
    runs = _runs(r)
    audit, state = unrolled(runs, 0, END)
    return r.conv_id, r.part, audit + CLOSING[state], cost_before(runs, END)[0]


def _matrix(r) -> tuple:
    return r.conv_id, r.part, [v for row in matrix_of(_runs(r)) for v in row]


def _behind(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Cost behind each piece of a conversation, from the last piece to the first."""
    out, after = [], END
    for i, r in enumerate(pdf.sort_values("part", ascending=False).itertuples(index=False)):
        out.append((r.conv_id, r.part, list(after), i == 0))
        m = [int(v) for v in r.matrix]
        after = _before(tuple(tuple(m[4 * s:4 * s + 4]) for s in range(4)), after)
    return pd.DataFrame([(*row, after[0]) for row in out], columns=["conv_id", "part", "behind", "is_last", "cost"])


def _from_each_state(r) -> tuple:
    found = [unrolled(_runs(r), s, tuple(int(v) for v in r.behind)) for s in range(4)]
    return r.conv_id, r.part, [a + (CLOSING[s] if r.is_last else "") for a, s in found], [s for _, s in found], r.cost


def _chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
    state, out = 0, []
    for r in pdf.sort_values("part").itertuples(index=False):
        out.append((r.conv_id, r.part, state))
        state = int(r.ends[state])
    return pd.DataFrame(out, columns=["conv_id", "part", "state"])


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join where nulls equal each other; the right side's keys go."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return left.join(other, condition, how).drop(*[f"__{c}" for c in on])


def edits(pieces: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation that has rows."""
    order = Window.partitionBy("conv_id").orderBy("part")
    # the last known turn before a piece: null turns lie in front, so only the piece before can share one
    joint = pieces.withColumn("lag_role", F.lag("last_role").over(order)).withColumn("lag_turn", F.lag("last_turn").over(order))
    pairs = F.array(*[F.lit(10 * a + b) for a, b in sorted(_LEGAL)])
    broken = F.col("lag_role").isNotNull() & ~F.array_contains(pairs, 10 * F.col("lag_role") + F.col("first_role"))
    shared = F.coalesce(F.col("lag_turn") == F.col("first_turn"), F.lit(False))
    turns = F.sum(F.col("turns") - shared.cast("long"))
    totals = joint.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - turns, F.lit(0)).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + broken.cast("long")).alias("illegal"))
    totals = cut(totals)
    sized = _joined(pieces.select("conv_id", "part", "symbols", "lengths"), totals.select("conv_id", "pieces"), ["conv_id"])
    single = sized.where("pieces = 1").mapInPandas(
        _each(_whole, ["conv_id", "part", "audit", "cost"]), "conv_id long, part long, audit string, cost long")
    several = cut(sized.where("pieces > 1"))
    matrices = several.mapInPandas(_each(_matrix, ["conv_id", "part", "matrix"]), "conv_id long, part long, matrix array<long>")
    behind = matrices.groupBy("conv_id").applyInPandas(_behind, "conv_id long, part long, behind array<long>, is_last boolean, cost long")
    options = cut(_joined(several, behind, ["conv_id", "part"]).mapInPandas(
        _each(_from_each_state, ["conv_id", "part", "audits", "ends", "cost"]),
        "conv_id long, part long, audits array<string>, ends array<int>, cost long"))
    states = options.select("conv_id", "part", "ends").groupBy("conv_id").applyInPandas(_chain, "conv_id long, part long, state int")
    picked = _joined(options, states, ["conv_id", "part"]).select("conv_id", "part", F.element_at("audits", F.col("state") + 1).alias("audit"), "cost")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"])
    whole = picked.groupBy("conv_id").agg(F.array_join(texts, "").alias("audit"), F.max("cost").alias("cost"))
    audits = single.select("conv_id", "audit", "cost").unionByName(whole)
    return _joined(totals.drop("pieces"), audits, ["conv_id"])


# ---------------------------------------------------------------- edits to texts

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DIGESTS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DIGESTS_SQL = ", ".join(["conv_id long", *[f"{c} long" for c in _COUNTS], "audit string", "repaired_sha256 string"])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURNS_SQL = "conv_id long, place long, edit string, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Header rows as (row, None) and the repaired turns after them as (conv_id, (edit, role, text))."""
    conv, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, ("I", GIVEN[state], "")
            at, state = at + 1, NEXT[state]

    for batch in batches:
        for conv_id, kind, role, text, copies, found, *counts in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                yield from inserted()
                conv, audit, at, state = conv_id, found, 0, 0
                yield (conv_id, *counts, found), None
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "R":
                    yield conv, ("R", GIVEN[state], text)
                    state = NEXT[state]
                elif edit == "K":
                    yield conv, ("K", role, text)
                    state = FOLLOWS[state][ROLES[role[:1]]]
    yield from inserted()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        header, digest, empty = None, None, True
        for found, turn in _applied(batches):
            if turn is None:
                if header is not None:
                    yield (*header, digest.hexdigest())
                header, digest, empty = found, hashlib.sha256(), True
            else:
                digest.update((("" if empty else "\n") + turn[1] + ":" + turn[2]).encode())
                empty = False
        if header is not None:
            yield (*header, digest.hexdigest())

    return arrow_batches(batches, _DIGESTS, rows())


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        place = 0
        for found, turn in _applied(batches):
            place = 0 if turn is None else place + 1
            if turn is not None:
                yield (found, place, *turn)

    return arrow_batches(batches, _TURNS, rows())


def _with_edits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    found = edits(segments(rows))
    none = F.lit(0).cast("long")
    heads = _joined(ids.distinct(), found, ["conv_id"], "left").select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit("").alias("head"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copies"), F.coalesce("audit", F.lit("")).alias("audit"),
        *[F.coalesce(c, none).alias(c) for c in _COUNTS])
    texts = rows.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.substring("text", 1, 32).alias("head"),
        F.unhex(F.md5(F.concat("role", F.lit("\x00"), "text").cast("binary"))).alias("digest"), "copies", F.lit("").alias("audit"),
        *[none.alias(c) for c in _COUNTS])
    laid = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_KEYS, "digest")
    return laid.select("conv_id", "kind", "role", "text", "copies", "audit", *_COUNTS)


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def repair(rows: DataFrame, damage: bool = False) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation in (conv_id, turn, role, text).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  With ``damage`` the rows
    are broken first, and a conversation whose rows are all dropped still has its row, with zeros.

    A null role or text is one space, so its row is blank or has to be given a role; null turns come first; rows
    with a null conv_id are one conversation.  Empty texts are blank.  Rows that share a turn are ordered by role, the
    first 32 characters of the text and its digest; equal rows are repeats of the first.  A long text is one row
    of a stream; a long conversation is spread over tasks for the edits.  An empty table gives no rows.  Other columns
    are not read.
    """
    rows = _typed(rows)
    broken = damaged(rows) if damage else rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), F.lit(1).alias("copies"))
    return _with_edits(broken, rows.select("conv_id")).mapInArrow(_digests, _DIGESTS_SQL)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 1), edit, role, text; see ``repair``."""
    rows = _typed(rows)
    filled = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), F.lit(1).alias("copies"))
    return _with_edits(filled, rows.select("conv_id")).mapInArrow(_turns, _TURNS_SQL)
