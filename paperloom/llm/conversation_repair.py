"""Repair of the structure of conversations by shortest paths.

A conversation's rows, in order, and the state of the dialogue (nothing yet, after a system turn, after
a user turn, after an assistant turn) make a graph: an edit of a row leads to the next row, an insertion
leads to another state at the same row. Costs are 0 to 3, so Dial's bucket queue, a ring of four lists,
settles nodes backwards from the end without a heap. The distances are kept, and a walk from the start
along tight arcs that always takes the least letter is the audit.

Conversations can be of any length, so Spark sorts all rows by range and every task works on its stretch:

1. Rows that are equal fold into one with a number, and each learns whether its role and text came before.
2. A task cuts its stretch into pieces. A conversation that begins and ends in it and is short is done
   there. Of any other piece the least costs between the states at its two ends are kept.
3. Backwards over the pieces of a conversation, these costs give the distances at each piece's end.
4. Each piece finds its own distances from there, and its walk from each state that it may begin in.
5. Forwards over the pieces, the walk of the state that the one before ends in is taken.

Steps 3 and 5 see a row per PIECE_ROWS rows of a conversation. The digest of a repaired conversation is
one value over all its texts in order, so they pass one task there, piece by piece, and aren't held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_table, scratch_path, spread_join, written

#: A longer stretch of a conversation, in rows or in characters of text, is cut into pieces.
PIECE_ROWS, PIECE_CHARS = 1000, 4_000_000
#: Characters of role and text that the ranges of rows are told apart by, besides conversation and turn.
RANGE_CHARS = 32
#: Rows that a task hands on at a time.
BATCH_ROWS, BATCH_CHARS = 2000, 8_000_000

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
_WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A role that is put in leads on:
_NEXT = (2, 2, 3, 2)
_PUT_IN = {2: "user", 3: "assistant"}
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The least costs from each state to the end of a conversation, where only insertions are left.
_END = [0, 2 * INSERT_COST, INSERT_COST, 0]
_LEGAL = ("su", "ua", "au")
_FAULTS = ("blank", "duplicate", "truncated")


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, next state) of each state's edits of a row, by letter. Faults: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    out = []
    for state in range(4):
        arcs = [("D", DELETE_COST, state)]
        if fault not in (1, 2):
            more = TRUNCATED_COST if fault == 3 else 0
            if (after := _KEPT.get(initial, {}).get(state)) is not None:
                arcs.append(("K", KEEP_COST + more, after))
            arcs.append(("R", REROLE_COST + more, _NEXT[state]))
        out.append(arcs)
    return out


def _backwards(arcs: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int]]]:
    return [[(state, cost) for state in range(4) for _, cost, after in arcs[state] if after == q] for q in range(4)]


_FORWARD = {(initial, fault): _arcs(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}
_BACKWARD = {kind: _backwards(arcs) for kind, arcs in _FORWARD.items()}
_INSERTED = [[state for state in range(4) if _NEXT[state] == q] for q in range(4)]


def _kind(role: str, fault: int) -> tuple[str, int]:
    return (role[:1] if role[:1] in _KEPT else "", fault)


def distances(kinds: list[tuple[str, int]], ends: list[int]) -> list[int]:
    """The least cost from each node (4 * row + state) to the end, by Dial's bucket queue; ends: the costs behind the last row."""
    settled = [_FAR] * (4 * len(kinds)) + list(ends)
    waiting = sorted(((cost, 4 * len(kinds) + state) for state, cost in enumerate(ends) if cost < _FAR), reverse=True)
    ring, held, level = ([], [], [], []), 0, 0
    while waiting or held:
        if not held:
            level = waiting[-1][0]
        bucket = ring[level & 3]
        while waiting and waiting[-1][0] == level:
            bucket.append(waiting.pop()[1])
            held += 1
        for node in bucket:  # which grows by arcs without cost
            if settled[node] != level:
                continue
            row, state = node >> 2, node & 3
            for before in _INSERTED[state]:
                if settled[4 * row + before] > level + INSERT_COST:
                    settled[4 * row + before] = level + INSERT_COST
                    ring[level + INSERT_COST & 3].append(4 * row + before)
                    held += 1
            if row:
                for before, cost in _BACKWARD[kinds[row - 1]][state]:
                    if settled[4 * row - 4 + before] > level + cost:
                        settled[4 * row - 4 + before] = level + cost
                        ring[level + cost & 3].append(4 * row - 4 + before)
                        held += 1
        held -= len(bucket)
        bucket.clear()
        level += 1
    return settled


def walk(kinds: list[tuple[str, int]], settled: list[int], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from a state at the first row to behind the last, and the state there."""
    letters, row = [], 0
    while row < len(kinds):
        here = settled[4 * row + state]
        tight = [(letter, after) for letter, cost, after in _FORWARD[kinds[row]][state] if here == cost + settled[4 * row + 4 + after]]
        if here == INSERT_COST + settled[4 * row + _NEXT[state]]:
            tight.append(("I", _NEXT[state]))
        letter, state = min(tight)
        letters.append(letter)
        row += letter != "I"
    return "".join(letters), state


def _to_end(state: int) -> str:
    """The insertions behind the last row."""
    return "I" * (_END[state] // INSERT_COST)


def _edited(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the rows that an audit leaves, from a state on."""
    row = 0
    for letter in audit:
        if letter == "K":
            state = _KEPT[roles[row][:1]][state]
            yield letter, roles[row], texts[row]
        elif letter != "D":
            state = _NEXT[state]
            yield letter, _PUT_IN[state], texts[row] if letter == "R" else ""
        row += letter != "I"


class _Digest:
    """SHA-256 of lines as they come."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, edited: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in edited:
            self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False


class _Piece:
    """Rows of a conversation in order, with what is counted over them."""

    def __init__(self, conv_id):
        self.conv_id, self.roles, self.texts, self.faults, self.chars = conv_id, [], [], [], 0
        self.turns = None  # least, greatest, distinct

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            low, high, distinct = self.turns or (turn, None, 0)
            self.turns = (low, turn, distinct + (turn != high))
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(role) + len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.chars >= PIECE_CHARS

    def kinds(self) -> list[tuple[str, int]]:
        return [_kind(*row) for row in zip(self.roles, self.faults, strict=True)]

    def illegal(self) -> int:
        initials = [role[:1] for role in self.roles]
        return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: tuple[int, int, int] | None) -> int:
    return min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1) if turns else 0


def _fault(text: str, seen: bool) -> int:
    told = text.strip(_WHITE)
    return 1 if not told else 2 if seen else 0 if told[-1] in ".!?" else 3


def _batches(rows: Iterator[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow, held, chars = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        chars += sum(map(len, row.get("texts") or (row.get("text", ""),)))
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _in_arrow(work: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType) -> Callable:
    """mapInArrow's function of one over dictionaries of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(work(row for batch in batches for row in batch.to_pylist()), schema)

    return run


def _cut(rows: Iterator[dict], piece_rows: int, whole: bool) -> Iterator[dict]:
    """The pieces of a task's stretch; whole: conversations that surely end in it are finished here."""
    base, number = TaskContext.get().partitionId() << 32, 0

    def handed(piece: _Piece, finished: bool) -> dict:
        nonlocal number
        kinds, counted = piece.kinds(), {name: piece.faults.count(k) for k, name in enumerate(_FAULTS, start=1)}
        out = {"conv_id": piece.conv_id, "place": base + number, "finished": finished, "illegal": piece.illegal(), **counted}
        number += 1
        if not finished:
            # costs[4 * a + b]: from state a at the first row to state b behind the last.
            to = [distances(kinds, [0 if q == state else _FAR for q in range(4)])[:4] for state in range(4)]
            return out | {"costs": [to[b][a] for a in range(4) for b in range(4)], "turns": list(piece.turns or ()), "roles": piece.roles, "texts": piece.texts, "faults": piece.faults}
        settled = distances(kinds, _END)
        audit, state = walk(kinds, settled, 0)
        digest = _Digest()
        digest.add(_edited(audit + _to_end(state), piece.roles, piece.texts, 0))
        return out | {"gaps": _gaps(piece.turns), "cost": settled[0], "audit": audit + _to_end(state), "repaired_sha256": digest.sha.hexdigest()}

    first = True
    piece, unbroken = None, False
    for conv_id, group in groupby(rows, key=lambda row: row["conv_id"]):
        if piece is not None:
            yield handed(piece, whole and unbroken)
            first = False
        piece, unbroken = _Piece(conv_id), not first
        for row in group:
            fault = _fault(row["text"], row["seen"])
            for copy in range(row["copies"]):
                if piece.full(piece_rows):
                    yield handed(piece, False)
                    piece, unbroken = _Piece(conv_id), False
                piece.add(row["turn"], row["role"], row["text"], 2 if copy and fault != 1 else fault)
    if piece is not None:
        yield handed(piece, False)


def _ends(rows: Iterator[dict]) -> Iterator[dict]:
    """place and the distances behind the piece's last row; pieces of a conversation come last first."""
    for _, group in groupby(rows, key=lambda row: row["conv_id"]):
        ends = _END
        for row in group:
            yield {"place": row["place"], "ends": ends}
            ends = [min(row["costs"][4 * a + b] + ends[b] for b in range(4)) for a in range(4)]


def _walked(rows: Iterator[dict]) -> Iterator[dict]:
    """The walk of each piece from each state."""
    for row in rows:
        kinds = [_kind(*both) for both in zip(row["roles"], row["faults"], strict=True)]
        settled = distances(kinds, row["ends"])
        walks = [walk(kinds, settled, state) for state in range(4)]
        yield {k: v for k, v in row.items() if k != "ends"} | {"cost": settled[0], "audits": [w[0] for w in walks], "states": [w[1] for w in walks]}


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """A report of each conversation; its pieces come in order."""
    for conv_id, group in groupby(rows, key=lambda row: row["conv_id"]):
        state, audit, digest, turns, last, cost = 0, [], _Digest(), None, "", None
        counted = dict.fromkeys((*_FAULTS, "illegal"), 0)
        for row in group:
            cost = row["cost"] if cost is None else cost
            for name in counted:
                counted[name] += row[name]
            if row["turns"]:
                low, high, distinct = row["turns"]
                turns = (turns[0], high, turns[2] + distinct - (turns[1] == low)) if turns else (low, high, distinct)
            if row["roles"]:
                counted["illegal"] += audit != [] and last + row["roles"][0][:1] not in _LEGAL
                last = row["roles"][-1][:1]
                audit.append(row["audits"][state])
                digest.add(_edited(audit[-1], row["roles"], row["texts"], state))
                state = row["states"][state]
        digest.add(_edited(_to_end(state), [], [], state))
        yield {"conv_id": conv_id, "gaps": _gaps(turns), **counted, "cost": cost, "audit": "".join(audit) + _to_end(state), "repaired_sha256": digest.sha.hexdigest()}


def _turns(rows: Iterator[dict]) -> Iterator[dict]:
    """The rows of each repaired conversation; its pieces come in order."""
    for conv_id, group in groupby(rows, key=lambda row: row["conv_id"]):
        state, position = 0, 0
        for row in group:
            for letter, role, text in _edited(row["audits"][state], row["roles"], row["texts"], state):
                yield {"conv_id": conv_id, "position": position, "edit": letter, "role": role, "text": text}
                position += 1
            state = row["states"][state]
        for letter, role, text in _edited(_to_end(state), [], [], state):
            yield {"conv_id": conv_id, "position": position, "edit": letter, "role": role, "text": text}
            position += 1


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in pairs]


_LONG, _STRING, _LONGS, _STRINGS = T.LongType(), T.StringType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_REPORT = _fields(*((n, _LONG) for n in ("gaps", *_FAULTS, "illegal", "cost")), ("audit", _STRING), ("repaired_sha256", _STRING))
_PIECE = _fields(("place", _LONG), ("finished", T.BooleanType()), ("costs", _LONGS), ("turns", _LONGS), ("roles", _STRINGS), ("texts", _STRINGS), ("faults", _LONGS))


def _stretches(turns: DataFrame, copies: str | None, path: str) -> DataFrame:
    """Rows with their number of copies and whether role and text came before, sorted by ranges. Folded rows are written to path."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    content = F.unhex(F.md5(F.concat_ws("/", F.sha2("text", 256), F.sha2("role", 256), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")))))
    rows = written(rows.withColumn("content", content), "turns", path)
    order = F.struct(F.col("turn").isNotNull(), "turn")
    real, names = rows.where("copies > 0"), rows.where("copies = 0")
    met = real.groupBy("content").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    columns = ("conv_id", "turn", "role", "text", "copies")
    flagged = spread_join(real, met, "content").select(*columns, (F.col("first") < order).alias("seen"))
    flagged = flagged.unionByName(names.select(*columns, F.lit(False).alias("seen")))
    ranges = ["conv_id", "turn", F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS)]
    return flagged.repartitionByRange(*ranges).sortWithinPartitions("conv_id", "turn", "role", "text")


def _walked_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with their walks, those of a conversation together and in order."""
    place, end_schema = pieces.schema["place"], _fields(("ends", _LONGS))
    costs = pieces.select("conv_id", "place", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"))
    ends = costs.mapInArrow(_in_arrow(_ends, schema := T.StructType([place, *end_schema])), schema)
    rows = pieces.select("conv_id", "place", "turns", "roles", "texts", "faults", *_FAULTS, "illegal").join(ends, "place")
    schema = T.StructType([*(rows.schema[c] for c in rows.columns if c != "ends"), *_fields(("cost", _LONG), ("audits", _STRINGS), ("states", _LONGS))])
    return rows.mapInArrow(_in_arrow(_walked, schema), schema).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _pieces(turns: DataFrame, copies: str | None, piece_rows: int, whole: bool) -> DataFrame:
    schema = T.StructType([turns.schema["conv_id"], *_PIECE, *_REPORT])
    path = scratch_path(turns.sparkSession, "turns")
    try:
        return written(_stretches(turns, copies, path).mapInArrow(_in_arrow(lambda rows: _cut(rows, piece_rows, whole), schema), schema), "pieces")
    finally:
        drop_table(turns.sparkSession, path)


def repair(turns: DataFrame, copies: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A report of each conversation of turns (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, null turns first, and at the same turn by role and text. `copies` names a column
    of how many times a row stands there; a row with 0 only makes its conversation known, and one
    without other rows has zeros, an empty audit and the digest of nothing. Null roles and texts count
    as one space; null conv_ids are one conversation; turns count as whole numbers, gaps stop at
    2**63 - 1. Repeated rows are duplicates. Roles and texts are compared by hashes of 128 bits and more.
    An empty table gives no rows; other columns are ignored. A very long text makes a piece of its own,
    whole in memory; very long conversations take more pieces, not larger ones (their audit is one string).
    """
    pieces = _pieces(turns, copies, piece_rows, whole=True)
    report = T.StructType([turns.schema["conv_id"], *_REPORT])
    done = pieces.where("finished").select(*report.names)
    rest = _walked_pieces(pieces.where("NOT finished"))
    return done.unionByName(rest.mapInArrow(_in_arrow(_joined, report), report))


def repaired_turns(turns: DataFrame, copies: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position, edit (I, K or R), role, text. Rows and edge cases as in repair()."""
    schema = T.StructType([turns.schema["conv_id"], *_fields(("position", _LONG), ("edit", _STRING), ("role", _STRING), ("text", _STRING))])
    return _walked_pieces(_pieces(turns, copies, piece_rows, whole=False)).mapInArrow(_in_arrow(_turns, schema), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows are lost, emptied, cut, repeated or get another role by a hash of conv_id and turn.

    Nulls count as one space. A lost row stays as a nameless one with 0 copies.
    """
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    role: Column = F.when(draw == 0, "").when(draw == 4, "user").otherwise(told("role"))
    text: Column = F.when(draw.isin(0, 1), "").when(draw == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.when(draw != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
