"""Repair of conversations by the cheapest edits.

A conversation's roles must read ``(system? (user assistant)+)?``. Its rows
and the states of that pattern form a graph: a node is a number of rows used
and a state, an arc an edit. Minimum costs from the start (forward) and to
the end (backward) tell which arcs are tight, that is on some cheapest path.
A walk over the set of nodes that share the letters so far takes, at each
step, the least letter that leaves it by a tight arc: the cheapest edits
whose letters come first.

Rows meet by conversation twice. First without their texts: a byte each
stands for role and fault, which is all that the search needs and all of a
conversation that a task holds. Then with their texts, in a stream that is
edited, and hashed, as it goes by: a digest is a chain over its input, so that
the texts of one conversation go through one task, but none waits there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60

# a row's byte: the initial of its role, and what is wrong with it
INITIALS = "sua"
_ROLE, _MUST_GO, _CUT = 3, 4, 8
#: States: nothing yet, after the system's row, after a user's, after an assistant's. Where an initial leads from each.
_NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
_ENDS = (0, 3)
_BLOCK = 4096  # rows between the backward costs that are kept


def _moves(state: int, code: int | None) -> list[tuple[str, int, int]]:
    """Edits at a row (none at the end) in a state: letter, cost, state after."""
    said = [_NEXT[state][i] for i in (1, 2) if _NEXT[state][i] is not None]
    out = [("I", INSERT, q) for q in said]
    if code is None:
        return out
    out.append(("D", DELETE, state))
    if not code & _MUST_GO:
        more = TRUNCATED if code & _CUT else 0
        role = code & _ROLE
        if role < 3 and _NEXT[state][role] is not None:
            out.append(("K", more, _NEXT[state][role]))
        out += [("R", REROLE + more, q) for q in said]
    return out


def _settle(costs: list[int], backward: bool) -> tuple[int, ...]:
    """Costs after insertions at one place; two rounds reach every state."""
    for _ in range(2):
        for q in range(4):
            for _, c, to in _moves(q, None):
                a, b = (to, q) if backward else (q, to)
                costs[b] = min(costs[b], costs[a] + c)
    return tuple(min(c, NEVER) for c in costs)


@lru_cache(1 << 16)
def _ahead(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Forward costs beyond a row, from those before it."""
    out = [NEVER] * 4
    for q in range(4):
        for letter, c, to in _moves(q, code):
            if letter != "I":
                out[to] = min(out[to], costs[q] + c)
    return _settle(out, False)


@lru_cache(1 << 16)
def _behind(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Backward costs before a row, from those beyond it."""
    out = [NEVER] * 4
    for q in range(4):
        for letter, c, to in _moves(q, code):
            if letter != "I":
                out[q] = min(out[q], costs[to] + c)
    return _settle(out, True)


def _relative(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The least cost, and all of them beyond it: few such differences exist, so that steps are found in a cache."""
    least = min(costs)
    return least, tuple(c - least if c < NEVER else NEVER for c in costs)


_START, _STOP = _settle([0, NEVER, NEVER, NEVER], False), _settle([0 if q in _ENDS else NEVER for q in range(4)], True)


@lru_cache(1 << 18)
def _step(nodes: tuple[int, ...], code: int | None, fore: tuple[int, ...], here: tuple[int, ...], there: tuple[int, ...] | None, best: int) -> tuple[str, tuple[int, ...]]:
    """Letters up to and with the one that uses a row (or up to the end), and the nodes after it.

    ``fore`` are forward costs before the row, ``here`` and ``there`` backward ones before and beyond it; an arc is
    tight if the three parts of its cheapest path add up to ``best``.
    """
    letters = ""
    while True:
        if code is None and any(q in _ENDS and fore[q] == best for q in nodes):
            return letters, nodes
        tight: dict[str, set[int]] = {}
        for q in nodes:
            for letter, c, to in _moves(q, code):
                if fore[q] + c + (here if letter == "I" else there)[to] == best:
                    tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        letters, nodes = letters + letter, tuple(sorted(tight[letter]))
        if letter != "I":
            return letters, nodes


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The cost and the letters of the cheapest edits, of several the ones that come first.

    Backward costs are kept at the start of each block, and worked out again inside the one that is walked.
    """
    marks = [(0, _STOP)]
    off, back = marks[0]
    for end in range(len(codes), 0, -_BLOCK):
        for code in reversed(codes[max(0, end - _BLOCK) : end]):
            least, back = _relative(_behind(back, code))
            off += least
        marks.append((off, back))
    total = off + back[0]
    letters, nodes, fore, spent = [], (0,), _START, 0
    first = len(codes) % _BLOCK or _BLOCK
    at = 0
    for off, back in reversed(marks[:-1]):
        block = codes[at : first if at == 0 else at + _BLOCK]
        at += len(block)
        # backward costs before each row of the block, and after its last
        costs = [(off, back)]
        for code in reversed(block):
            least, back = _relative(_behind(back, code))
            off += least
            costs.append((off, back))
        costs.reverse()
        for i, code in enumerate(block):
            (a, here), (b, there) = costs[i], costs[i + 1]
            # all taken less what any way through has cost so far and will cost, so that equal steps look equal
            left = total - spent - a
            there = tuple(c + b - a if c < NEVER else NEVER for c in there)
            more, nodes = _step(nodes, code, fore, here, there, left)
            letters.append(more)
            least, fore = _relative(_ahead(fore, code))
            spent += least
    letters.append(_step(nodes, None, fore, _STOP, None, total - spent)[0])
    return total, "".join(letters)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What the rows of one conversation come to, one row after the other in order."""

    def __init__(self, name) -> None:
        self.name, self.codes = name, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        place = INITIALS.find(initial) if initial else 3
        self.codes.append((3 if place < 0 else place) | (_CUT if fault == "truncated" else _MUST_GO if fault else 0))

    def result(self) -> tuple:
        cost, audit = cheapest_edits(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _find_edits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order to a row for each conversation."""
    now, done = None, []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * len(schema), schema.types)], schema=schema)
        done.clear()
        return out

    for batch in batches:
        for name, turn, role, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or name != now.name:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(name)
            now.add(turn, role, fault)
        yield flush()
    if now is not None:
        done.append(now.result())
    yield flush()


def _apply(audit: str, rows: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple[str, int | None, str, str]]:
    """Edits of a conversation: letter, turn, role and text of each row kept or put in; of deleted rows as they were."""
    after = 0

    def spoken() -> str:
        return "assistant" if after == 2 else "user"

    for letter in audit:
        if letter == "I":
            role = spoken()
            yield letter, None, role, ""
        else:
            turn, role, text = next(rows)
            if letter == "R":
                role = spoken()
            yield letter, turn, role, text
            if letter == "D":
                continue
        after = _NEXT[after][INITIALS.index(role[0])]


def _mend(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    """Each conversation's edits, then its rows in order, to its edited rows or to one row with their digest."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    head, out, size = next(rows, None), [], 0
    while head is not None:
        name, _, _, _, _, audit, *counts = head
        after = []

        def own() -> Iterator[tuple]:
            for row in rows:
                if row[1]:
                    yield row[2:5]
                else:
                    after.append(row)
                    return

        texts = own()
        said, first = hashlib.sha256(), True
        for place, (letter, turn, role, text) in enumerate(_apply(audit, texts)):
            if not digest:
                out.append((name, place, letter, turn, role, text))
                size += len(text) + 64
            elif letter != "D":
                said.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
        next(texts, None)  # the head of the next conversation
        if digest:
            out.append((name, *counts, audit, said.hexdigest()))
            size += len(audit) + 256
        head = after[0] if after else None
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def find_repairs(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are in the order of ``turn``, nulls first; ties go by role, then by
    the SHA-256 of the text; equal rows stand side by side. ``gaps`` are
    missing turn numbers, ``illegal`` neighbouring roles other than system
    user, user assistant and assistant user. A row's first fault counts:
    blank, duplicate (of an earlier row's role and text), or truncated (its
    last character but blanks is none of ``.!?``). ``audit`` holds the
    initials of the cheapest edits, Keep, Rerole, Delete and Insert, of
    several the ones that come first in ASCII. Null roles and texts count as
    empty, null ids as one conversation; other columns are ignored; an empty
    table has no conversations. Of a conversation, a task holds two bytes a row.
    """
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    cut = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    rows = _rows(conversations, id_col, turn_col, role_col, text_col).select("conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"), cut.alias("cut"))
    # one shuffle: equal rows of a conversation, and then its order, are sorted for within its partition
    rows = rows.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.withColumn("seen", seen)
    fault = F.when(F.col("blank"), "blank").when(F.col("seen") > 1, "duplicate").when(F.col("cut"), "truncated")
    rows = _in_order(rows.withColumn("fault", fault)).select("conv_id", "turn", "role", "fault")
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())])
    return rows.mapInArrow(lambda batches: _find_edits(batches, schema), f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


def _with_texts(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each conversation's edits, followed by its rows in order."""
    edits = find_repairs(conversations, id_col, turn_col, role_col, text_col).withColumn("kind", F.lit(0))
    texts = _rows(conversations, id_col, turn_col, role_col, text_col).withColumn("kind", F.lit(1))
    both = edits.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    return _in_order(both, "kind").select("conv_id", "kind", "turn", "role", "text", "audit", *_COUNTS)


def repair_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edited rows: conv_id, place (from 0), edit (K, R, D or I), turn (null for inserted rows), role, text; deleted rows as they were.

    Order and edits are those of ``find_repairs``, as are nulls, ties, repeated rows, other columns and empty tables.
    """
    rows = _with_texts(conversations, id_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return rows.mapInArrow(lambda batches: _mend(batches, schema, False), f"conv_id {kind.simpleString()}, place long, edit string, turn long, role string, text string")


def repair_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``find_repairs`` and ``repaired_sha256``, of ``role:text`` of the repaired rows with line feeds between, in lowercase hexadecimal."""
    rows = _with_texts(conversations, id_col, turn_col, role_col, text_col)
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return rows.mapInArrow(lambda batches: _mend(batches, schema, True), f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
