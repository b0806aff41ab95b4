"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation should read ``(s?(ua)+)?`` in its roles' initials: maybe a system turn, then pairs of user and
assistant. Every row may be kept (0), given the role user or assistant (1) or deleted (2), and turns of empty
text may be inserted (5). Blank rows and repeated ones must be deleted; a row that breaks off and stays costs 5.
The lattice has a node for each number of rows read and each state of the pattern. Two searches, from its
start and from its ends, settle nodes by cost; they go on until no crossing edge can cost as little as the
best one, and of all crossings of least cost the one whose audit (the edits' initials in order) is least in
ASCII is taken. A conversation of over ``ROWS`` rows is searched in stretches of ``ROWS``, from each state to each
state, and the stretches are joined by the same order, so memory stays small.

Rows reach the search as one byte each. Then the audit goes ahead of its conversation's rows, which are edited
and hashed as they pass, so no text is gathered. One conversation is one task's stream, as its digest is one
hash over its texts in order.

Edge cases: a NULL role or text is one space; turns come in order, NULLs first, then by role and digest of the
text; a NULL ``conv_id`` is a conversation of its own; roles other than s, u, a cannot be kept; rows that are
equal in all columns are duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Rows that one search covers.
ROWS = 512
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: States of the pattern: at the start, after a system turn, after a user's, after an assistant's.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = (START, AFTER_S, AFTER_U, AFTER_A)
ENDS = (START, AFTER_A)
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))

Edge = tuple[int, int, str, int]


def next_turn(state: int) -> int:
    """The turn by which the pattern goes on; ahead of it, a system turn may stand at the start."""
    return ASSISTANT if state == AFTER_U else USER


def after(state: int, turn: int) -> int | None:
    if turn == SYSTEM:
        return AFTER_S if state == START else None
    return (AFTER_A if turn == ASSISTANT else AFTER_U) if turn == next_turn(state) else None


@functools.cache
def _row_edges(code: int) -> tuple[tuple[Edge, ...], ...]:
    """For each state, the edits of one row: the state before, the state after, the letter, the cost."""
    turn, fault = code % 4, code // 4
    out = []
    for state in STATES:
        edges = [(state, state, "D", DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = BROKEN if fault == TRUNCATED else 0
            kept = after(state, turn)
            if kept is not None:
                edges.append((state, kept, "K", KEEP + more))
            if turn != next_turn(state):
                edges.append((state, after(state, next_turn(state)), "R", REROLE + more))
        out.append(tuple(edges))
    return tuple(out)


_INSERTS = tuple(after(state, next_turn(state)) for state in STATES)
#: For each state, the states from which an insertion reaches it.
_INSERTED = tuple(tuple(q for q in STATES if _INSERTS[q] == state) for state in STATES)


@functools.cache
def _row_edges_back(code: int) -> tuple[tuple[Edge, ...], ...]:
    edges = [edge for some in _row_edges(code) for edge in some]
    return tuple(tuple(edge for edge in edges if edge[1] == state) for state in STATES)


def search(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and of its audits the least, from ``start`` before the rows to one of ``ends`` behind them."""
    n = len(codes)
    # Labels of a node: cost, and the least audit from the start (or to an end) at this cost. Of nodes of one
    # cost the one with more rows read (or left) comes later, and only keeping costs nothing, so a settled label is final.
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in ends}
    settled: tuple[set, set] = (set(), set())
    heaps = [[(0, 0, start)], [(0, -n, q) for q in ends]]
    heapq.heapify(heaps[1])
    best = 0 if (0, start) in back else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        _, i, q = heapq.heappop(heaps[side])
        i = abs(i)
        if (i, q) in settled[side]:
            continue
        settled[side].add((i, q))
        own, other = (ahead, back) if side == 0 else (back, ahead)
        cost, audit = own[i, q]
        if side == 0:
            steps = [(i, _INSERTS[q], "I", INSERT)]
            if i < n:
                steps += [(i + 1, to, letter, price) for _, to, letter, price in _row_edges(codes[i])[q]]
        else:
            steps = [(i, of, "I", INSERT) for of in _INSERTED[q]]
            if i:
                steps += [(i - 1, of, letter, price) for of, _, letter, price in _row_edges_back(codes[i - 1])[q]]
        for j, to, letter, price in steps:
            label = (cost + price, audit + letter if side == 0 else letter + audit)
            if (j, to) not in own or label < own[j, to]:
                own[j, to] = label
                heapq.heappush(heaps[side], (label[0], j if side == 0 else -j, to))
            if (j, to) in other:
                total = label[0] + other[j, to][0]
                best = total if best is None or total < best else best
    if best is None:
        return None
    audits = [ahead[x][1] + back[x][1] for x in settled[0] if x in back and ahead[x][0] + back[x][0] == best]
    for i, q in settled[0]:
        cost, audit = ahead[i, q]
        steps = [(i, _INSERTS[q], "I", INSERT)]
        if i < n:
            steps += [(i + 1, to, letter, price) for _, to, letter, price in _row_edges(codes[i])[q]]
        for j, to, letter, price in steps:
            if (j, to) in settled[1] and cost + price + back[j, to][0] == best:
                audits.append(audit + letter + back[j, to][1])
    return best, min(audits)


_search = functools.lru_cache(maxsize=1 << 14)(search)


class Search:
    """The search over one conversation whose rows come in stretches."""

    def __init__(self) -> None:
        self.codes = bytearray()
        #: Cost and audit up to here by state; what the audits share at their beginning is in ``done``.
        self.open: dict[int, tuple[int, str]] = {START: (0, "")}
        self.done: list[str] = []

    def add(self, codes: bytes) -> None:
        self.codes += codes
        while len(self.codes) > ROWS:
            self._stretch(bytes(self.codes[:ROWS]))
            del self.codes[:ROWS]

    def _stretch(self, codes: bytes) -> None:
        reached: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.open.items():
            for to in STATES:
                found = search(codes, state, (to,))
                if found and (to not in reached or (cost + found[0], audit + found[1]) < reached[to]):
                    reached[to] = (cost + found[0], audit + found[1])
        shared = len(os.path.commonprefix([audit for _, audit in reached.values()]))
        self.done.append(next(iter(reached.values()))[1][:shared])
        self.open = {state: (cost, audit[shared:]) for state, (cost, audit) in reached.items()}

    def result(self) -> tuple[int, str]:
        codes = bytes(self.codes)
        found = [(state, _search(codes, state, ENDS) if len(codes) <= 16 else search(codes, state, ENDS)) for state in self.open]
        cost, audit = min((self.open[state][0] + x[0], self.open[state][1] + x[1]) for state, x in found if x)
        return cost, "".join([*self.done, audit])


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def _given(turns: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _codes(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, code``: role and first fault of each row in a number below 16."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    known = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    role = F.lit(OTHER)
    for initial, number in known.items():
        role = F.when(F.substring("role", 1, 1) == initial, number).otherwise(role)
    marked = rows.select(
        "conv_id", "turn", "role", "digest", role.alias("part"), (end == "").alias("blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("whole")
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault: Column = F.when(F.col("blank"), BLANK).when(F.col("seen"), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(FINE)
    marked = marked.withColumn("seen", seen)
    return marked.select("conv_id", "turn", "role", "digest", (F.col("part") + 4 * fault).cast("int").alias("code"))


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation.

    ``ids`` adds conversations that may have no row left.
    """
    rows = _codes(_given(turns))
    if ids is not None:
        known = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("code", "int"))]
        rows = rows.unionAll(known.select("conv_id", *empty))
    again = F.floor(F.col("code") / 4) == DUPLICATE
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("code").isNotNull(), "turn", "role", "digest", again)
    return rows.select("conv_id", "turn", "code").mapInArrow(_audited, _AUDIT)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _AUDIT.split(", ")]
    current: _Tally | None = None
    for batch in batches:
        conv, turn = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        code = batch.column(2).to_pylist()
        out, a = [], 0
        while a < len(conv):
            b = a + 1
            while b < len(conv) and conv[b] == conv[a]:
                b += 1
            if current is None or current.conv_id != conv[a]:
                if current is not None:
                    out.append(current.row())
                current = _Tally(conv[a])
            current.add(turn[a:b], code[a:b])
            a = b
        yield _batch(out, names)
    if current is not None:
        yield _batch([current.row()], names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    types = [pa.string() if x in ("audit", "repaired_sha256") else pa.int64() for x in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class _Tally:
    """What is counted over one conversation's rows."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.low = self.last = None
        self.distinct = self.illegal = 0
        self.faults = np.zeros(4, np.int64)
        self.before: int | None = None
        self.search = Search()

    def add(self, turns: list, codes: list) -> None:
        found = [(t, c) for t, c in zip(turns, codes, strict=True) if c is not None]
        for turn, code in found:
            if turn is not None and turn != self.last:
                self.distinct += 1
                self.low = turn if self.low is None else self.low
                self.last = turn
            part = code % 4
            if self.before is not None and (self.before, part) not in LEGAL:
                self.illegal += 1
            self.before = part
            self.faults[code // 4] += 1
        self.search.add(bytes(c for _, c in found))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.distinct
        cost, audit = self.search.result()
        return (self.conv_id, gaps, *(int(self.faults[x]) for x in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, cost, audit)


_EDITED = f"{_AUDIT}, place long, edit string, role string, text string"


def edited(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each conversation's audit in a row of its own (``place`` NULL), followed in the same partition by its
    repaired turns, ``place`` from 0."""
    names = [x.split()[0] for x in _AUDIT.split(", ")]
    audit = audits(turns, ids).select("conv_id", F.struct(*names[1:]).alias("a"))
    rows = _given(turns).select("conv_id", F.lit(None).cast(audit.schema["a"].dataType).alias("a"), "turn", "role", "digest", "text")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
    rows = audit.select("conv_id", "a", *empty).unionAll(rows)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("a").isNull(), "turn", "role", "digest")
    return rows.select("conv_id", "a.*", "role", "text").mapInArrow(_edits, _EDITED)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _EDITED.split(", ")]
    conv_id, audit, at, place, state = None, "", 0, 0, START
    for batch in batches:
        given = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        out: dict[str, list] = {name: [] for name in names}

        def put(edit: str, role: str | None, text: str, out: dict[str, list] = out) -> None:
            nonlocal place, state
            turn = next_turn(state)
            if edit == "K":
                turn = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            state = after(state, turn)
            row = {"conv_id": conv_id, "place": place, "edit": edit, "role": role if edit == "K" else ROLES[turn], "text": text}
            for name in names:
                out[name].append(row.get(name))
            place += 1

        for i, found in enumerate(given["audit"]):
            if found is not None:
                for letter in audit[at:]:
                    put(letter, None, "")
                for name in names:
                    out[name].append(given[name][i] if name in given and name not in ("role", "text") else None)
                conv_id, audit, at, place, state = given["conv_id"][i], found, 0, 0, START
                continue
            while audit[at] == "I":
                put("I", None, "")
                at += 1
            if audit[at] != "D":
                put(audit[at], given["role"][i], given["text"][i])
            at += 1
        yield _edited_batch(out)
    out = {name: [] for name in names}
    for letter in audit[at:]:
        turn = next_turn(state)
        state = after(state, turn)
        row = {"conv_id": conv_id, "place": place, "edit": letter, "role": ROLES[turn], "text": ""}
        for name in names:
            out[name].append(row.get(name))
        place += 1
    yield _edited_batch(out)


def _edited_batch(out: dict[str, list]) -> pa.RecordBatch:
    types = {x.split()[0]: pa.int64() if x.endswith("long") else pa.string() for x in _EDITED.split(", ")}
    return pa.RecordBatch.from_arrays([pa.array(column, types[name]) for name, column in out.items()], list(out))


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns of every conversation after its cheapest repair."""
    return edited(turns).filter("place is not null").select("conv_id", "place", "edit", "role", "text")


def summaries(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The columns of ``audits``, and ``repaired_sha256`` of the repaired turns' ``role:text``, a line break between."""
    return edited(turns, ids).mapInArrow(_hashed, f"{_AUDIT}, repaired_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*(x.split()[0] for x in _AUDIT.split(", ")), "repaired_sha256"]
    row, digest = None, hashlib.sha256()
    for batch in batches:
        given = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        out = []
        for i, place in enumerate(given["place"]):
            if place is None:
                if row is not None:
                    out.append((*row, digest.hexdigest()))
                row, digest = tuple(given[name][i] for name in names[:-1]), hashlib.sha256()
            else:
                digest.update(f"{chr(10) if place else ''}{given['role'][i]}:{given['text'][i]}".encode())
        yield _batch(out, names)
    if row is not None:
        yield _batch([(*row, digest.hexdigest())], names)
