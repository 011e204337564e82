"""Repair of conversations: the cheapest edits that make their turns alternate.

A repaired conversation is empty or an optional system turn followed by pairs
of user and assistant turns. A turn is kept (K), given another role (R) or
deleted (D), and turns without text are inserted (I); blank and repeated turns
must go, and keeping a truncated one has a price. Of equally cheap edits the
string of letters that is least in ASCII order is taken.

The search is a Viterbi over four states (nothing yet, after system, after
user, after assistant). Survivors share a tree of backpointers whose nodes count
their references: a survivor that loses frees its branch, and once all of them
share an ancestor the edits up to it are decided and leave the tree, so memory
follows what is undecided and not the length. Equally cheap survivors are
compared by their complete undecided suffixes; how these compare is carried
along from row to row, so nothing is read twice. One suffix can be the
beginning of another only if the rest are insertions, which is what is
remembered then.

A conversation may be of any length. Rows are sorted over the whole cluster, by
conversation and turn, and cut into blocks of bounded size. A conversation
inside one block is solved there. For the others each block yields the best
edits from every state to every state, and the same search runs over blocks
instead of rows. Only that, and the digest of a whole conversation, pass
through one task, as a stream.

Defined results: nulls of role and text are one space, which is a role that no
repaired conversation has. Null conversation ids are one conversation. Null
turns come first; rows of one turn are ordered by role and text in byte order.
Rows are one another's repeats if role and text are equal. Identical rows are
counted before they are sorted. A conversation without rows has empty results.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm.common import ready
from quayside.session import settle

# Contract values.
FAULTS = 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# A block ends at so many turns, or bytes of text.
BLOCK_ROWS = 4_096
BLOCK_BYTES = 1 << 20
# The search looks for decided edits every so many steps.
STRIDE = 64
# States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# Fixed value: pairs of role initials that may follow one another.
LEGAL = ("su", "ua", "au")
# Fixed value: what may stand after the last character of a text.
_WHITE = " \t\n\x0b\x0c\r"

Arc = tuple[int, int, int, str]


# -------------------------------------------------------------------- search


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """Where insertions lead from a state: (state, cost, letters)."""
    cost, letters, seen = 0, "", set()
    while state not in seen:
        yield state, cost, letters
        seen.add(state)
        state, cost, letters = _NEXT[state], cost + INSERT, letters + "I"


def row_arcs(initial: str, fault: str, run: int = 1) -> list[Arc]:
    """What may be done with a row, and inserted after it: (from, to, cost, letters), the best of each pair.

    ``fault`` is "blank", "duplicate", "truncated" or "". A ``run`` of rows that
    must go is one step: inserting inside of it is never the least string.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        moves = [(state, DELETE * run, "D" * run)]
        if fault in ("", "truncated"):
            price = TRUNCATED if fault else 0
            moves.append((_NEXT[state], REROLE + price, "R"))
            if (state, initial) in _KEPT:
                moves.append((_KEPT[state, initial], price, "K"))
        for reached, cost, letter in moves:
            for end, more, letters in _inserted(reached):
                found = (cost + more, letter + letters)
                best[state, end] = min(best.get((state, end), found), found)
    return [(p, q, cost, letters) for (p, q), (cost, letters) in best.items()]


START: list[Arc] = [(NOTHING, end, cost, letters) for end, cost, letters in _inserted(NOTHING)]


class _Node:
    __slots__ = ("parent", "arc", "refs")

    def __init__(self, parent: _Node | None, arc: tuple[int, str]):
        self.parent, self.arc, self.refs = parent, arc, 0


class Survivors:
    """The best edits to every state, with the undecided part of each in one tree."""

    def __init__(self, state: int):
        self.root = _Node(None, (state, ""))
        self.leaves = {state: self.root}
        self.costs = {state: 0}
        # How the complete strings of two survivors compare: (-1 or 1, 0), or (0, by how many insertions the second is longer).
        self.order: dict[tuple[int, int], tuple[int, int]] = {}
        self.steps = 0

    def _compared(self, p: int, x: str, q: int, y: str) -> tuple[int, int]:
        if p != q:
            sign, longer = self.order[p, q]
            if sign:
                return sign, 0
            if longer > 0:
                y = "I" * longer + y
            else:
                x = "I" * -longer + x
        if y.startswith(x) or x.startswith(y):
            return 0, len(y) - len(x)
        return (-1, 0) if x < y else (1, 0)

    def _less(self, p: int, x: str, q: int, y: str) -> bool:
        sign, longer = self._compared(p, x, q, y)
        return sign < 0 or sign == 0 and longer > 0

    def advance(self, arcs: Iterable[Arc]) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        costs = self.costs
        for p, q, cost, letters in arcs:
            if p in costs:
                cost += costs[p]
                held = best.get(q)
                if held is None or cost < held[0] or cost == held[0] and self._less(p, letters, held[1], held[2]):
                    best[q] = (cost, p, letters)
        if ASSISTANT in best:
            # What may follow the first two states may follow this one, if a system turn is deleted: whoever is dearer
            # by more than that has lost, and no longer holds the tree.
            paired = best[ASSISTANT][0]
            for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
                if state in best and best[state][0] > paired + more:
                    del best[state]
        states = sorted(best)
        order = {}
        for at, q in enumerate(states):
            for other in states[at + 1 :]:
                sign, longer = self._compared(best[q][1], best[q][2], best[other][1], best[other][2])
                order[q, other], order[other, q] = (sign, longer), (-sign, -longer)
        old = self.leaves
        self.leaves = {}
        for q in states:
            cost, p, letters = best[q]
            old[p].refs += 1
            self.leaves[q] = _Node(old[p], (p, letters))
        for leaf in old.values():
            self._release(leaf)
        self.costs = {q: best[q][0] for q in states}
        self.order = order
        self.steps += 1

    def _release(self, node: _Node) -> None:
        """Free a branch that no survivor stands on."""
        while node.refs == 0 and node is not self.root:
            node.parent.refs -= 1
            node = node.parent

    def decided(self) -> list[tuple[int, str]]:
        """The (state before, letters) of steps that all survivors share, which leave the tree."""
        chain = [next(iter(self.leaves.values()))]
        while chain[-1] is not self.root:
            chain.append(chain[-1].parent)
        out = []
        while len(chain) > 1 and chain[-1].refs == 1:
            chain.pop()
            self.root = chain[-1]
            self.root.parent = None
            out.append(self.root.arc)
        return out

    def finish(self, ends: Iterable[int]) -> tuple[int, list[tuple[int, str]]] | None:
        """Cost and undecided steps of the best survivor at one of the states."""
        best = None
        for state in ends:
            if state in self.costs and (
                best is None or self.costs[state] < self.costs[best]
                or self.costs[state] == self.costs[best] and self._less(state, "", best, "")
            ):
                best = state
        if best is None:
            return None
        steps, node = [], self.leaves[best]
        while node is not self.root:
            steps.append(node.arc)
            node = node.parent
        return self.costs[best], steps[::-1]


def solve(steps: list[list[Arc]], start: int, ends: Iterable[int]) -> list[Arc]:
    """The best way from ``start`` to each of the ``ends`` through all steps."""
    search, letters = Survivors(start), []
    for arcs in steps:
        search.advance(arcs)
        if search.steps % STRIDE == 0:
            letters.extend(part for _, part in search.decided())
    out = []
    for end in ends:
        if (found := search.finish([end])) is not None:
            out.append((start, end, found[0], "".join([*letters, *(part for _, part in found[1])])))
    return out


def edited(rows: Iterable[tuple[str, str]], letters: str, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what the letters make of (role, text) rows; deleted rows keep theirs, with edit D."""
    out, following = [], iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(following)
        if letter in "IR":
            state = _NEXT[state]
            role = _ROLES[state]
        elif letter == "K":
            state = _KEPT[state, role[:1]]
        out.append((letter, role, text))
    return out


# -------------------------------------------------------------------- blocks


class Block:
    """Consecutive rows of one conversation: their counts, steps and texts."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.steps: list[list[Arc]] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_initial = self.last_initial = self.min_turn = self.max_turn = None

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.size >= BLOCK_BYTES

    def add(self, turn: int | None, role: str, text: str, fault: str, run: int = 1) -> None:
        initial = role[:1]
        if fault:
            setattr(self, fault, getattr(self, fault) + run)
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += run - 1
        self.last_initial = initial
        if turn is not None and turn != self.max_turn:
            self.turns += 1
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
        self.rows.extend([(role, text)] * run)
        self.size += len(text) * run
        self.steps.append(row_arcs_of(initial if initial in "sua" else "", fault, run))


_ARCS: dict[tuple[str, str, int], list[Arc]] = {}


def row_arcs_of(initial: str, fault: str, run: int) -> list[Arc]:
    must_go = fault in ("blank", "duplicate")
    key = ("", "blank", run) if must_go else (initial, fault, run)
    if key not in _ARCS:
        if len(_ARCS) > 4_096:
            _ARCS.clear()
        _ARCS[key] = row_arcs(*key)
    return _ARCS[key]


_EDITED = "array<struct<edit: string, role: string, text: string>>"
_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, min_turn bigint, max_turn bigint, first_initial string, last_initial string"
_COUNT_NAMES = [part.split()[0] for part in _COUNTS.split(", ")]
_BLOCK = f"part int, block bigint, whole boolean, {_COUNTS}, cost bigint, audit string, arcs array<struct<p: int, q: int, cost: bigint, letters: string>>, rows {_EDITED}"
_TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_ARC = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
_BLOCK_ARROW = [
    ("part", pa.int32()), ("block", pa.int64()), ("whole", pa.bool_()),
    *((name, pa.string() if "initial" in name else pa.int64()) for name in _COUNT_NAMES),
    ("cost", pa.int64()), ("audit", pa.string()), ("arcs", pa.list_(_ARC)), ("rows", pa.list_(_TURN)),
]


def _units(run: int, text: str, block_rows: int) -> Iterator[int]:
    """Many copies in runs that fit into blocks."""
    most = max(1, min(block_rows, BLOCK_BYTES // max(len(text), 1)))
    while run > 0:
        yield min(run, most)
        run -= most


def _turns(rows: Iterable[tuple[str, str, str]]) -> list[dict]:
    return [{"edit": edit, "role": role, "text": text} for edit, role, text in rows]


def _block_row(conv, part: int, number: int, whole: bool, block: Block) -> dict:
    row = {"conv_id": conv, "part": part, "block": number, "whole": whole}
    row |= {name: getattr(block, name) for name in _COUNT_NAMES}
    if whole:
        # One of the two ends is always reached: deleting everything leads to the first.
        ways = solve([START, *block.steps], NOTHING, ENDS)
        _, _, row["cost"], row["audit"] = min(ways, key=lambda way: (way[2], way[3]))
        return row | {"rows": _turns(edited(block.rows, row["audit"], NOTHING)), "arcs": []}
    arcs = [arc for start in range(4) for arc in solve(block.steps, start, range(4))]
    return row | {"arcs": [dict(zip(("p", "q", "cost", "letters"), arc)) for arc in arcs],
                  "rows": _turns(("", role, text) for role, text in block.rows)}


def _same(a, b) -> bool:
    return a == b or (a is None and b is None)


def _blocks_of(rows: Iterator[tuple], part: int, block_rows: int) -> Iterator[dict]:
    """Blocks of sorted (conv_id, turn, role, text, present, copies, first) rows of one task.

    The first and the last conversation may go on in another task; only those
    between them, if they fit into a block, are known to be whole.
    """
    number, block, conv, inner = 0, None, None, False
    for key, turn, role, text, present, copies, first in rows:
        if block is None or not _same(key, conv):
            if block is not None:
                yield _block_row(conv, part, number, inner, block)
                number += 1
            inner = block is not None
            block, conv = Block(), key
        if not present:
            continue
        end = text.rstrip(_WHITE)[-1:]
        fault = "blank" if not end else "duplicate" if not first else "" if end in ".!?" else "truncated"
        runs = [(fault, run) for run in _units(copies, text, block_rows)]
        if fault in ("", "truncated"):
            # One row of its own, the others are its repeats.
            runs = [(fault, 1), *(("duplicate", run) for run in _units(copies - 1, text, block_rows))]
        for kind, run in runs:
            if block.full(block_rows):
                yield _block_row(conv, part, number, False, block)
                number += 1
                block, inner = Block(), False
            block.add(turn, role, text, kind, run)
    if block is not None:
        yield _block_row(conv, part, number, False, block)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 200, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= most or weight >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _weight(row: dict) -> int:
    return sum(len(turn["text"]) for turn in row["rows"])


# ----------------------------------------------------------------- operators


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows with faults made in some of them, by a hash of conversation and turn.

    Dropped rows stay as rows that are not ``present``, so that no conversation is lost.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % FAULTS
    known = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"), fault.alias("fault"),
    )
    empty = F.lit("")
    return known.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn",
        F.when(F.col("fault") == 0, empty).when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault").isin(0, 1), empty).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("present"),
    )


def _digest() -> Column:
    """One value per conversation, role and text; rows that are not there have another that nothing shares."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    whole = F.concat(F.length(conv).cast("string"), conv, F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    absent = F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    return F.when(F.col("present"), F.unhex(F.sha2(whole.cast("binary"), 256))).otherwise(F.unhex(F.md5(absent.cast("binary"))))


def counted_rows(rows: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, text, present) with ``copies``, and whether role and text are ``first`` met there.

    Only rows whose role and text are met again are joined and counted, by
    aggregates that combine before the shuffle.
    """
    keyed = rows.withColumn("digest", _digest())
    repeated = settle(
        keyed.filter("present").groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("without_turn"), F.min("turn").alias("first_turn")
        ).filter("n > 1"),
        "repeated-turns",
    )
    joined = keyed.join(repeated, "digest", "left")
    names = ["conv_id", "turn", "role", "text", "present"]
    first = F.when(F.col("without_turn"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    once = joined.filter("n IS NULL").select(*names, F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("first"))
    again = joined.filter("n IS NOT NULL").withColumn("first", first).groupBy(*names, "first").agg(F.count(F.lit(1)).alias("copies"))
    return once.unionByName(again)


def _solved_blocks(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Search over the blocks of conversations, sorted: the letters of every block and the state before it."""
    def chosen() -> Iterator[dict]:
        waiting: list[tuple[int, int]] = []
        done: list[tuple[int, str]] = []
        search = conv = None

        def placed(count: int) -> Iterator[dict]:
            for (part, block), (state, letters) in zip(waiting[:count], done[:count]):
                yield {"conv_id": conv, "part": part, "block": block, "state": state, "letters": letters, "total": None}
            del waiting[:count], done[:count]

        def begun(steps: list[tuple[int, str]]) -> None:
            # What is inserted before the first block belongs to it.
            nonlocal lead
            for state, letters in steps:
                if lead is None:
                    lead = letters
                else:
                    done.append((NOTHING if not counted[0] else state, lead + letters))
                    lead = ""
                    counted[0] += 1

        def closed() -> Iterator[dict]:
            cost, steps = search.finish(ENDS)
            begun(steps)
            rows = list(placed(len(waiting)))
            rows[-1]["total"] = cost
            yield from rows

        lead, counted = None, [0]
        for key, part, block, arcs in _rows_of(batches):
            if search is None or not _same(key, conv):
                if search is not None:
                    yield from closed()
                search, conv, lead, counted = Survivors(NOTHING), key, None, [0]
                search.advance(START)
            waiting.append((part, block))
            search.advance((a["p"], a["q"], a["cost"], a["letters"]) for a in arcs)
            if search.steps % STRIDE == 0:
                begun(search.decided())
                yield from placed(len(done))
        if search is not None:
            yield from closed()

    schema = pa.schema([("conv_id", key_type), ("part", pa.int32()), ("block", pa.int64()), ("state", pa.int32()),
                        ("letters", pa.string()), ("total", pa.int64())])
    return _batched(chosen(), schema)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired pieces of conversations, of bounded size: ``whole`` ones, and blocks of longer ones.

    ``rows`` is (conv_id, turn, role, text, present). Each piece has its counts,
    its ``audit`` letters and its turns as (edit, role, text), deleted ones
    among them; pieces of a conversation follow one another by (part, block).
    ``cost`` is that of the conversation, on its last piece.
    """
    ready(rows.sparkSession)
    key = rows.schema["conv_id"].dataType
    key_sql, key_arrow = key.simpleString(), _arrow_type(key)
    order = ["conv_id", "turn", "role", "text"]
    fields = ["conv_id", "turn", "role", "text", "present", "copies", "first"]
    ordered = counted_rows(rows).select(*fields).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", key_arrow), *_BLOCK_ARROW])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(_blocks_of(_rows_of(batches), TaskContext.get().partitionId(), block_rows), schema, size=_weight)

    blocks = settle(ordered.mapInArrow(cut, f"conv_id {key_sql}, {_BLOCK}"), "conversation-blocks")
    parts = blocks.filter("NOT whole")
    searched = (
        parts.select("conv_id", "part", "block", "arcs").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
        .mapInArrow(lambda batches: _solved_blocks(batches, key_arrow),
                    f"conv_id {key_sql}, part int, block bigint, state int, letters string, total bigint")
    )
    letters = settle(searched.drop("conv_id"), "block-edits")
    pieces = parts.drop("arcs", "audit", "cost").join(letters, ["part", "block"])
    columns = ["conv_id", "part", "block", "whole", *_COUNT_NAMES, "cost", "audit", "rows"]
    piece_arrow = pa.schema([field for field in schema if field.name in columns])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces_of() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    turns = edited(((turn["role"], turn["text"]) for turn in row["rows"]), row["letters"], row["state"])
                    yield {name: row.get(name) for name in columns} | {"cost": row["total"], "audit": row["letters"], "rows": _turns(turns)}

        return _batched(pieces_of(), piece_arrow, size=_weight)

    repaired = pieces.mapInArrow(edit, ", ".join([f"conv_id {key_sql}", *(p for p in [
        "part int", "block bigint", "whole boolean", _COUNTS, "cost bigint", "audit string", f"rows {_EDITED}"])]))
    return blocks.filter("whole").select(*columns).unionByName(repaired)


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT_ARROW = [(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in _RESULT.split(", ")]


def _joined(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its sorted pieces, read as a stream."""
    names = ("blank", "duplicate", "truncated", "illegal")

    def results() -> Iterator[dict]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or not _same(row["conv_id"], out["conv_id"]):
                    if out is not None:
                        yield closed(out)
                    out = {"conv_id": row["conv_id"], "hash": hashlib.sha256(), "texts": 0, "audit": [], "turns": 0, "cost": 0,
                           "last": None, "min": None, "max": None, **dict.fromkeys(names, 0)}
                for name in names:
                    out[name] += row[name]
                if out["last"] is not None and row["first_initial"] is not None and out["last"] + row["first_initial"] not in LEGAL:
                    out["illegal"] += 1
                out["last"] = out["last"] if row["last_initial"] is None else row["last_initial"]
                if row["min_turn"] is not None:
                    out["turns"] += row["turns"] - (row["min_turn"] == out["max"])
                    out["min"] = row["min_turn"] if out["min"] is None else out["min"]
                    out["max"] = row["max_turn"]
                out["audit"].append(row["audit"])
                out["cost"] += row["cost"] or 0
                for turn in row["rows"]:
                    if turn["edit"] != "D":
                        out["hash"].update(f"{chr(10) if out['texts'] else ''}{turn['role']}:{turn['text']}".encode())
                        out["texts"] += 1
        if out is not None:
            yield closed(out)

    def closed(out: dict) -> dict:
        gaps = 0 if out["min"] is None else out["max"] - out["min"] + 1 - out["turns"]
        return {"conv_id": out["conv_id"], "gaps": gaps, "cost": out["cost"], "audit": "".join(out["audit"]),
                "repaired_sha256": out["hash"].hexdigest(), **{name: out[name] for name in names}}

    return _batched(results(), pa.schema([("conv_id", key_type), *_RESULT_ARROW]))


def summary(pieces: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts of faults, cost, audit and the digest of its repaired ``role:text`` lines."""
    key = pieces.schema["conv_id"].dataType
    key_arrow = _arrow_type(key)
    lines = F.transform(F.filter("rows", lambda turn: turn["edit"] != "D"), lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    whole = pieces.filter("whole").select(
        "conv_id", F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    fields = ["conv_id", *_COUNT_NAMES, "cost", "audit", "rows"]
    longer = (
        pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select(*fields)
        .mapInArrow(lambda batches: _joined(batches, key_arrow), f"conv_id {key.simpleString()}, {_RESULT}")
    )
    return whole.unionByName(longer)
