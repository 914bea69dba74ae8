"""Repair of conversations by cheapest edits, found with an auction algorithm for shortest paths.

A conversation's turns, in order, are edited until their roles read ``(system)? (user assistant)+`` or nothing is left: keep a turn (0), give it
the other role (1), delete it (2; blank and repeated turns must go), insert an empty turn (5); a turn that breaks off and stays costs 5 more.
Nodes of the lattice are (turns done, state of the pattern), arcs are the edits, costs are integers.

The auction keeps a price for each node, never above the cost of an arc plus the price where it leads, and one path. The path's last node is
extended along its cheapest arc if its price equals what that costs; otherwise the price rises to it and the path contracts by one node. A path that
arrives is a shortest one, and the origin's price is its cost. Origins are the source and, on long lattices, the nodes of every sixteenth layer,
taken from the last one back, so that a run ends at a node whose price is already exact. All arcs of all shortest paths are tight under these prices
(price = cost + price ahead); the first tight path in the order of the edits' initials (D, I, K, R) is traced, leaving nodes from which no tight
path goes on. Equal sequences of turns have one lattice and are solved once by a task.

Scale. Turns are sorted by conversation over all tasks, so a conversation of any length can be spread over many. A conversation that lies within one
task and is short is finished there. Others are cut into pieces of at most 256 turns: every piece gives the costs between its four entry and four
exit states, these are chained from the last piece back to exit prices (16 numbers for a piece), and the pieces are then traced from the first
on with those prices. Equal turns of one number are one row with a count before anything is sorted, and what repeats an earlier turn is found by an
aggregation over digests. Only the last pass reads a conversation in one task, piece by piece: a sha256 has no parallel form.

Edge cases: rows are ordered by turn, nulls first, then by role and text. A null conv_id is a conversation of its own. Null roles and texts
count as one space. Rows of the same number, role and text repeat each other. A conversation without turns (all dropped) has zeros and an empty
audit. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import Scratch, table, tune

SPACE = " \t\n\v\f\r"
#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a new role or an inserted turn leads from each state.
TURN = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: What the edits cost.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: Price of each state after the last turn: the inserts that complete the pattern.
END = (0, 2 * INSERT, INSERT, 0)
STRIDE = 16
LEGAL = {"su", "ua", "au"}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = (*COUNTS, "audit", "repaired_sha256")


# ---- the auction ------------------------------------------------------------------------------


def lattice(codes: str, exits: tuple) -> list[list[tuple[str, float, int]]]:
    """Arcs (edit, cost, node) of every node ``4 * turns done + state``, edits in ASCII order; the last node is the target.

    ``codes`` has the role's initial for each turn that may stay (x: another role), in upper case if the turn breaks off.
    """
    n = len(codes)
    target = 4 * n + 4
    arcs: list[list[tuple[str, float, int]]] = []
    for i, code in enumerate(codes):
        broken = BROKEN if code.isupper() else 0
        for q in range(4):
            here = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + TURN[q])]
            if (to := KEEP.get((q, code.lower()))) is not None:
                here.append(("K", broken, 4 * i + 4 + to))
            here.append(("R", REROLE + broken, 4 * i + 4 + TURN[q]))
            arcs.append(here)
    arcs += [[("", exits[q], target)] if exits[q] < inf else [] for q in range(4)]
    arcs.append([])
    return arcs


def auction(arcs: list, price: list, exact: set[int], origin: int, bound: float) -> float:
    """Extends and contracts a path from ``origin`` until it meets an exact node; ``inf`` if the prices show that it cannot."""
    path = [origin]
    while (at := path[-1]) not in exact:
        best, to = inf, -1
        for _, cost, node in arcs[at]:
            if cost + price[node] < best:
                best, to = cost + price[node], node
        if best > bound:
            best = inf
        if price[at] < best:  # contraction
            price[at] = best
            if at != origin:
                path.pop()
        elif to < 0 or best == inf:
            return inf
        else:  # extension
            path.append(to)
    exact.update(path)
    return price[origin]


def prices(codes: str, exits: tuple, entries: tuple[int, ...]) -> tuple[list, list]:
    """The lattice and its prices, exact on every shortest path from the entry states."""
    arcs = lattice(codes, exits)
    price = [0] * len(arcs)
    exact = {len(arcs) - 1}
    bound = DELETE * len(codes) + 2 * INSERT + max(e for e in exits if e < inf)
    for layer in range((len(codes) - 1) // STRIDE * STRIDE, 0, -STRIDE):
        for q in range(4):
            auction(arcs, price, exact, 4 * layer + q, bound)
    for q in entries:
        auction(arcs, price, exact, q, bound)
    return arcs, price


def trace(arcs: list, price: list, entry: int) -> tuple[str, int]:
    """Edits of the first tight path from the entry state to the target, and the state in which it leaves."""
    target = len(arcs) - 1
    path, edits, dead = [entry], [], set()
    while path[-1] != target:
        at = path[-1]
        for edit, cost, node in arcs[at]:
            if node not in dead and price[at] == cost + price[node]:
                path.append(node)
                edits.append(edit)
                break
        else:
            dead.add(path.pop())
            edits.pop()
    return "".join(edits), path[-2] % 4


@lru_cache(maxsize=1 << 16)
def solve(codes: str, exits: tuple = END, entry: int = START) -> tuple[int, str, int]:
    """Cost, edits and last state of the cheapest path, of equal ones the first by its edits."""
    arcs, price = prices(codes, exits, (entry,))
    edits, last = trace(arcs, price, entry)
    return price[entry], edits, last


@lru_cache(maxsize=1 << 12)
def transfer(codes: str) -> tuple:
    """Costs from each entry state to each exit state, by entry."""
    by_exit = []
    for q in range(4):
        price = prices(codes, tuple(0 if r == q else inf for r in range(4)), (START, SYSTEM, USER, ASSISTANT))[1]
        by_exit.append(price[:4])
    return tuple(by_exit[r][q] for q in range(4) for r in range(4))


# ---- turns ------------------------------------------------------------------------------------


@dataclass
class Piece:
    """Consecutive turns: role, text, how many times in a row, and whether the first of these may stay."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)

    def add(self, role: str, text: str, times: int, turn: int | None) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.times.append(times)
        self.turns.append(turn)

    def kinds(self, again: set[int] | None = None) -> list[str]:
        """blank, duplicate, truncated or fine, for the first of each row; ``again``: rows known to repeat another piece's."""
        seen: set[tuple[str, str]] = set()
        out = []
        for k, (role, text) in enumerate(zip(self.roles, self.texts, strict=True)):
            bare = text.rstrip(SPACE)
            if not bare:
                out.append("blank")
            elif (role, text) in seen or (again and k in again):
                out.append("duplicate")
            else:
                out.append("fine" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        return out

    def codes(self, kinds: list[str]) -> str:
        first = lambda role: role[:1] if role[:1] in ("s", "u", "a") else "x"
        return "".join(first(r).upper() if k == "truncated" else first(r) for r, k in zip(self.roles, kinds, strict=True) if k in ("fine", "truncated"))


class Report:
    """What a conversation's pieces add up to, in order."""

    def __init__(self, lines: bool):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.lines: list[dict] | None = [] if lines else None
        self.written = False
        self.least = self.most = self.turn = None
        self.distinct = 0
        self.initial: str | None = None
        self.state = START

    def add(self, piece: Piece, kinds: list[str], edits: str) -> None:
        forced = 0
        at = 0
        for role, text, times, turn, kind in zip(piece.roles, piece.texts, piece.times, piece.turns, kinds, strict=True):
            self._turn(turn)
            if self.initial is not None and self.initial + role[:1] not in LEGAL:
                self.counts["illegal"] += 1
            self.initial = role[:1]
            self.counts["illegal"] += times - 1
            if kind != "fine":
                self.counts[kind] += times if kind in ("blank", "duplicate") else 1
            if kind in ("blank", "duplicate"):
                self.audit.append("D" * times)
                forced += times
                continue
            self.counts["duplicate"] += times - 1
            while edits[at] == "I":
                self._insert()
                at += 1
            edit = edits[at]
            at += 1
            if edit == "K":
                self.state = KEEP[self.state, role[:1]]
                self._line("K", role, text)
            elif edit == "R":
                self.state = TURN[self.state]
                self._line("R", NAME[self.state], text)
            self.audit.append(edit + "D" * (times - 1))
            forced += times - 1
        self.counts["cost"] += DELETE * forced

    def _turn(self, turn: int | None) -> None:
        if turn is not None:
            self.distinct += turn != self.turn
            self.turn = self.most = turn
            self.least = turn if self.least is None else self.least

    def _insert(self) -> None:
        self.state = TURN[self.state]
        self.audit.append("I")
        self._line("I", NAME[self.state], "")

    def _line(self, edit: str, role: str, text: str) -> None:
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written = True
        if self.lines is not None:
            self.lines.append({"edit": edit, "role": role, "text": text})

    def end(self) -> tuple:
        self.counts["cost"] += END[self.state]
        for _ in range(END[self.state] // INSERT):
            self._insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (gaps, *self.counts.values(), "".join(self.audit), self.hash.hexdigest())


# ---- over a table -----------------------------------------------------------------------------


@dataclass(frozen=True)
class RepairConfig:
    #: Turns and characters of a piece; a longer text is a piece of its own.
    piece: int = 256
    chars: int = 1 << 16


_STRINGS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())
_PIECE = {"roles": _STRINGS, "texts": _STRINGS, "times": _LONGS, "turns": _LONGS}
_RESULT = {**dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
_LINES = {"lines": pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))}
_DDL = {
    pa.int32(): "int", pa.int64(): "long", pa.string(): "string", _STRINGS: "array<string>", _LONGS: "array<long>",
    pa.list_(pa.binary()): "array<binary>", _LINES["lines"]: "array<struct<edit: string, role: string, text: string>>",
}


def _ddl(kind: str, columns: dict[str, pa.DataType]) -> str:
    return ", ".join(["cid string", f"conv_id {kind}", *(f"{c} {_DDL[t]}" for c, t in columns.items())])


def _batches(rows: Iterator[tuple], kind: pa.DataType, columns: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, conv_id, *columns) in batches."""
    types = {"cid": pa.string(), "conv_id": kind, **columns}
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _named(conv_id: Column) -> Column:
    """An id that null has a value of."""
    return F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def pieces(turns: DataFrame, cfg: RepairConfig, lines: bool) -> DataFrame:
    """Results of conversations that lie within a task and a piece; of all others their pieces (``pid``, ``no``: their order), without a result."""
    columns = {"pid": pa.int32(), "no": pa.int64(), **_PIECE, "keys": pa.list_(pa.binary()), **_RESULT, **_LINES}

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        pid, no = TaskContext.get().partitionId(), 0
        now, opened, piece, width = None, True, Piece(), 0  # the first conversation of a task may have begun in another one

        def out(more: bool) -> tuple:
            kinds = piece.kinds()
            if opened or more:
                keys = [_digest(r, t) if k in ("fine", "truncated") else None for r, t, k in zip(piece.roles, piece.texts, kinds, strict=True)]
                return (*now, pid, no, piece.roles, piece.texts, piece.times, piece.turns, keys, *[None] * 9)
            report = Report(lines)
            cost, edits, last = solve(piece.codes(kinds))
            report.counts["cost"] += cost - END[last]
            report.add(piece, kinds, edits)
            return (*now, *[None] * 7, *report.end(), report.lines)

        for cid, conv_id, turn, role, text, times in rows:
            if now is None or cid != now[0]:
                if now is not None:
                    yield out(False)
                    opened, no = False, no + 1
                now, piece, width = (cid, conv_id), Piece(), 0
            elif piece.roles and (len(piece.roles) >= cfg.piece or width + len(text) > cfg.chars):
                yield out(True)
                opened, no, piece, width = True, no + 1, Piece(), 0
            if times:
                piece.add(role, text, times, turn)
                width += len(text)
        if now is not None:
            yield out(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            yield from _batches(read(_each(chain([first], batches))), first.schema.field("conv_id").type, columns)

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(_named(F.col("conv_id")).alias("cid"), "conv_id", "turn", "role", "text", "times")
    order = ["cid", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ddl(kind, columns))


def joined(open_: DataFrame, lines: bool, scratch: Scratch) -> DataFrame:
    """Results of conversations that come in pieces."""
    at = ["cid", "pid", "no"]
    spread = open_.select(*at, F.posexplode("keys").alias("row", "key")).where("key is not null")
    first = spread.groupBy("cid", "key").agg(F.min(F.struct("pid", "no")).alias("first"))
    again = spread.join(first, ["cid", "key"]).where(F.struct("pid", "no") > F.col("first")).groupBy(*at).agg(F.collect_list("row").alias("again"))  # at most the rows of a piece
    known = scratch.write(open_.select("cid", "conv_id", "pid", "no", *_PIECE).join(again, at, "left"), "pieces")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for r in rows:
                p = Piece(r["roles"], r["texts"], r["times"], r["turns"])
                found.append(transfer(p.codes(p.kinds(set(r["again"] or ())))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(found, pa.list_(pa.float64()))], names=[*at, "costs"])

    moves = scratch.write(known.select(*at, "roles", "texts", "times", "turns", "again").mapInArrow(costs, "cid string, pid int, no long, costs array<double>"), "costs")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, price = None, END
        for batch in batches:
            exits = []
            for cid, m in zip(batch.column("cid").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                if cid != now:
                    now, price = cid, END
                exits.append(price)
                price = tuple(min(m[4 * q + r] + price[r] for r in range(4)) for q in range(4))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(exits, pa.list_(pa.float64()))], names=[*at, "exits"])

    ahead = moves.repartition("cid").sortWithinPartitions("cid", F.desc("pid"), F.desc("no")).mapInArrow(back, "cid string, pid int, no long, exits array<double>")
    columns = {**_RESULT, **_LINES}

    def follow(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, report = None, Report(lines)

        def end() -> tuple:
            last = report.end()
            return (*now, *last, report.lines)

        for cid, conv_id, roles, texts, times, turns, again, exits in rows:
            if now is None or cid != now[0]:
                if now is not None:
                    yield end()
                now, report = (cid, conv_id), Report(lines)
            piece = Piece(roles, texts, times, turns)
            kinds = piece.kinds(set(again or ()))
            cost, edits, last = solve(piece.codes(kinds), tuple(exits), report.state)
            report.counts["cost"] += int(cost - exits[last])
            report.add(piece, kinds, edits)
            if report.lines:
                yield (*now, *[None] * len(_RESULT), report.lines)
                report.lines = []
        if now is not None:
            yield end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            yield from _batches(follow(_each(chain([first], batches))), first.schema.field("conv_id").type, columns)

    rows = known.join(ahead, at).repartition("cid").sortWithinPartitions(*at)
    kind = open_.schema["conv_id"].dataType.simpleString()
    return rows.select("cid", "conv_id", *_PIECE, "again", "exits").mapInArrow(run, _ddl(kind, columns))


def repair(turns: DataFrame, cfg: RepairConfig = RepairConfig(), lines: bool = False) -> DataFrame:
    """One row by conversation with ``RESULT``; with ``lines`` also the repaired turns (edit, role, text), which a long conversation has in
    several rows, the last of them with the result. ``turns``: conv_id, turn, role, text, and ``times`` (0: the turn is lost) if it has it.
    """
    tune(turns.sparkSession)
    scratch = Scratch(turns.sparkSession)
    times = F.col("times").cast("long") if "times" in turns.columns else F.lit(1).cast("long")
    text = lambda c: F.when(times > 0, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    plain = turns.select("conv_id", F.when(times > 0, F.col("turn").cast("long")).alias("turn"), text("role").alias("role"), text("text").alias("text"), times.alias("times"))
    once = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    read = scratch.write(pieces(once, cfg, lines), "read")
    columns = ["conv_id", *RESULT, *(["lines"] if lines else [])]
    both = read.where("audit is not null").select(*columns)
    return both.unionByName(joined(read.where("audit is null"), lines, scratch).select(*columns))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults by the crc32 of ``conv_id:turn``, modulo 20: a lost turn, an empty text, a text without its ``.!?``, a turn said twice, another role."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times")
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
