"""Cheapest repair of conversations whose roles are out of order, by a Viterbi search whose survivors coalesce.

A conversation's rows are edited until the initials of their roles read ``(s?(ua)+)?``. The state after a row is what the roles
kept so far end in: nothing, a system row, a user row or an assistant row. From each of them only one of user and assistant
may follow, so that the letters of the edits determine the state they lead to. Each state has one survivor, the cheapest path
to it and of these the one whose letters come first. Paths are a tree of back pointers: a node counts its children and the
survivor that ends in it, goes when it has neither, and once the root has one child that edit is certain and is emitted. Tied paths are compared over their
complete letters since they parted; that is kept up for each pair of survivors, step by step, so that a tie costs no walk up the tree.

A task reads rows clustered by conversation and sorted, and holds one conversation's unresolved edits. Rows that every survivor deletes
wait without their text, and a run of them is one node. What is unresolved is a few rows, but where each row needs a new role (a long run of system rows)
two ways to alternate stay open until the run ends, and its texts wait. A conversation is read by one task, for its audit and its digest are one sequence; memory does not grow with it but for the letters.

Defined results: a null role or text is one space; rows of a conversation are ordered by turn (nulls first), then role, then text; rows that
repeat are duplicates; conversations of a null id are one; a text of white space alone is blank; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import chunks

BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDED = r"(?s)[.!?][\x20\x09-\x0D]*\z"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: For a state, the state after the one role of user and assistant that may follow.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Ways to a state by inserted rows: (from, letters).
WAYS = {
    NOTHING: [(NOTHING, "")],
    SYSTEM: [(SYSTEM, "")],
    USER: [(USER, ""), (NOTHING, "I"), (SYSTEM, "I"), (ASSISTANT, "I")],
    ASSISTANT: [(ASSISTANT, ""), (USER, "I"), (NOTHING, "II"), (SYSTEM, "II")],
}
INSERTED = {state: [(a, letters, INSERT * len(letters)) for a, letters in ways] for state, ways in WAYS.items()}
LEGAL = {"su", "ua", "au"}
DIGESTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BATCH = 1000


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str | None
    fault: str | None


class Node:
    """An edit on the way of one survivor or more, or a run of deletions; ``held`` if a survivor ends in it."""

    __slots__ = ("parent", "children", "held", "letter", "role", "rows")

    def __init__(self, parent: "Node | None", letter: str, role: str | None, rows: list):
        self.parent, self.letter, self.role, self.rows = parent, letter, role, rows
        self.children: list[Node] = []
        self.held = 0
        if parent is not None:
            parent.children.append(self)


def parted(x: str, y: str) -> tuple[str, str]:
    """What two texts have after their common start; the first letters alone if both go on."""
    k = 0
    while k < len(x) and k < len(y) and x[k] == y[k]:
        k += 1
    return (x[k : k + 1], y[k : k + 1]) if k < len(x) and k < len(y) else (x[k:], y[k:])


class Survivors:
    """The search over one conversation. ``step`` takes a row and yields the edits that have become certain: (letter, role, row)."""

    def __init__(self):
        self.root = Node(None, "", None, [])
        self.cost = {NOTHING: 0}
        self.tip = {NOTHING: self.root}
        self.root.held = 1
        self.order: dict[tuple[int, int], tuple[str, str]] = {}
        self._choose(INSERTED, None)

    def _relation(self, a: int, x: str, b: int, y: str) -> tuple[str, str]:
        """What two paths have after they part: those to the states a and b, with letters x and y added."""
        if a == b:
            return parted(x, y)
        before = self.order[a, b]
        return parted(before[0] + x, before[1] + y)

    def _choose(self, ways: dict[int, list[tuple[int, str, int]]], row: Row | None) -> None:
        """Takes the best of the ways (state before, letters, cost) to each state."""
        best: dict[int, tuple[int, str, int]] = {}
        for state, several in ways.items():
            for a, letters, cost in several:
                if a in self.cost:
                    cost += self.cost[a]
                    was = best.get(state)
                    if was is None or cost < was[2] or cost == was[2] and self._before(a, letters, was):
                        best[state] = (a, letters, cost)
        order, tips, made = {}, {}, {}
        for s, t in itertools.combinations(best, 2):
            x, y = self._relation(*best[s][:2], *best[t][:2])
            order[s, t], order[t, s] = (x, y), (y, x)
        for state, (a, letters, _) in best.items():
            node, at = self.tip[a], a
            for letter in letters:
                if letter == "I":
                    at = NEXT[at]
                    if (node, "I") not in made:
                        made[node, "I"] = Node(node, "I", ROLES[at], [])
                    node = made[node, "I"]
                elif letter == "D" and row.text is None and node.letter == "D" and node.held == 1 and not node.children and node is not self.root and node.rows[0].text is None:
                    node.rows.append(row)  # this survivor's own run of deletions goes on
                else:
                    node = Node(node, letter, ROLES[state] if letter == "R" else None, [row])
            tips[state] = node
        for node in tips.values():
            node.held += 1
        old, self.tip, self.order, self.cost = self.tip, tips, order, {s: b[2] for s, b in best.items()}
        for node in old.values():
            node.held -= 1
            self._drop(node)

    def _before(self, a: int, letters: str, was: tuple[int, str, int]) -> bool:
        x, y = self._relation(a, letters, was[0], was[1])
        return x < y

    def _drop(self, node: Node) -> None:
        while node is not self.root and not node.held and not node.children and node.parent is not None:
            node.parent.children.remove(node)
            node = node.parent

    def _leave(self, state: int) -> None:
        node = self.tip.pop(state)
        del self.cost[state]
        node.held -= 1
        self._drop(node)

    def step(self, row: Row, forced: bool) -> Iterator[tuple]:
        ways: dict[int, list] = {}
        stays = TRUNCATED if row.fault == "truncated" else 0
        for a in self.cost:
            ways.setdefault(a, []).append((a, "D", DELETE))
            if not forced:
                kept = KEPT.get((a, row.role[:1]))
                if kept is not None:
                    ways.setdefault(kept, []).append((a, "K", stays))
                if kept != NEXT[a]:
                    ways.setdefault(NEXT[a], []).append((a, "R", REROLE + stays))
        self._choose(ways, row)
        self._choose(INSERTED, None)
        # what may follow a system row can follow an assistant row for as much, and what may follow nothing for one deletion more
        done = self.cost.get(ASSISTANT)
        if SYSTEM in self.cost and done is not None:
            x, y = self.order[ASSISTANT, SYSTEM]
            if (done, x) < (self.cost[SYSTEM], y):
                self._leave(SYSTEM)
        if NOTHING in self.cost and done is not None and self.cost[NOTHING] > done + DELETE:
            self._leave(NOTHING)
        return self._certain()

    def _certain(self) -> Iterator[tuple]:
        while len(self.root.children) == 1 and not self.root.held:
            self.root = self.root.children[0]
            self.root.parent = None
            for row in self.root.rows or [None]:
                yield self.root.letter, self.root.role, row
            self.root.rows = []

    def finish(self) -> tuple[int, list[tuple]]:
        """The cost of the cheapest repair, and the edits that were not certain before."""
        ends = [s for s in (ASSISTANT, NOTHING) if s in self.cost]
        best = ends[0]
        for s in ends[1:]:
            x, y = self.order[s, best]
            if (self.cost[s], x) < (self.cost[best], y):
                best = s
        for s in list(self.cost):
            if s != best:
                self._leave(s)
        cost, last = self.cost[best], self.tip[best]
        last.held = 0
        return cost, list(self._certain())


def _ordered(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """_conv, _turn, _role, _text, _fault of all rows, each conversation in one partition and in order, by one shuffle."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = rows.select(conv.alias("_conv"), turn.cast("long").alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text")).repartition("_conv")
    place = F.row_number().over(Window.partitionBy("_conv", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first()))
    fault = F.when(F.col("_text").rlike(BLANK), "blank").when(F.col("_place") > 1, "duplicate").when(~F.col("_text").rlike(ENDED), "truncated")
    marked = rows.withColumn("_place", place).select("_conv", "_turn", "_role", "_text", fault.alias("_fault"))
    # of rows that are all alike the first is the one that is no duplicate
    return marked.sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text", F.col("_fault") == "duplicate")


def conversations(batches) -> Iterator[tuple]:
    """(conv_id, rows) of sorted batches, one after the other; a conversation's rows are to be read before the next."""
    listed = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
    for conv, own in itertools.groupby(listed, key=lambda r: r[0]):
        yield conv, (Row(*r[1:]) for r in own)


def edits(rows) -> Iterator[tuple]:
    """(letter, new role, row) of the cheapest repair in order, each as soon as it is certain; then None, None and the cost."""
    search = Survivors()
    for row in rows:
        forced = row.fault in ("blank", "duplicate")
        yield from search.step(row._replace(text=None) if forced else row, forced)
    cost, rest = search.finish()
    yield from rest
    yield None, None, cost


def _digest(conv, rows) -> tuple:
    turns, last, low, high = 0, object(), None, None
    faults = {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
    illegal, before = 0, None

    def noted():
        nonlocal turns, last, low, high, illegal, before
        for row in rows:
            turn, initial = row.turn, row.role[:1]
            if turn is not None:
                low, high = turn if low is None else low, turn
                turns += turn != last
                last = turn
            faults[row.fault] += 1
            illegal += before is not None and before + initial not in LEGAL
            before = initial
            yield row

    sha, audit, first, cost = hashlib.sha256(), bytearray(), True, 0
    for letter, role, row in edits(noted()):
        if letter is None:
            cost = row
            continue
        audit += letter.encode()
        if letter != "D":
            line = f"{role}:" if row is None else f"{role or row.role}:{row.text}"
            sha.update((line if first else "\n" + line).encode())
            first = False
    gaps = high - low + 1 - turns if low is not None else 0
    return conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit.decode(), sha.hexdigest()


def _batched(records, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    records = iter(records)
    while held := list(itertools.islice(records, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _over(rows: DataFrame, names: tuple[str, str, str, str], ddl: str, records) -> DataFrame:
    """What ``records`` makes of the conversations of sorted rows, as a table of conv_id and the columns of ``ddl``."""
    ordered = _ordered(rows, *[F.col(c) for c in names])
    out = StructType([StructField("conv_id", ordered.schema["_conv"].dataType), *StructType.fromDDL(ddl).fields])
    schema = to_arrow_schema(out)
    return ordered.mapInArrow(lambda batches: _batched(records(conversations(chunks(batches, 3))), schema), out)


def _repaired(found) -> Iterator[tuple]:
    for conv, own in found:
        place = 0
        for letter, role, row in edits(own):
            if letter == "D":
                yield conv, None, letter, row.fault, row.turn, row.role, None
            elif letter is not None:
                place += 1
                yield (conv, place, letter, None, None, role, "") if row is None else (conv, place, letter, row.fault, row.turn, role or row.role, row.text)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits in order: conv_id, place (from 1, among what stays; null for a deleted row), edit, fault, turn, role and text (null if deleted)."""
    return _over(rows, (conv, turn, role, text), "place long, edit string, fault string, turn long, role string, text string", _repaired)


def repair_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its faults, the cost and letters of its repair, and a digest of the repaired rows."""
    return _over(rows, (conv, turn, role, text), DIGESTS, lambda found: itertools.starmap(_digest, found))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by a checksum of their keys: one in twenty each is dropped, emptied, cut, repeated or made the user's."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(key("text"), "[.!?]", "")).otherwise(key("text"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(key("role")).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """Digests of every conversation after damage; those without rows have zeros, no letters and the digest of nothing."""
    rows = rows.select("conv_id", "turn", "role", "text")
    found = repair_digests(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return out.select("conv_id", *[F.coalesce(F.col(f.name), none.get(f.name, F.lit(0).cast("long"))).alias(f.name) for f in StructType.fromDDL(DIGESTS)])
