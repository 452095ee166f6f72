"""Conversation structure repair: the cheapest edits that bring a conversation's turns into order.

The roles' initials of a repaired conversation match ``(s?(ua)+)?``. The edit lattice has a node for each
(turn index, state of that grammar), and is never written down: Dijkstra's search expands a node when it is
popped, with (cost, audit) as its key, and stops at the first accepting node behind the last turn. An audit
names the edits by their initials: Keep (0), Rerole to user or assistant (2), Delete (3; the only edit for
a blank or duplicate turn), Insert an empty turn of user or assistant (2). A truncated turn that is not
deleted adds 1. A longer audit costs more, so that keys only grow along a path and the search is exact.

Turns meet by conversation twice. `audits` shuffles a few bytes a turn and searches; `repaired` streams whole
texts past their audit, so that no task ever holds the texts of a conversation. A task holds of one
conversation at a time: 16 bytes for each distinct turn, and the search's nodes, about 1 KB a turn.

Defined results: rows are taken by turn, null first; of the same turn by role, then by the MD5 of role and
text. A null role or text is one space (a text without a character is blank). A null conv_id is a
conversation of its own. Roles are judged by their first character; one that is empty or any other than s,
u, a can be reroled or deleted only. A conversation all of whose rows are lost has zeros, an empty
audit and no turns. Columns other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

# White space, ends of sentences, costs of edits.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

FINE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn with this initial, by the state before; -1: not allowed.
NEXT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
ALLOWED = {"su", "ua", "au"}
BLOCK = 64


def turn_after(state: int) -> tuple[str, int]:
    """The role that may follow a state, of user and assistant, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


class _Block:
    """A full block of an audit, with the blocks before it. Equal audits share their blocks, so that blocks
    compare by identity; `jump` leads to a farther forebear, so that a common one is found in few steps."""

    __slots__ = ("parent", "text", "depth", "jump", "kids")

    def __init__(self, parent: _Block | None, text: str) -> None:
        self.parent, self.text, self.kids = parent, text, {}
        self.depth = parent.depth + 1 if parent else 0
        if parent is None:
            self.jump = self
        else:
            far = parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def after(self, depth: int) -> _Block:
        """The forebear, or the block itself, that is `depth` + 1 blocks deep."""
        at = self
        while at.depth > depth + 1:
            at = at.jump if at.jump.depth > depth else at.parent
        return at


class Trail:
    """An audit that grows by one letter without being copied; trails are ordered as their texts."""

    __slots__ = ("block", "tail")

    def __init__(self, block: _Block, tail: str) -> None:
        self.block, self.tail = block, tail

    @classmethod
    def empty(cls) -> Trail:
        return cls(_Block(None, ""), "")

    def then(self, letter: str) -> Trail:
        tail = self.tail + letter
        if len(tail) < BLOCK:
            return Trail(self.block, tail)
        full = self.block.kids.get(tail)
        if full is None:
            full = self.block.kids[tail] = _Block(self.block, tail)
        return Trail(full, "")

    def __lt__(self, other: Trail) -> bool:
        a, b = self.block, other.block
        if a is b:
            return self.tail < other.tail
        if a.depth > b.depth:
            below = a.after(b.depth)
            if below.parent is b:
                return below.text < other.tail
            a = below.parent
        elif b.depth > a.depth:
            below = b.after(a.depth)
            if below.parent is a:
                return self.tail < below.text
            b = below.parent
        while a.parent is not b.parent:
            a, b = (a.parent, b.parent) if a.jump is b.jump else (a.jump, b.jump)
        return a.text < b.text

    def text(self) -> str:
        parts, at = [self.tail], self.block
        while at.parent is not None:
            parts.append(at.text)
            at = at.parent
        return "".join(reversed(parts))


def cheapest(initials: list[str], faults: bytes | list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equal ones the first in ASCII order."""
    n = len(initials)
    heap = [(0, Trail.empty(), 0)]
    done = bytearray(4 * (n + 1))
    least: dict[int, int] = {0: 0}

    def reach(node: int, cost: int, trail: Trail, letter: str) -> None:
        if not done[node] and cost <= least.get(node, cost):
            least[node] = cost
            heapq.heappush(heap, (cost, trail.then(letter), node))

    while heap:
        cost, trail, node = heapq.heappop(heap)
        if done[node]:
            continue
        done[node] = 1
        i, state = divmod(node, 4)
        if i == n and state in (START, ASSISTANT):
            return cost, trail.text()
        wanted = turn_after(state)[1]
        reach(4 * i + wanted, cost + INSERT, trail, "I")
        if i == n:
            continue
        reach(node + 4, cost + DELETE, trail, "D")
        fault = faults[i]
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED if fault == CUT else 0
        kept = NEXT[initials[i]][state] if initials[i] in NEXT else -1
        if kept >= 0:
            reach(4 * (i + 1) + kept, cost + more, trail, "K")
        reach(4 * (i + 1) + wanted, cost + REROLE + more, trail, "R")
    raise AssertionError("all turns can be deleted")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of rows that are damaged by crc32 of `conv_id:turn` mod 20.

    0 loses the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user. n is
    how often the row stands then. Nulls are one space, but conv_id and turn keep theirs as columns.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("k"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"),
    )


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, mark (MD5 of role and text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.col("n").cast("int") if "n" in conversations.columns else F.lit(1)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), n.alias("n"))
    return rows.withColumn("mark", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))))


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conversation.

    conversations: conv_id, turn, role, text, and n if rows may stand more than once or, with n = 0, be lost:
    such a row makes its conversation known and is no turn of it.
    """
    small_batches(conversations.sparkSession)
    rows = _rows(conversations)
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(last == "", BLANK).when(~F.right(last, F.lit(1)).isin(*ENDS), CUT).otherwise(FINE)
    light = rows.select("conv_id", "turn", "role", "mark", fault.alias("fault"), "n")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held, key_type = None, None, None

        def close() -> None:
            initials, faults, turns, illegal = held["initials"], held["faults"], held["turns"], held["illegal"]
            cost, audit = cheapest(initials, faults)
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            out.append((key, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost, audit))

        for b in batches:
            key_type = b.column(0).type
            for conv, turn, role, mark, bad, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or conv != key:
                    if held is not None:
                        close()
                    key, held = conv, {"initials": [], "faults": bytearray(), "turns": None, "illegal": 0, "seen": set()}
                for _ in range(n):
                    first = role[:1]
                    if held["initials"] and held["initials"][-1] + first not in ALLOWED:
                        held["illegal"] += 1
                    held["initials"].append(first)
                    held["faults"].append(bad if bad == BLANK else DUPLICATE if mark in held["seen"] else bad)
                    held["seen"].add(mark)
                    if turn is not None:
                        t = held["turns"]
                        held["turns"] = (turn, turn, 1) if t is None else (t[0], turn, t[2] + (turn != t[1]))
            if out:
                yield _batch(out, key_type)
                out.clear()
        if held is not None:
            close()
            yield _batch(out, key_type)
        give_back()

    order = ["conv_id", "turn", "role", "mark"]
    return light.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(search, f"conv_id {kind}, {FOUND}")


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    cols = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string())], names)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that an audit makes of rows (role, text); each row is read when its turn comes."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[role[:1]][state]
        else:
            role, state = turn_after(state)
        yield role, text


def _streamed(conversations: DataFrame, found: DataFrame, each, schema: str) -> DataFrame:
    """each(head, turns) -> rows of `schema`, for every conversation: head is its row of `audits`, turns its repaired turns in order.

    A head sorts before its turns, which stream past it; `each` must read all turns.
    """
    small_batches(conversations.sparkSession)
    heads = found.select("conv_id", F.lit(0).alias("place"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("mark", "binary"), ("text", "string"))), F.lit(0).alias("n"), F.struct(*found.columns[1:]).alias("head"))
    body = _rows(conversations).where("n > 0").select("conv_id", F.lit(1).alias("place"), "turn", "role", "mark", "text", "n", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    names = [f.split()[0] for f in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _lines(batches)
        types: list[pa.DataType] = []

        def arrow(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        at = next(flat, None)
        out: list[tuple] = []
        size = 0
        while at is not None:
            types = types or [at[0], *map(_arrow_type, schema.split(", ")[1:])]
            head = {"conv_id": at[1], **at[6]}
            following: list = [None]

            def turns() -> Iterator[tuple[str, str]]:
                for row in flat:
                    if row[6] is not None:
                        following[0] = row
                        return
                    for _ in range(row[5]):
                        yield row[3], row[4]

            rest = turns()
            for row in each(head, edited(head["audit"], rest)):
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if size > 4 << 20 or len(out) >= 1000:
                    yield arrow(out)
                    out, size = [], 0
            for _ in rest:
                raise RuntimeError("turns that the audit does not know")
            at = following[0]
        if out:
            yield arrow(out)
        give_back()

    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "place", "turn", "role", "mark")
    return both.select("conv_id", "place", "turn", "role", "text", "n", "head").mapInArrow(stream, schema)


def _arrow_type(field: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string()}[field.split()[1]]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        kind = b.column(0).type
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield (kind, row[0], row[2], row[3], row[4], row[5], row[6])


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """conv_id, place, role, text: the turns of every repaired conversation, places from 0. `found`: its `audits`, if they are kept."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def rows(head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        for i, (role, text) in enumerate(turns):
            yield head["conv_id"], i, role, text

    return _streamed(conversations, audits(conversations) if found is None else found, rows, f"conv_id {kind}, place long, role string, text string")


def digests(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The columns of `audits`, and repaired_sha256 of the repaired turns as `role:text`, joined by line ends."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def rows(head: dict, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        h = hashlib.sha256()
        for i, (role, text) in enumerate(turns):
            h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        yield (*head.values(), h.hexdigest())

    return _streamed(conversations, audits(conversations) if found is None else found, rows, f"conv_id {kind}, {FOUND}, repaired_sha256 string")
