"""Repair of conversations by the cheapest edits, found with iterative-deepening A*.

Rows (conv_id, turn, role, text) of a conversation go by turn, nulls first; rows that share a turn by role and the digest
of their text. A row's first fault counts: blank (nothing but white space), duplicate (role and text of an earlier row),
truncated (the last character that is no white space is not one of ``.!?``). Edits keep a row (0), give it the role user
or assistant (2), delete it (3; blank and duplicate rows must go) or insert an empty user or assistant row (2); a
truncated row that stays adds 1. What is left reads as role initials ``(s?(ua)+)?``. Of the cheapest edits those win whose
initials (D, I, K, R) come first in ASCII order.

The search is depth-first in that order under a bound that grows by one from the lower bound of the whole conversation,
so the first accepting path is the answer. A state is (rows read, last role written); a table keeps the largest budget
with which each state failed, over all bounds. The lower bound adds three for each row that must go, one for each
truncated row, two for each role that cannot stay, and two for every two neighbouring pairs of equal roles, as no edit
mends more than two pairs; on usual conversations it is the true cost. Time grows with rows times (cost less bound).

Two passes, both streams in Arrow batches. The first moves one slim row (16-byte digest, no text) per row and keeps one
byte per row of the conversation at hand; it gives the audit. The second deals the texts by conversation once, an audit
before its rows, and writes repaired rows as they come; no pass holds the texts of a conversation.

Null roles and texts count as one space. A null conv_id is a conversation of its own. Repeated rows are duplicates.
Conversations without rows have no edits and cost 0. Extra columns are ignored; an empty table gives no rows. A very long
text is one row of an Arrow batch. An audit is one string, so a conversation may have 2^31 rows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.llm.common import map_arrow, written

#: Last role written: nothing yet, a system row, user, assistant; then rows of other roles.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
#: Bits of a row's code beside its role.
CUT, GONE = 4, 8
EDITS = "DIKR"
#: What a user or assistant row may follow.
_NEXT = (USER, USER, ASSISTANT, USER)
SPACES = " \t\n\x0b\x0c\r"
ROW = "conv_id long, turn long, role string, text string"
#: Rows of one Arrow batch that goes out.
OUT = 4096


def lower_bounds(codes: bytes) -> list[list[int]]:
    """For each last role, a bound from below on what the rows from i on cost, for every i."""
    n = len(codes)
    stay = [i for i in range(n) if not codes[i] & GONE]
    role = [codes[i] & 3 for i in stay] + [USER]  # the end is like a user row to come
    m = len(stay)
    body, run = [0] * (m + 1), [0] * (m + 1)
    for j in range(m - 1, -1, -1):
        if role[j] in (OTHER, SYSTEM):
            body[j] = 2 + body[j + 1]
        elif role[j] == role[j + 1]:
            run[j] = 1 + run[j + 1]
            body[j] = body[j + 1] + 2 * (run[j] % 2)
        else:
            body[j] = body[j + 1]

    def after(last: int, j: int) -> int:
        if last == SYSTEM and j == m:
            return 4
        alike = USER if last == USER else ASSISTANT
        return body[j] + 2 * ((1 + run[j]) % 2) if role[j] == alike else body[j]

    opened = [1 << 60] * (m + 1)  # a system row is kept, and the rows before it go
    for j in range(m - 1, -1, -1):
        opened[j] = min(after(SYSTEM, j + 1) if role[j] == SYSTEM else 1 << 60, 2 + opened[j + 1])
    out = [[0] * (n + 1) for _ in range(4)]
    fixed, j = 0, m
    for i in range(n, -1, -1):
        if i < n:
            if codes[i] & GONE:
                fixed += 3
            else:
                j -= 1
                fixed += bool(codes[i] & CUT)
        out[START][i] = fixed + min(after(START, j), opened[j])
        for last in (SYSTEM, USER, ASSISTANT):
            out[last][i] = fixed + after(last, j)
    return out


def _step(codes: bytes, i: int, last: int, edit: int) -> tuple[int, int, int] | None:
    """Rows read, last role and price after an edit; None where it is not allowed or never pays."""
    wanted = _NEXT[last]
    if EDITS[edit] == "I":
        return i, wanted, 2
    if i == len(codes):
        return None
    code = codes[i]
    if EDITS[edit] == "D":
        return i + 1, last, 3
    if code & GONE:
        return None
    role, cut = code & 3, bool(code & CUT)
    legal = role == wanted or (role == SYSTEM and last == START)
    if EDITS[edit] == "K":
        return (i + 1, role, int(cut)) if legal and role else None
    return None if role == wanted else (i + 1, wanted, 2 + cut)


def _within(codes: bytes, budget: int, bounds: list[list[int]], failed: list[int]) -> str | None:
    """The first accepting path in ASCII order that costs at most ``budget``."""
    path: list[str] = []
    stack = [[0, START, budget, 0]]
    while stack:
        state = stack[-1]
        i, last, left, begin = state
        if i == len(codes) and last in (START, ASSISTANT):
            return "".join(path)
        for edit in range(begin, 4):
            step = _step(codes, i, last, edit)
            if step is None:
                continue
            j, role, price = step
            rest = left - price
            if rest >= bounds[role][j] and rest > failed[4 * j + role]:
                state[3] = edit + 1
                stack.append([j, role, rest, 0])
                path.append(EDITS[edit])
                break
        else:
            stack.pop()
            failed[4 * i + last] = max(failed[4 * i + last], left)
            if path:
                path.pop()
    return None


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's row codes: role, plus CUT for truncated and GONE for blank or duplicate rows."""
    bounds = lower_bounds(codes)
    failed = [-1] * (4 * (len(codes) + 1))
    cost = bounds[START][0]
    while (audit := _within(codes, cost, bounds, failed)) is None:
        cost += 1
    return cost, audit


def _filled(rows: DataFrame, alive: str | None) -> DataFrame:
    """The rows with nulls as one space, their digest, and whether they exist at all."""
    there = F.lit(True) if alive is None else F.col(alive)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       there.alias("alive")).withColumn("digest", F.unhex(F.md5("text")))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def audits(rows: DataFrame, alive: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``alive`` names a boolean column: rows where it is false are not there, but their conversation is.
    """
    end = F.expr(f"rtrim('{SPACES}', text)")
    initial = F.substring("role", 1, 1)
    slim = _filled(rows, alive).select(
        "conv_id", "turn", "role", "digest", "alive", (F.length(end) == 0).alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER).alias("kind"))
    same = Window.partitionBy("conv_id", "alive", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    ordered = slim.repartition("conv_id").withColumn("repeat", F.row_number().over(same) > 1).sortWithinPartitions(*_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = _Conversation(None)
        started = False
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv != now.conv:
                    if started:
                        done.append(now.result())
                    now, started = _Conversation(conv), True
                now.add(*row)
            if len(done) >= OUT:
                yield _batch(done, AUDIT)
                done = []
        if started:
            done.append(now.result())
        if done:
            yield _batch(done, AUDIT)
    return map_arrow(ordered.select("conv_id", "turn", "alive", "blank", "repeat", "cut", "kind"), run, AUDIT)


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Conversation:
    """The codes and counts of one conversation, row by row."""

    def __init__(self, conv: int | None):
        self.conv, self.codes = conv, bytearray()
        self.first = self.turn = self.kind = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, alive: bool, blank: bool, repeat: bool, cut: bool, kind: int) -> None:
        if not alive:
            return
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        self.blank += blank
        self.duplicate += not blank and repeat
        self.truncated += cut and not blank and not repeat
        if self.kind is not None:
            self.illegal += (self.kind, kind) not in _LEGAL
        self.kind = kind
        self.codes.append(kind | (GONE if blank or repeat else CUT if cut else 0))

    def result(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits(bytes(self.codes)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(fields, zip(*rows))], [n for n, _ in fields])


def repaired(rows: DataFrame, found: DataFrame, alive: str | None = None) -> DataFrame:
    """The rows (conv_id, place, role, text) of the repaired conversations, by the audits of ``found``.

    A conversation's rows lie in one partition, one after another; what reads them without another shuffle sees them in order.
    """
    texts = _filled(rows, alive).filter("alive").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text")
    heads = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit(b"").alias("digest"), F.col("audit").alias("text"))
    order = _order()
    both = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions(order[0], "part", *order[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last, place = None, "", 0, START, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, last, place
            while at < len(audit) and audit[at] == "I":
                last = _NEXT[last]
                yield conv, place, _NAMES[last], ""
                at, place = at + 1, place + 1

        for batch in batches:
            out: list[tuple] = []
            for owner, part, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    out += inserted()  # what the conversation before ends with
                    conv, audit, at, last, place = owner, text, 0, START, 0
                    continue
                out += inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    last = _NEXT[last]
                    role = _NAMES[last]
                else:
                    last = _KINDS.get(role[:1], OTHER)
                out.append((conv, place, role, text))
                place += 1
            if out:
                yield _batch(out, REPAIRED)
        if out := list(inserted()):
            yield _batch(out, REPAIRED)
    return map_arrow(both.select("conv_id", "part", "role", "text"), run, REPAIRED)


REPAIRED = "conv_id long, place long, role string, text string"
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the newline-joined ``role:text`` rows of ``repaired``, one running hash at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running = None, None
        for batch in batches:
            done = []
            for owner, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if running is None or owner != conv:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = owner, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, "conv_id long, sha256 string")
        if running is not None:
            yield _batch([(conv, running.hexdigest())], "conv_id long, sha256 string")
    return map_arrow(rows.select("conv_id", "role", "text"), run, "conv_id long, sha256 string")


def repairs(rows: DataFrame, alive: str | None = None) -> DataFrame:
    """The audits with ``repaired_sha256``, the digest of each repaired conversation."""
    found = written(audits(rows, alive), "audits")
    hashed = digests(repaired(rows, found, alive)).withColumnRenamed("conv_id", "owner")
    empty = hashlib.sha256().hexdigest()
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("owner")), "left") \
                .select(*found.columns, F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with ``alive``, after faults by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 gives it the role user."""
    name = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *name).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
                      F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                      (fault != 0).alias("alive"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "alive",
                      F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
