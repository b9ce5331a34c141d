"""Conversation structure repair: the cheapest edits that make roles alternate, by secondary-sorted streaming.

Rows go to their conversation's partition sorted by turn, last turn first, without their texts. A task reads them as
a stream and carries the cost still to come for each state of the role automaton `(s?(ua)+)?` from one Arrow batch to
the next. Costs differ between states by little, so the vectors repeat: a step is one look-up in a table that fills
itself. A row leaves one byte behind, the number of its choices by state; a conversation's bytes beyond a bound go to
an anonymous file that ends with the task. At the first turn the bytes are read back in the order of turns, which gives
the edits. A second stream, first turn first and with texts, takes each conversation's edits from a row that sorts
before all its others, and applies them.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import table

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Bytes of choices that a task keeps in memory for a conversation before it spills them.
HELD = 1 << 20

#: States: nothing yet, after s, after u, after a. What a new u or a leads to; what keeping a row of each role initial leads to.
ADDED = (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
ENDS = (0, 3)

#: A row's kind: 3 * its role initial (s, u, a, other) + what holds of it.
SOUND, CUT, MUST_GO = 0, 1, 2

#: Role that a new u or a has, by the state that it is added in.
NEW_ROLE = ("user", "user", "assistant", "user")


class Table:
    """Costs still to come by state, less the smallest, and what each kind of row makes of them: filled as rows ask."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.choices: list[tuple[tuple[str, int], ...]] = []
        self._vector_of: dict[tuple[int, ...], int] = {}
        self._choice_of: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, int]] = {}
        costs, self.last = self._inserted([0 if s in ENDS else None for s in range(4)], [("", s) for s in range(4)])
        self.start, self.start_cost = self._known(costs)

    def _inserted(self, own: list[int | None], ops: list[tuple[str, int]]) -> tuple[list[int], tuple[tuple[str, int], ...]]:
        """Costs when any number of rows may be inserted first, and each state's ASCII-least cheapest first edit."""
        least = [10**9 if c is None else c for c in own]
        for _ in range(4):
            least = [min(c, INSERT + least[ADDED[s]]) for s, c in enumerate(least)]
        cheapest = []
        for s in range(4):
            found = [ops[s]] if own[s] == least[s] else []
            if INSERT + least[ADDED[s]] == least[s]:
                found.append(("I", ADDED[s]))
            cheapest.append(min(found))
        return least, tuple(cheapest)

    def _known(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        v = tuple(c - least for c in costs)
        if v not in self._vector_of:
            self._vector_of[v] = len(self.vectors)
            self.vectors.append(v)
        return self._vector_of[v], least

    def step(self, vector: int, kind: int) -> tuple[int, int, int]:
        """From the costs after a row to those before it: their number, the row's number of choices, what all costs grew by."""
        found = self.steps.get((vector, kind))
        if found is None:
            after, initial, what = self.vectors[vector], *divmod(kind, 3)
            own, ops = [], []
            for s in range(4):
                edits = [(DELETE + after[s], "D", s)]
                if what != MUST_GO:
                    if s in KEPT[initial]:
                        edits.append((TRUNCATED * (what == CUT) + after[KEPT[initial][s]], "K", KEPT[initial][s]))
                    edits.append((REROLE + TRUNCATED * (what == CUT) + after[ADDED[s]], "R", ADDED[s]))
                cost, op, to = min(edits)
                own.append(cost)
                ops.append((op, to))
            costs, choice = self._inserted(own, ops)
            if choice not in self._choice_of:
                self._choice_of[choice] = len(self.choices)
                self.choices.append(choice)
            to, grown = self._known(costs)
            found = self.steps[vector, kind] = to, self._choice_of[choice], grown
        return found


class Choices:
    """One byte a row, put in from the last row on and read from the first row on."""

    def __init__(self, held: int):
        self.held, self.own, self.file, self.spilled = held, bytearray(), None, 0

    def put(self, choice: int) -> None:
        self.own.append(choice)
        if len(self.own) >= self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115
            self.file.seek(self.spilled)
            self.file.write(self.own)
            self.spilled += len(self.own)
            self.own = bytearray()

    def first_to_last(self) -> Iterator[int]:
        yield from reversed(self.own)
        at = self.spilled
        while at:
            size = min(at, self.held)
            at -= size
            self.file.seek(at)
            yield from reversed(self.file.read(size))
        if self.file is not None:
            self.file.close()


def edits(steps: Table, choices: Iterator[int]) -> bytearray:
    """The initials of the edits, from the first row on."""
    state, out = 0, bytearray()
    for n in choices:
        choice = steps.choices[n]
        while True:
            op, state = choice[state]
            out += op.encode()
            if op != "I":
                break
    while steps.last[state][0]:
        op, state = steps.last[state]
        out += op.encode()
    return out


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audits(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (conv, live, turn, initial, fault), by conversation, last row first: AUDIT of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, of, out = Table(), (), []

        def begin() -> None:
            nonlocal vector, cost, choices, faults, illegal, later, high, low, different
            vector, cost, choices, faults, illegal, later, high, low, different = steps.start, steps.start_cost, Choices(held), [0, 0, 0, 0], 0, None, None, None, 0

        def end() -> None:
            gaps = high - low + 1 - different if high is not None else 0
            total = cost + steps.vectors[vector][0] if later is not None else 0
            out.append([of[0], gaps, *faults[1:], illegal, total, edits(steps, choices.first_to_last()).decode() if later is not None else ""])

        def passed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.string())], names=["conv", *_COUNTS, "audit"])

        vector = cost = illegal = different = 0
        choices, faults, later, high, low = Choices(held), [0] * 4, None, None, None
        for b in batches:
            for conv, live, turn, initial, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != (conv,):
                    if of:
                        end()
                    of = (conv,)
                    begin()
                if not live:
                    continue
                faults[fault] += 1
                vector, choice, grown = steps.step(vector, 3 * initial + (MUST_GO if fault in (1, 2) else CUT if fault else SOUND))
                cost += grown
                choices.put(choice)
                illegal += later is not None and (initial, later) not in ((0, 1), (1, 2), (2, 1))
                later = initial
                if turn is not None:
                    different += turn != low
                    high, low = turn if high is None else high, turn
            yield passed()
        if of:
            end()
            yield passed()

    return run


def _mark() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def audits(rows: DataFrame, held: int = HELD) -> DataFrame:
    """What is wrong with each conversation and its cheapest edits: conv_id and AUDIT.

    rows: conv_id and turn (long), role, text (not null), live: rows that are not live only name their conversation. Rows
    are taken by turn, nulls first, those of one turn by role, then by a hash of the text. A null conv_id is a
    conversation too. The first fault of a row counts: blank, duplicate (role and text stood earlier), truncated.
    """
    blank, whole = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    first = F.substring("role", 1, 1)
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv"), "live", F.col("turn").cast("long").alias("turn"), "role", _mark().alias("mark"),
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"), blank.alias("blank"), whole.alias("whole"),
    )
    nth = F.row_number().over(W.partitionBy("conv", "live", "role", "mark").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(~F.col("whole"), 3).otherwise(0)
    faulty = slim.withColumn("nth", nth).select("conv", "live", "turn", "role", "mark", "nth", "initial", fault.alias("fault"))
    backwards = faulty.repartition("conv").sortWithinPartitions("conv", F.desc_nulls_last("turn"), F.desc("role"), F.desc("mark"), F.desc("nth"))
    return backwards.select("conv", "live", "turn", "initial", "fault").mapInArrow(_audits(held), f"conv long, {AUDIT}").withColumnRenamed("conv", "conv_id")


def _apply(audit: str) -> Callable[[Iterator[tuple[str, str]]], Iterator[tuple[str, str, str]]]:
    """The repaired rows (edit, role, text) of rows (role, text) that come in order."""

    def run(rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        state = 0
        for op in audit:
            if op == "I":
                yield op, NEW_ROLE[state], ""
                state = ADDED[state]
                continue
            role, text = next(rows)
            if op == "K":
                yield op, role, text
                state = KEPT["sua".index(role[0])][state]
            elif op == "R":
                yield op, NEW_ROLE[state], text
                state = ADDED[state]

    return run


_STREAM = ["conv", "role", "text", *_COUNTS, "audit"]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Conversations of a stream in which a row with the audit stands before each conversation's rows: that row, and the rows as they come."""
    held: list[dict] = []

    def read() -> Iterator[dict]:
        for b in batches:
            yield from (dict(zip(_STREAM, r, strict=True)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

    stream = read()

    def rows() -> Iterator[tuple[str, str]]:
        for r in stream:
            if r["audit"] is not None:
                held.append(r)
                return
            yield r["role"], r["text"]

    head = next(stream, None)
    while head is not None:
        mine = rows()
        yield head, mine
        for _ in mine:  # what was not asked for
            pass
        head = held.pop() if held else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = []

    def passed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), *(pa.array(c, pa.string()) for c in cols[7:])], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    for head, rows in _conversations(batches):
        digest, begun = hashlib.sha256(), False
        for _, role, text in _apply(head["audit"])(rows):
            digest.update(("\n" * begun + role + ":" + text).encode())
            begun = True
        out.append([head["conv"], *(head[c] for c in _COUNTS), head["audit"], digest.hexdigest()])
        if len(out) >= 4096:
            yield passed()
    yield passed()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def passed() -> pa.RecordBatch:
        conv, seq, edit, role, text = zip(*out, strict=True) if out else ((),) * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(seq, pa.int64()), *(pa.array(x, pa.string()) for x in (edit, role, text))], names=["conv_id", "seq", "edit", "role", "text"])

    for head, rows in _conversations(batches):
        for n, r in enumerate(_apply(head["audit"])(rows)):
            out.append((head["conv"], n, *r))
            if len(out) >= 1024:
                yield passed()
    yield passed()


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its live rows in order, in one partition."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select(F.col("conv_id").alias("conv"), F.lit(0).alias("at"), none("long").alias("turn"), none("binary").alias("mark"), none("string").alias("role"), none("string").alias("text"), *_COUNTS, "audit")
    body = rows.where("live").select(F.col("conv_id").cast("long").alias("conv"), F.lit(1).alias("at"), F.col("turn").cast("long").alias("turn"), _mark().alias("mark"), "role", "text", *(none("long").alias(c) for c in _COUNTS), none("string").alias("audit"))
    return heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "at", F.asc_nulls_first("turn"), "role", "mark").select(*_STREAM)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, seq (from 0), edit (K, R or I), role, text. rows and found: as audits() takes and gives them."""
    return _in_order(rows, found).mapInArrow(_repaired, "conv_id long, seq long, edit string, role string, text string")


def repair(rows: DataFrame, held: int = HELD) -> DataFrame:
    """conv_id, AUDIT and repaired_sha256, the hash of the repaired `role:text` lines joined by newlines; rows as audits() takes them.

    A conversation is one stream, as its hash is; it is never held whole, whatever its length. A conversation without
    live rows has zeros, an empty audit and the hash of the empty text. Extra columns are ignored. No rows: no result.
    """
    return _in_order(rows, audits(rows, held)).mapInArrow(_digests, f"conv_id long, {AUDIT}, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Rows as audits() takes them, damaged by crc32 of `conv_id:turn`, modulo 20.

    0 drops the row, 1 empties its text, 2 removes `[.!?]` from it, 3 repeats the row, 4 makes its role user. Nulls are one
    space: in that key, in role and text; a null turn or conv_id stays null otherwise.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = df.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    once = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), "kind")
    return once.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
