"""Conversation repair: the cheapest edits that turn damaged turns into an orderly exchange.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant. Turns are kept (free), given another role (2), deleted (3; blank and repeated turns must
be) or joined by inserted empty turns (2); a truncated turn that stays costs 1 more. Of equally cheap edits the ones whose letters (D, I, K, R) come first in ASCII order are taken.

Conversations are dealt over partitions and sorted by turn inside them, so all turns of one stream through one task and are never held together. The first stream runs from the last turn
to the first and carries the cost of finishing from each of four states; it leaves every turn with one byte, two bits a state, that names the best edit there. Spark sorts the turns
with their bytes back into order, spilling as it needs, and the second stream follows the bytes from the start. Costs matter only relative to each other, which leaves few cases, each solved once a task.
The edits letter string and the digest of a conversation are sequential results of one row, so a conversation of any length stays in one task; memory is one Arrow batch and that string.

Turns are ordered by turn number (null first), then role and text, which also fixes the order of ties; of wholly equal turns the first is the original. Null roles and texts count as one space.
Rows marked as dropped take no part but keep their conversation in the result: without other rows it has zeros, no edits and the digest of nothing. A null conversation id is a conversation. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
LETTERS = "DIKR"  # in ASCII order; the two bits of a choice are the place here
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends with so far
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # state after an inserted or re-roled turn
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}  # adjacent initials su, ua, au by their place in INITIALS
INITIALS = "sua"
SPACES = " \t\n\x0b\x0c\r"
FAULTS = (None, "blank", "duplicate", "truncated")
_NEVER = 1 << 60
_END = (0, 4, 2, 0)  # cost of ending in each state: a user and an assistant, or an assistant, are inserted


def back(kind: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The choices of a turn (two bits a state) and the cost of finishing from before it, given the costs from after it."""
    initial, fault = kind & 3, FAULTS[kind >> 2 & 3]
    must_go, stays = fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0
    options = []
    for state in range(4):
        step = NEXT[state]
        kept = SYSTEM if initial == 0 and state == START else step if INITIALS.find("ua"[step == ASSISTANT]) == initial else None
        options.append({
            "D": DELETE + after[state],
            "K": _NEVER if must_go or kept is None else KEEP + stays + after[kept],
            "R": _NEVER if must_go else REROLE + stays + after[step]})
    alone = [min(o.values()) for o in options]
    cost = list(alone)
    for _ in range(2):  # two inserted turns in a row are the most that can help
        cost = [min(alone[s], INSERT + cost[NEXT[s]]) for s in range(4)]
    choices = 0
    for state, o in enumerate(options):
        o["I"] = INSERT + cost[NEXT[state]]
        choices |= next(i for i, letter in enumerate(LETTERS) if o[letter] == cost[state]) << 2 * state
    return choices, tuple(cost)


class _Back:
    """Choices turn by turn, with costs relative to the least of them."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.costs = _END

    def step(self, kind: int) -> int:
        key = kind, self.costs
        if key not in self.known:
            choices, costs = back(*key)
            self.known[key] = choices, tuple(c - min(costs) for c in costs)
        choices, self.costs = self.known[key]
        return choices


def prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column | None) -> DataFrame:
    """Turns with their faults and choices, each conversation in one partition and in order."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)).alias("dropped"))
    same = Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv").withColumn("seen", F.row_number().over(same))
    body = F.rtrim("text", F.lit(SPACES))
    fault = F.when(body == "", 1).when(F.col("seen") > 1, 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rows = rows.withColumn("kind", F.when(F.col("dropped"), -1).otherwise(initial + 4 * fault).cast("int"))
    rows = rows.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("seen")).drop("dropped", "seen")

    def choose(batches):
        machine, conv, place = _Back(), object(), 0
        for batch in batches:
            choices, places = [], []
            for c, kind in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if c != conv:
                    conv, place, machine.costs = c, 0, _END
                place += 1
                places.append(place)
                choices.append(machine.step(kind) if kind >= 0 else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(choices, pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "choices", "left"])

    kind = rows.schema["conv"].dataType.simpleString()
    made = rows.mapInArrow(choose, f"conv {kind}, turn long, role string, text string, kind int, choices int, left long")
    return made.sortWithinPartitions("conv", F.desc("left")).drop("left")


def walk(batches) -> Iterator[tuple | None]:
    """Events in order: (conversation, None) at its start, then (conversation, turn or None, edit, kind, role, text, cost); None at the end of each batch.

    An inserted turn has no kind; a dropped one has kind -1 and no edit.
    """
    conv, state = None, None

    def inserted():
        nonlocal state
        state = NEXT[state]
        return conv, None, "I", None, ROLES[state], "", INSERT

    for batch in batches:
        for c, turn, role, text, kind, choices in zip(*(x.to_pylist() for x in batch.columns)):
            if state is None or c != conv:
                while state in (SYSTEM, USER):
                    yield inserted()
                conv, state = c, START
                yield conv, None
            if kind < 0:
                yield conv, turn, None, kind, role, text, 0
                continue
            while (letter := LETTERS[choices >> 2 * state & 3]) == "I":
                yield inserted()
            stays = TRUNCATED if kind >> 2 == 3 else 0
            if letter == "D":
                yield conv, turn, "D", kind, role, text, DELETE
            elif letter == "K":
                state = SYSTEM if kind & 3 == 0 else NEXT[state]
                yield conv, turn, "K", kind, role, text, KEEP + stays
            else:
                state = NEXT[state]
                yield conv, turn, "R", kind, ROLES[state], text, REROLE + stays
        yield None
    while state in (SYSTEM, USER):
        yield inserted()
    yield None


def edits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """One row an edit: conversation, step (from 1), edit, turn, fault, cost, role and text; repaired turns are those whose edit is not D."""
    rows = prepared(turns, conv, turn, role, text, dropped)
    kind = rows.schema["conv"].dataType.simpleString()
    schema = pa.schema([("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("fault", pa.string()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        held, step = [], 0
        for event in walk(batches):
            if event is None:
                if held:
                    convs, *rest = zip(*held)
                    yield pa.RecordBatch.from_arrays([pa.array(convs, conv_type), *(pa.array(c, f.type) for c, f in zip(rest, schema))], ["conv", *schema.names])
                    held = []
            elif len(event) == 2:
                step = 0
            elif event[2]:
                c, t, edit, k, r, body, cost = event
                step += 1
                held.append((c, step, edit, t, None if k is None else FAULTS[k >> 2], cost, r, body))

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(rows.schema["conv"].dataType)
    return rows.mapInArrow(run, f"conv {kind}, step long, edit string, turn long, fault string, cost long, role string, text string").withColumnRenamed("conv", conv)


class _Summary:
    """What is told of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.first, self.last = conv, 0, None, None
        self.faults, self.illegal, self.before, self.cost = [0, 0, 0, 0], 0, None, 0
        self.audit, self.digest, self.begun = bytearray(), hashlib.sha256(), False

    def add(self, turn, edit, kind, role, text, cost) -> None:
        if kind == -1:
            return
        if kind is not None:
            if turn is not None and turn != self.last:
                self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
            self.faults[kind >> 2] += 1
            self.illegal += self.before is not None and (self.before, kind & 3) not in LEGAL
            self.before = kind & 3
        self.cost += cost
        self.audit += edit.encode()
        if edit != "D":
            self.digest.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summaries(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """One row a conversation: faults counted, cost, the edits' letters and the SHA-256 of the repaired ``role:text`` lines."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = prepared(turns, conv, turn, role, text, dropped)
    kind = rows.schema["conv"].dataType
    types = [to_arrow_type(kind), *[pa.int64()] * len(SUMMARY), pa.string(), pa.string()]
    names = ["conv", *SUMMARY, "audit", "repaired_sha256"]

    def run(batches):
        current, done = None, []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        for event in walk(batches):
            if event is None:
                if done:
                    yield table()
                    done = []
            elif len(event) == 2:
                if current:
                    done.append(current.row())
                current = _Summary(event[0])
            else:
                current.add(*event[1:])
        if current:
            done.append(current.row())
            yield table()

    counts = ", ".join(f"{c} long" for c in SUMMARY)
    return rows.mapInArrow(run, f"conv {kind.simpleString()}, {counts}, audit string, repaired_sha256 string").withColumnRenamed("conv", conv)
