"""Repair of the structure of conversations, streamed in the order of their turns.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Edits make it so: Keep a row as it is (0),
give it the role that is due (Rerole, 2), Delete it (3), Insert an empty row (2); a row whose text breaks off costs 1 more if it
stays, blank rows and repeats must go. What is due depends only on the row before: a state among four (nothing yet, after
s, after u, after a).

Rows are dealt by conversation and sorted by turn, the last one first, and stream through ``mapInPandas``. The dynamic
program's state, the least cost from each of the four states to the end, is carried over from row to row and from one
batch to the next; it is kept as differences, of which there are few, so a step is a look-up. Each row leaves
a backpointer of one byte: for each state the first of the cheapest edits in the order D, I, K, R.
Where a conversation ends, its rows are read back in their order, the pointers followed, and the repaired rows given out.
Rows and pointers of a giant conversation are spilled in blocks to an unnamed file, which is gone when
the task ends; memory holds one block and the blocks' places.

Repeats are found before the stream: identical rows (same turn, role, text) are counted together, and a small table of role
and text digests that occur more than once in a conversation names their first turn.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and characters of text, that a block holds before it is spilled.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 22
INITIALS, LETTERS = "DIKR", "sua"
ROLE = {2: "user", 3: "assistant"}
#: The state that an inserted or renamed row leads to, from each state.
DUE = (2, 2, 3, 2)
#: The state that a kept row leads to, by state and initial.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The cost from each state to the end where no row is left, by inserting what is due.
END = (0, 4, 2, 0)
DELETE, INSERT, RENAME, TRUNCATED = 3, 2, 2, 1
NEVER = 1 << 40
BLANK, CUT = "[^ \\t-\\r]", "[.!?]"
LARGEST = 2**63 - 1


@functools.cache
def step(after: tuple[int, int, int, int], initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, int, int], int, int]:
    """The costs before a row from those after it, as differences and what they have in common, and the row's backpointer.

    A pointer has two bits a state: which edit, of the cheapest ones, comes first in D, I, K, R.
    """
    keep = TRUNCATED if truncated else 0
    costs, ways = [], []
    for state in range(4):
        to = KEPT.get((state, initial))
        ways.append([DELETE + after[state], NEVER, NEVER if must_go or to is None else keep + after[to], NEVER if must_go else RENAME + keep + after[DUE[state]]])
        costs.append(min(ways[-1]))
    for _ in range(3):
        costs = [min(c, INSERT + costs[DUE[s]]) for s, c in enumerate(costs)]
    pointer = 0
    for state, way in enumerate(ways):
        way[1] = INSERT + costs[DUE[state]]
        pointer |= way.index(costs[state]) << 2 * state
    least = min(costs)
    return tuple(c - least for c in costs), least, pointer


class Spool:
    """Rows in blocks, given back from the last to the first; all blocks but the last are in a file without a name."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.chars, self.file, self.at = 0, None, [0]

    def add(self, row: tuple, chars: int) -> None:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(pickle.dumps(self.rows, pickle.HIGHEST_PROTOCOL))
            self.at.append(self.file.tell())
            self.rows, self.chars = [], 0

    def backwards(self) -> Iterator[tuple]:
        yield from reversed(self.rows)
        for start, end in zip(self.at[-2::-1], self.at[:0:-1], strict=True):
            self.file.seek(start)
            yield from reversed(pickle.loads(self.file.read(end - start)))
        if self.file:
            self.file.close()


class Conversation:
    """One conversation while its rows come in, the last one first."""

    def __init__(self, key: tuple) -> None:
        self.key, self.spool = key, Spool()
        self.after, self.base = END, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.turns, self.low, self.high, self.next = 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, fault: str, copies: int) -> None:
        """``copies`` equal rows; all but the first are repeats, and so is that one if ``fault`` says so."""
        if turn is not None and turn != self.low:
            self.turns += 1
            self.low, self.high = turn, turn if self.high is None else self.high
        initial = role[:1]
        for k in range(copies):
            why = "duplicate" if k < copies - 1 and fault != "blank" else fault
            if why:
                setattr(self, why, getattr(self, why) + 1)
            if self.next is not None and initial + self.next not in ("su", "ua", "au"):
                self.illegal += 1
            self.next = initial
            self.after, more, pointer = step(self.after, initial if initial in LETTERS else "", why in ("blank", "duplicate"), why == "truncated")
            self.base += more
            self.rows += 1
            self.spool.add((turn, role, text, pointer), len(role) + len(text))

    @property
    def cost(self) -> int:
        return self.base + self.after[0]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LARGEST)

    def repaired(self) -> Iterator[tuple[str, int | None, str, str]]:
        """Edits from the first row on: initial, turn, role and text as they are after it. Deleted rows are among them."""
        state = 0
        for turn, role, text, pointer in self.spool.backwards():
            edit = pointer >> 2 * state & 3
            while INITIALS[edit] == "I":
                state = DUE[state]
                yield "I", None, ROLE[state], ""
                edit = pointer >> 2 * state & 3
            if INITIALS[edit] == "K":
                state = KEPT[state, role[:1]]
            elif INITIALS[edit] == "R":
                state = DUE[state]
                role = ROLE[state]
            yield INITIALS[edit], turn, role, text
        while END[state]:
            state = DUE[state]
            yield "I", None, ROLE[state], ""


def ordered(rows: DataFrame, key: str = "conv_id", present: Column | None = None) -> DataFrame:
    """The rows that stream: dealt by conversation, sorted by turn, the last one first, with their faults and copies.

    Null role or text is one space. A conversation without a row that is ``present`` has one row without copies.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    given = rows.select(F.col(key).alias("key"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), here.alias("here"))
    none = lambda c: F.when(F.col("here"), F.col(c))
    given = given.select("key", none("turn").alias("turn"), none("role").alias("role"), none("text").alias("text"), F.col("here").cast("long").alias("n"))
    counted = given.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("copies"))
    counted = counted.withColumn("digest", F.when(F.col("copies") > 0, F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)))
    # Turns in order with nulls first: the flag tells them apart from every number.
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = counted.where("digest is not null").groupBy(F.col("key").alias("k"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = counted.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    end = F.regexp_extract("text", f"({BLANK})[ \\t-\\r]*\\z", 1)
    fault = F.when(~F.rlike("text", F.lit(BLANK)), "blank").when(place > F.col("first"), "duplicate").when(~F.rlike(end, F.lit(CUT)), "truncated").otherwise("")
    told = joined.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("key").isNotNull().alias("named"),
        F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("turned"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), fault.alias("fault"), "copies",
    )
    order = ["named", "key", F.desc("turned"), F.desc("turn"), F.desc("role"), F.desc("text")]
    return told.repartition("named", "key").sortWithinPartitions(*order)


def _stream(rows: DataFrame, give: Callable[[Conversation], Iterator[dict[str, Any]]], schema: T.StructType) -> DataFrame:
    """What ``give`` makes of each conversation of ``ordered`` rows, in frames of bounded size."""

    def frame(out: list[dict]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=schema.names)
        return made.astype({f.name: "Int64" for f in schema if isinstance(f.dataType, T.LongType)})

    def finished(frames: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
        now = None
        for batch in frames:
            columns = (batch[c].tolist() for c in ("named", "key", "turned", "turn", "role", "text", "fault", "copies"))
            for named, key, turned, turn, role, text, fault, copies in zip(*columns, strict=True):
                if now is None or now.key != (named, key):
                    if now:
                        yield now
                    now = Conversation((named, key))
                if copies:
                    now.add(turn if turned else None, role, text, fault, copies)
        if now:
            yield now

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, chars = [], 0
        for conversation in finished(frames):
            for row in give(conversation):
                out.append(row)
                chars += sum(len(x) for x in row.values() if isinstance(x, str))
                if len(out) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield frame(out)
                    out, chars = [], 0
        yield frame(out)

    return rows.mapInPandas(run, schema)


def _named(streamed: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    """The conversation's identifier as it was given."""
    own = F.when(F.col("named"), F.col("key").cast(kind)).alias(key)
    return streamed.select(own, *(c for c in streamed.columns if c not in ("named", "key")))


def repair(rows: DataFrame, key: str = "conv_id", present: Column | None = None) -> DataFrame:
    """Repaired conversations: the key, place (from 1), edit (D, I, K or R), turn, role, text.

    ``rows``: the key (an integer or string column), turn, role, text. Rows stand in the order of turn (nulls first), role and
    text; a null role or text is one space, a null key is a conversation of its own, and other columns are not read. Rows with
    edit D are those that go and keep what they said; inserted rows have no turn. ``present`` is false on rows that only name their conversation.
    """
    schema = T.StructType(
        [T.StructField("named", T.BooleanType()), T.StructField("key", T.StringType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
         T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    )

    def give(c: Conversation) -> Iterator[dict[str, Any]]:
        for place, (edit, turn, role, text) in enumerate(c.repaired(), 1):
            yield {"named": c.key[0], "key": c.key[1], "place": place, "edit": edit, "turn": turn, "role": role, "text": text}

    return _named(_stream(ordered(rows, key, present), give, schema), key, rows.schema[key].dataType)


def audits(rows: DataFrame, key: str = "conv_id", present: Column | None = None) -> DataFrame:
    """One row per conversation: the key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows as in ``repair``. Each row's first fault counts: blank, duplicate (role and text seen earlier), truncated. gaps: turns
    missing between the least and the largest; illegal: neighbours whose initials are not su, ua or au. audit: the initials of the
    cheapest edits, the first in byte order of equally cheap ones. The digest covers role:text of the repaired rows, joined by newlines.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType(
        [T.StructField("named", T.BooleanType()), T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in counts),
         T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )

    def give(c: Conversation) -> Iterator[dict[str, Any]]:
        audit, said, any_yet = bytearray(), hashlib.sha256(), False
        for edit, _, role, text in c.repaired():
            audit += edit.encode()
            if edit != "D":
                said.update((("\n" if any_yet else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                any_yet = True
        yield {"named": c.key[0], "key": c.key[1], **{n: getattr(c, n) for n in counts}, "audit": audit.decode(), "repaired_sha256": said.hexdigest()}

    return _named(_stream(ordered(rows, key, present), give, schema), key, rows.schema[key].dataType)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id turn role text present`` with the damage that a hash of conversation and turn names; every row stays, dropped ones are not ``present``.

    0 drops a row, 1 empties its text, 2 removes full stops and their like, 3 repeats it, 4 makes the user say it.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    given = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("present"), twice.alias("copy")).drop("copy")
