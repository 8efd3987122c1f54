"""Repair of conversation structure against an exhaustive search."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, turnrepair

SPACES = " \t\n\x0b\x0c\r"
WANTED = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_damage(rows):
    """The rows of each conversation after damage: (turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(name.encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if h == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute_audit(rows):
    """All columns of an audit; edits by uniform-cost search over (cost, edits), cheapest and then least string first."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        for r in ("user", "assistant"):
            if r[0] in WANTED[last]:
                heapq.heappush(heap, (cost + 2, edits + "I", i, r[0], (*made, f"{r}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, last, made))
            if faults[i] not in ("blank", "duplicate"):
                more = cost + (faults[i] == "truncated")
                if role and role[0] in WANTED[last]:
                    heapq.heappush(heap, (more, edits + "K", i + 1, role[0], (*made, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if r[0] in WANTED[last]:
                        heapq.heappush(heap, (more + 2, edits + "R", i + 1, r[0], (*made, f"{r}:{text}")))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        edits,
        hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_rows():
    random_ = random.Random(11)
    rows = [(1, None, None, None), (None, None, "user", "a."), (None, 3, "assistant", "b!"), (2, 5, "", "x"), (2, 5, "system", "\x0b \t"), (2, 9, "usher", "é? ")]
    for conv in range(3, 260):
        for _ in range(random_.randint(1, 9)):
            turn = random_.choice([None, *range(7)])
            role = random_.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = random_.choice(["", " \n", "Yes.", "No!", "Why? ", "cut", "cut\t", "Yes.", None, "😀.", "long " * 50 + "."])
            rows.append((conv, turn, role, text))
    return rows


@pytest.mark.parametrize("block", [2, turnrepair.BLOCK_ROWS])
def test_audits_of_damaged_rows(spark, monkeypatch, block):
    monkeypatch.setattr(turnrepair, "BLOCK_ROWS", block)
    rows = odd_rows()
    given = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turnrepair.audits(turnrepair.damaged(given), present=F.col("present")).collect()}
    want = {conv: brute_audit(kept) for conv, kept in brute_damage(rows).items()}
    assert got == want


def test_small_rows_of_every_kind(spark):
    random_ = random.Random(2)
    rows = [(conv, turn, random_.choice(["user", "assistant", "system", "x"]), random_.choice(["a.", "b.", "c", ""])) for conv in range(400) for turn in range(random_.randint(0, 7))]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turnrepair.audits(given).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    assert got == {conv: brute_audit(kept) for conv, kept in by.items()}


def test_repaired_rows_read_as_they_should(spark):
    rows = [("x", 0, "user", "a."), ("x", 1, "user", "b."), ("x", 2, "user", "b."), ("x", 4, "assistant", " "), (None, 1, "system", "s.")]
    given = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = [(r.conv_id, r.edit, r.turn, r.role, r.text) for r in turnrepair.repair(given).orderBy("conv_id", "place").collect()]
    assert got == [
        (None, "D", 1, "system", "s."),
        ("x", "K", 0, "user", "a."), ("x", "R", 1, "assistant", "b."), ("x", "D", 2, "user", "b."), ("x", "D", 4, "assistant", " "),
    ]


def test_giant_conversation_is_spilled(spark, monkeypatch):
    monkeypatch.setattr(turnrepair, "BLOCK_ROWS", 500)
    rows = [(7, t, "user" if t % 3 else "assistant", f"row {t}" + "." * (t % 2)) for t in range(0, 40_000, 2)] + [(8, 0, "user", "x." * 500_000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turnrepair.audits(given).collect()}
    assert got[7] == brute_audit([r[1:] for r in rows[:-1]]) and got[8] == brute_audit([rows[-1][1:]])


def test_repair_of_nothing(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turnrepair.repair(nothing).count() == 0 and turnrepair.audits(turnrepair.damaged(nothing), present=F.col("present")).count() == 0


def test_query_on_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_turnrepair(spark, folder).collect()}
    assert got == {conv: brute_audit(kept) for conv, kept in brute_damage(rows).items()}
