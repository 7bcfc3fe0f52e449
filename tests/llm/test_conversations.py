"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from colsmith.llm import conversations, queries
from colsmith.session import table

SPACES = " \t\n\x0b\x0c\r"
ORDERLY = regex.compile("(s?(ua)+)?")


def fault(row, earlier):
    role, text = row
    body = text.rstrip(SPACES)
    return "blank" if not body else "duplicate" if row in earlier else "truncated" if body[-1] not in ".!?" else None


def cheapest(rows, faults):
    """Least (cost, letters) of all edit sequences whose roles are orderly, and the repaired turns: a search by cost and letters."""
    heap, limit = [(0, "", 0, ())], 3 * len(rows) + 1
    while heap:
        cost, audit, at, done = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in done)
        if cost > limit or not ORDERLY.fullmatch(roles, partial=True):
            continue
        if at == len(rows) and ORDERLY.fullmatch(roles):
            return cost, audit, done
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, (*done, (role, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, done))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*done, rows[at])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, (*done, (role, rows[at][1]))))


def naive(turns):
    """Summary of each conversation from (conv, turn, role, text, dropped) tuples."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, gone in turns if c == conv and not gone]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        rows, numbers = [r[1:] for r in own], {r[0] for r in own if r[0] is not None}
        faults = [fault(r, rows[:i]) for i, r in enumerate(rows)]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
        cost, audit, done = cheapest(rows, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest()
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def frame(spark, turns, parts=3):
    schema = "conv_id string, turn long, role string, text string, gone boolean, conv int, kind string, `left` string, seen int, choices string"
    return spark.createDataFrame([(*t, 1, "k", "l", 2, "c") for t in turns], schema).repartition(parts)


def summary(df, **options):
    return {r[0]: tuple(r)[1:] for r in conversations.summaries(df, **options).collect()}


def test_query_on_the_table(spark, folder):
    turns = []
    for r in table(spark, folder, "conversations").collect():
        code, (conv, turn, role, text) = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20, r
        text = "" if code == 1 else regex.sub("[.!?]", "", text) if code == 2 else text
        turns += [(conv, turn, "user" if code == 4 else role, text, code == 0)] * (2 if code == 3 else 1)
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert found == naive(turns) and len({x for v in found.values() for x in v[6]}) == 4


def random_turns(seed, conversations_=60):
    draw, out = random.Random(seed), []
    for c in range(conversations_):
        for i in range(draw.randint(1, 6)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "admin", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "Why?  \n", "cut", "cut of", "", " \t", None, "é漢.\r\n", " "])
            out.append((str(c), draw.choice([None, i, i, i, i + 3, -i]), role, text, draw.random() < 0.1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_turns(spark, seed):
    turns = random_turns(seed) + [(None, 1, "user", "a.", False), (None, None, "assistant", "b.", False), ("gone", 1, "user", "a.", True)]
    found = summary(frame(spark, turns), dropped=F.col("gone"))
    assert found == naive(turns)
    assert found["gone"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_give_the_repaired_turns(spark):
    turns = random_turns(3)
    rows = conversations.edits(frame(spark, turns), dropped=F.col("gone")).collect()
    for conv, (*_, cost, audit, digest) in naive(turns).items():
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["step"])
        assert "".join(r["edit"] for r in own) == audit and sum(r["cost"] for r in own) == cost and [r["step"] for r in own] == list(range(1, len(own) + 1))
        kept = [f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == digest


def test_long_conversation_over_many_batches(spark):
    turns = [("x", i, "user" if i % 3 else "assistant", f"turn {i}" + "y" * (200_000 if i == 7 else 0) + ".", False) for i in range(30_000)]
    ((_, _, dup, _, _, cost, audit, _),) = summary(frame(spark, turns)).values()
    assert dup == 0 and len(audit) >= 30_000 and cost == 20_002  # the first turn and one of each pair of user turns change
    assert audit.count("I") * 2 + audit.count("R") * 2 + audit.count("D") * 3 == cost


def test_empty(spark):
    df = frame(spark, [("a", 1, "user", "x.", False)])
    assert summary(df.limit(0)) == {} and conversations.edits(df.limit(0)).count() == 0
    assert summary(df)["a"][5:7] == (2, "KI")
