"""Operator 11 against a brute-force repair, and its tensor programme against plain search."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigscan.llm import convdp, convrepair, queries
from sigscan.session import table

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def search(codes):
    """(cost, audit) of the cheapest edits by trying all of them."""

    @cache
    def best(t, s, inserted=0):
        if t == len(codes):
            return {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}[s]
        role, fault = divmod(codes[t], 3)
        found = []
        add = lambda cost, initial, rest: found.append((cost + rest[0], initial + rest[1]))
        add(4, "D", best(t + 1, s))
        if fault != convdp.GONE:
            late = 3 if fault == convdp.TRUNCATED else 0
            to = {(0, 0): 2, (0, 1): 2, (0, 3): 2, (1, 2): 3, (2, 0): 1}.get((role, s))
            if to is not None:
                add(late, "K", best(t + 1, to))
            add(late + 3, "R", best(t + 1, NEXT[s]))
        if inserted < 4:
            add(3, "I", best(t, NEXT[s], inserted + 1))
        return min(found)

    return best(0, 0)


@pytest.mark.parametrize(("cells", "block"), [(1 << 18, 1000), (40, 3), (1000, 2), (7, 1)])
def test_programme_equals_search(cells, block):
    rng = random.Random(5)
    conversations = [[rng.choice([0, 0, 3, 3, 6, 9, 1, 4, 2, 5, 7, 8, 11]) for _ in range(rng.randint(0, 14))] for _ in range(1500)]
    blocks = [[np.array(c[k : k + block], np.uint8) for k in range(0, len(c), block)] for c in conversations]
    for codes, (cost, plan, end) in zip(conversations, convdp.repair(blocks, cells), strict=True):
        assert (cost, convdp.audit(plan, end).decode()) == search(tuple(codes))


def brute_force(rows):
    by = {}
    for conv, turn, role, text in rows:
        out = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: repaired(out) for conv, out in by.items()}


def repaired(rows):
    rows.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        tail = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    named = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def inserted(states):
        for _ in range(4):
            for s in list(states):
                cost, audit, out = states[s]
                new = (cost + 3, audit + "I", (*out, f"{named[s]}:"))
                if NEXT[s] not in states or new[:2] < states[NEXT[s]][:2]:
                    states[NEXT[s]] = new
        return states

    states = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def put(s, *new, after=after):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new

        for s, (cost, audit, out) in states.items():
            put(s, cost + 4, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            late = 3 if fault == "truncated" else 0
            to = {("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3, ("s", 0): 1}.get((role[:1], s))
            if to is not None:
                put(to, cost + late, audit + "K", (*out, f"{role}:{text}"))
            put(NEXT[s], cost + late + 3, audit + "R", (*out, f"{named[s]}:{text}"))
        states = inserted(after)
    cost, audit, out = min((states[s] for s in (0, 3) if s in states), key=lambda v: v[:2])
    turns, initials = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_query_equals_brute_force(spark, sf):
    got = {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, sf).collect()}
    assert got == brute_force(rows_of(table(spark, sf, "conversations")))


def test_odd_rows_and_a_long_conversation(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (1, None, "", "a."), (1, 2, "zz", "b"), (1, 2, "zz", "b"), (2, 5, "user", " \t"), (3, 0, "assistant", "k!" * 500_000), (4, 11, "user", "")]
    rows += [(9, k, "user" if k % 2 else "assistant", f"t{k % 7}" if k % 3 else f"q{k}.") for k in range(1500)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos int, said string, edit string").repartition(5)
    want = brute_force(rows)
    for block in (64, convrepair.BLOCK):  # the long conversation in blocks, and in one
        assert {r[0]: tuple(r)[1:] for r in convrepair.repair_damaged(df, block).collect()} == want
    assert convrepair.repair_damaged(df.where("false")).count() == 0


def test_a_conversation_that_loses_all_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert tuple(convrepair.repair_damaged(df).first()) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    """The operator's own output: rows with the edits that gave them."""
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "assistant", "c.")], "conv_id long, turn long, role string, text string")
    solved, fixed = convrepair.repair(df)
    assert [(r.cost, r.audit, r.duplicate) for r in solved.collect()] == [(7, "KIKKD", 1)]
    got = [tuple(r) for r in fixed.orderBy("pos", "place").select("edit", "turn", "role", "text").collect()]
    assert got == [("K", 0, "user", "a."), ("I", None, "assistant", ""), ("K", 1, "user", "b."), ("K", 2, "assistant", "c.")]
    assert solved.where(F.size("plans") != 1).count() == 0
