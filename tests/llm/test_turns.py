"""Conversation repair against a plain search over all edits, and its defined cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

DDL = "conv_id long, turn long, role string, text string, id int, k string, audit int"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(name.encode()) % 20
        if m == 1:
            text = ""
        elif m == 2:
            text = "".join(x for x in text if x not in ".!?")
        elif m == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def plain_repair(rows):
    """Uniform-cost search over (turns taken, roles so far), with the audit as the second key: no grammar states."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, fault = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(WHITE)
        fault.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def grow(shape, role):  # shape: "" or the last initial
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[shape]
        return role if role and role in ok else None

    heap, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, shape, made = heapq.heappop(heap)
        if (i, shape) in closed and not (i == len(rows) + 1):
            continue
        closed.add((i, shape))
        if i == len(rows) and shape in ("", "a"):
            break
        push = lambda c, a, j, s, m: heapq.heappush(heap, (cost + c, audit + a, j, s, m))
        for role, letter in (("user", "u"), ("assistant", "a")):
            if grow(shape, letter):
                push(2, "I", i, letter, made + (f"{role}:",))
        if i < len(rows):
            _, _, role, text = rows[i]
            push(3, "D", i + 1, shape, made)
            if fault[i] not in ("b", "d"):
                extra = fault[i] == "t"
                if grow(shape, initials[i]):
                    push(extra, "K", i + 1, initials[i], made + (f"{role}:{text}",))
                for new, letter in (("user", "u"), ("assistant", "a")):
                    if grow(shape, letter):
                        push(2 + extra, "R", i + 1, letter, made + (f"{new}:{text}",))
    digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, digest)


def plain(rows):
    kept = {}
    for r in plain_damage(rows):
        kept.setdefault(r[0], []).append(r)
    return {c: plain_repair(kept.get(c, [])) for c in {r[0] for r in rows}}


def made_up(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(["Hello.", "Go on!", "so", "Why?", " \t", "", "yes.\n ", "no. then", None, f"t{t}."])
            rows.append((c, t if rng.random() < 0.9 else t + 3, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text))
    return rows


def ours(spark, rows, **ways):
    from tidemark.llm.turns import damage, repairs_of

    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL).repartition(4)
    return {r[0]: tuple(r[1:]) for r in repairs_of(damage(df), ids=df).collect()}


def test_repairs_against_plain_search(spark):
    rows = made_up(1, 120, 9) + [(None, None, None, None), (None, None, "user", "a."), (500, None, "user", "a."), (501, -(2**63), "user", "x."), (501, 2**63 - 1, "user", "y.")]
    want, got = plain(rows), ours(spark, rows)
    assert got.pop(501)[1:] == want.pop(501)[1:]
    assert got == want
    assert any("I" in v[6] and "D" in v[6] and "R" in v[6] for v in got.values())


def test_long_conversations_are_chained(spark, monkeypatch):
    from tidemark.llm import turns

    monkeypatch.setattr(turns, "BLOCK", 2)
    monkeypatch.setattr(turns, "FAN", 1)
    rows = made_up(2, 3, 60) + [(9, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(70)]
    assert ours(spark, rows) == plain(rows)


def test_ties_take_the_least_audit(spark):
    rows = [(c, t, role, f"{c}.{t}.") for c, roles in enumerate(["uu", "aa", "sa", "s", "a", "uau", "ss", "auau"]) for t, role in enumerate({"u": "user", "a": "assistant", "s": "system"}[x] for x in roles)]
    assert ours(spark, rows) == plain(rows)


def test_repaired_turns_match_the_grammar(spark):
    import re

    from tidemark.llm.turns import cheapest, faults, ordered, repaired_turns

    df = spark.createDataFrame([(*r, 1, "x", 2) for r in made_up(3, 30, 8)], DDL)
    rows = ordered(df)
    made = repaired_turns(rows, cheapest(faults(rows))).orderBy("k", "place").collect()
    shapes = {}
    for r in made:
        shapes[r.k] = shapes.get(r.k, "") + r.role[0]
    assert shapes and all(re.fullmatch("s?(ua)+", s) for s in shapes.values())


def test_empty_and_query(spark):
    from tidemark.llm.queries import ORACLES, QUERIES
    from tidemark.llm.turns import repairs_of

    assert repairs_of(spark.createDataFrame([], DDL)).count() == 0
    data = "/root/testdata/sf0.001"
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op12_turns"](spark, data).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op12_turns"]).fetchall()} == got
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("size", [1, 7])
def test_batches_hold_whole_segments(size):
    import pyarrow as pa

    from tidemark.llm import turns

    rows = [(f"{k}", g) for g in range(3) for k in range(4) for _ in range(k + 1)]
    batches = [pa.record_batch([pa.array([r[0] for r in rows[i : i + size]]), pa.array([r[1] for r in rows[i : i + size]])], names=["k", "g"]) for i in range(0, len(rows), size)]
    was, turns.BATCH = turns.BATCH, 5
    try:
        tables = list(turns.whole_segments(batches))
    finally:
        turns.BATCH = was
    seen = [set(zip(t["k"].to_pylist(), t["g"].to_pylist())) for t in tables]
    assert sum(len(t) for t in tables) == len(rows) and sum(map(len, seen)) == len(set.union(*seen)) == 12
