"""Conversation repair against a dynamic program over whole conversations."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from tidemark.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies string, fresh string"


def least(rows, entry=0, leave=None):
    """Cost and ASCII-least edits, by trying every edit from every (row, state)."""
    best = {}
    for i in range(len(rows), -1, -1):
        ends = {}
        for s in range(4):  # without an insert before row i
            out = []
            if i == len(rows):
                if (s == leave) if leave is not None else s in (0, 3):
                    out.append((0, ""))
            else:
                initial, gone, cut = rows[i]
                moves = [("D", 4, s)]
                if not gone:
                    moves += [("K", 3 * cut, R._KEEP[s][initial])] if initial in R._KEEP[s] else []
                    moves += [("R", 3 + 3 * cut, R._NEXT[s])]
                out += [(c + best[i + 1][to][0], e + best[i + 1][to][1]) for e, c, to in moves if best[i + 1][to]]
            ends[s] = min(out, default=None)
        best[i] = {}
        for s in range(4):
            out, to = [ends[s]], s
            for n in range(1, 4):
                to = R._NEXT[to]
                if ends[to] and (i < len(rows) or leave is None):
                    out.append((3 * n + ends[to][0], "I" * n + ends[to][1]))
            best[i][s] = min((x for x in out if x), default=None)
    return best[0][entry]


def test_search_is_cheapest_and_least():
    rnd = random.Random(3)
    for _ in range(400):
        rows = [(rnd.choice("suuaaax") if rnd.random() < .95 else "", rnd.random() < .15, rnd.random() < .3)
                for _ in range(rnd.randrange(12))]
        for entry in range(4):
            for leave in (None, 0, 1, 2, 3):
                assert R.cheapest(rows, entry, leave) == least(rows, entry, leave), (rows, entry, leave)


def expected(table):
    """Damage, faults, repair of every conversation, in plain Python."""
    by, out = {}, {}
    for conv, turn, role, text in table:
        space = " "
        fault = zlib.crc32(f"{space if conv is None else conv}:{space if turn is None else turn}".encode()) % 20
        role, text = space if role is None else role, space if text is None else text
        got = by.setdefault(conv, [])
        if fault == 4:
            role = "user"
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        got += [(turn is not None, turn or 0, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, got in by.items():
        seen, rows, faults = set(), [], [0, 0, 0]
        for _, _, role, text in sorted(got):
            body = text.strip(" \t\n\x0b\f\r")
            kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            rows.append((role[:1], kind in (0, 1), kind == 2))
        cost, audit = least(rows)
        lines = R.repaired([(r, t) for _, _, r, t in sorted(got)], audit)[0]
        turns = {t for known, t, _, _ in got if known}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults,
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@cache
def hard_cases():
    rnd = random.Random(5)
    said = ["Yes.", "No!", "Well", "", " \t", "ends.  ", "é?", None]
    out = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "user", "Hi."), (1, None, "user", "Hi."),
           (1, 2, "assistant", "Hi."), (2, 0, "", "no role"), (2, 0, "tool", "Done."), (3, 5, "user", "z" * 200_000),
           (3, 9, "assistant", "y" * 200_000 + "."), (-4, -7, "system", "Be good."), (-4, 2, "user", "Why?")]
    out += [(10 + c, rnd.randrange(9) if rnd.random() < .9 else None, rnd.choice(["system", "user", "assistant", "user"]),
             rnd.choice(said)) for c in range(60) for _ in range(rnd.randrange(12))]
    # One conversation holds most rows, spans ranges and pieces, and repeats one row very often.
    out += [(500, t, "user" if rnd.random() < .5 else "assistant", f"{rnd.randrange(2500)}{rnd.choice('.x')}")
            for t in range(3000)]
    out += [(500, 77, "user", "again.")] * 700
    return out


@pytest.fixture(scope="module")
def result(spark):
    rows = [(*r, "clash", "clash", "clash") for r in hard_cases()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return {r.conv_id: tuple(r)[1:] for r in R.repair(R.damaged(df)).collect()}


def test_repair_matches_brute_force(result):
    want = expected(hard_cases())
    assert result.keys() == want.keys()
    for conv, row in want.items():
        assert result[conv] == row, conv


def test_one_long_conversation_is_spread(spark):
    df = spark.createDataFrame([(*r, "", "", "") for r in hard_cases()], SCHEMA)
    rows = R.damaged(df)
    plan = R.repair(rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_rows(spark):
    assert R.repair(R.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_all_dropped(spark):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row, = R.repair(R.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "", "", "")], SCHEMA))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
