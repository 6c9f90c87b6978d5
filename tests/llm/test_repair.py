"""Conversation repair against plain enumeration of all edits and against the SQL, whole and cut into segments."""

import hashlib
import itertools
import re
import zlib

import duckdb
import pandas as pd
import pytest

from sievewright.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string, key string, segment string, copies string"


def brute(rows):
    """cost, audit, repaired text of one conversation's damaged rows by trying every edit sequence with up to three insertions in a row."""
    best = None
    seen, faults = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = [[""] if k < 0 else ["", "u", "a", "ua", "au", "uau"] for k in range(len(rows) + 1)]
    options = []
    for (role, text), fault in zip(rows, faults):
        extra = 3 * (fault == "truncated")
        keep = [] if fault in ("blank", "duplicate") else [("K", extra, role, text), ("R", 3 + extra, "user", text), ("R", 3 + extra, "assistant", text)]
        options.append([("D", 4, None, None), *keep])
    for edits in itertools.product(*options):
        for inserted in itertools.product(*gaps):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost += 3 * len(inserted[k])
                audit += "I" * len(inserted[k])
                lines += [({"u": "user", "a": "assistant"}[c], "") for c in inserted[k]]
                if k < len(rows):
                    e, c, role, text = edits[k]
                    cost, audit = cost + c, audit + e
                    lines += [] if e == "D" else [(role, text)]
            if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
    return best, faults


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.fixture(scope="module")
def messages():
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "no", "", " \t", None, "Why?", "so!", "ünd …"]
    rows = [(c, t, roles[(c * 7 + t * t + c // 3) % 6], texts[(c * c + 3 * t) % 8]) for c in range(60) for t in range(c % 4)]
    rows += [(None, None, "user", "Hi."), (None, None, "assistant", "Hi."), (None, 4, "user", None)]
    # Repeated rows, equal turns, gaps, and one conversation longer than a segment.
    rows += [(100, 3, "user", "Again.")] * 3 + [(100, 9, "assistant", "Again."), (101, 1, "user", "a."), (101, 1, "assistant", "b."), (101, 1, "user", "a.")]
    return rows


def long_rows():
    return [(200 + c, t, ["user", "assistant", "user", "system"][(t * t + c) % 4], ["Yes.", "No.", "and", "", f"{t}."][(t * 3 + c) % 5]) for c in range(3) for t in range(40 + c)]


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], COLUMNS)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.repaired(df, **sizes).collect()}


def test_equals_every_edit_tried(spark, messages):
    got = run(spark, messages)
    assert set(got) == {r[0] for r in messages}
    for conv in got:
        rows = hurt([r for r in messages if r[0] == conv])
        if len(rows) > 3:
            continue
        (cost, audit, text), faults = brute([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        assert got[conv][1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert got[conv][5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows
        assert got[conv][0] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert got[conv][4] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("sizes", [{}, {"segment_rows": 2}, {"segment_rows": 7, "segment_chars": 5}])
def test_segments_and_sql_agree(spark, messages, sizes):
    rows = messages + long_rows()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    r = con.execute(repair.OP11_SQL)
    names = [x[0] for x in r.description]
    want = {x[0]: tuple(x[1:]) for x in r.fetchall()}
    assert names[1:] == ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert run(spark, rows, **sizes) == want


def test_empty_and_dropped(spark):
    assert run(spark, []) == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(5, gone, "user", "Hi.")]) == {5: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_states_and_stacks():
    lr = repair.Automaton()
    assert len(lr.entries) == 5 and len(lr.accepts & set(lr.entries)) == 3
    for word in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(6))):
        stack = (0,)
        for c in word:
            stack = stack and lr.shift(stack, c)
        assert bool(stack and stack[-1] in lr.accepts) == bool(re.fullmatch("(s?(ua)+)?", word))
