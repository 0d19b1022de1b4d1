import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ordergate.llm import conversation_repair as C
from tests.llm.helpers import CLASHING

SHAPE = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows (turn, role, text) of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append(C.BLANK if not last else C.DUPLICATE if (role, text) in seen else C.FINE if last in ".!?" else C.CUT)
        seen.add((role, text))
    return out


def roles_of(audit, rows):
    """The initials that an audit leads to, or None; rerolled and inserted ones as the shape asks."""
    slots, at = [], 0
    for edit in audit:
        slots += [] if edit == "D" else ["ua"] if edit in "RI" else [rows[at][1][:1] or "-"]
        at += edit != "I"
    return next(("".join(p) for p in itertools.product(*slots) if SHAPE.fullmatch("".join(p))), None)


def price(audit, marks):
    cost, at = 0, 0
    for edit in audit:
        if edit == "I":
            cost += 3
            continue
        if edit != "D" and marks[at] in (C.BLANK, C.DUPLICATE):
            return None
        cost += {"K": 0, "R": 3, "D": 4}[edit] + (3 if edit != "D" and marks[at] == C.CUT else 0)
        at += 1
    return cost


def brute(rows):
    marks, found = faults(rows), []
    for edits in itertools.product("KRD", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:]))
            cost = price(audit, marks)
            if cost is not None and roles_of(audit, rows) is not None:
                found.append((cost, audit))
    cost, audit = min(found)
    lines, at = [], 0
    for edit, initial in zip([e for e in audit if e != "D"], roles_of(audit, rows)):
        lines.append([edit, {"u": "user", "a": "assistant"}.get(initial), ""])
    kept = iter(lines)
    for edit in audit:
        if edit != "D":
            line = next(kept)
            if edit != "I":
                line[1:] = [rows[at][1] if edit == "K" else line[1], rows[at][2]]
        at += edit != "I"
    text = "\n".join(f"{role}:{t}" for _, role, t in lines)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count(C.BLANK), marks.count(C.DUPLICATE), marks.count(C.CUT),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def frame(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(partitions)
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASHING if c not in ("row",)}).withColumn("place", F.lit("x"))


def conversations(seed, n, most=4):
    rng = random.Random(seed)
    out = {}
    for conv in [None, *range(n)]:
        out[conv] = [(conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "human"]),
                      rng.choice(["Yes.", "Hm?\n", "cut off", "", " \t", None, "…", "Go!", "über", "x y."])) for _ in range(rng.randint(1, most))]
    return out


@pytest.mark.parametrize("segment", [256, 1])
def test_against_brute_force(spark, monkeypatch, segment):
    """Whole conversations, and all of them as chains of one-row segments."""
    monkeypatch.setattr(C, "SEGMENT_ROWS", segment)
    talks = conversations(segment, 60, 3)
    rows = [r for t in talks.values() for r in t]
    got = {r[0]: tuple(r[1:]) for r in C.repair_conversations(frame(spark, rows, 3)).collect()}
    assert set(got) == set(talks)
    for conv, t in talks.items():
        assert got[conv] == brute(damage(t)), (conv, t)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A conversation with most of the rows, repeated rows, in small segments: as in one go."""
    rng = random.Random(7)
    rows = [(1, rng.choice([None, *range(300)]), rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"{i}.", ""]))
            for i in range(900)] + [(2, i, "user", "x.") for i in range(40)] + [(1, 5, "user", "same.")] * 50
    whole = Once(rows)
    monkeypatch.setattr(C, "SEGMENT_ROWS", 32)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r[1:]) for r in C.repair_conversations(frame(spark, rows, 8)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == {c: whole.result(c) for c in (1, 2)}


class Once:
    """The dynamic programme over all rows of a conversation at once, by states of the shape."""

    def __init__(self, rows):
        self.rows = rows

    def result(self, conv):
        rows = damage([r for r in self.rows if r[0] == conv])
        marks = faults(rows)
        go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

        def better(best, state, value):
            if state not in best or value < best[state]:
                best[state] = value
                return True

        def inserted(best):
            while any(better(best, go[s, x], (c + 3, a + "I")) for s, (c, a) in list(best.items()) for x in "ua" if (s, x) in go):
                pass
            return best
        best = inserted({0: (0, "")})
        for (_, role, _), mark in zip(rows, marks):
            after = {}
            for s, (c, a) in best.items():
                better(after, s, (c + 4, a + "D"))
                if mark in (C.FINE, C.CUT):
                    more = 3 if mark == C.CUT else 0
                    if (s, role[:1]) in go:
                        better(after, go[s, role[:1]], (c + more, a + "K"))
                    for x in "ua":
                        if (s, x) in go:
                            better(after, go[s, x], (c + 3 + more, a + "R"))
            best = inserted(after)
        cost, audit = min(best[s] for s in (0, 3) if s in best)
        lines, at, last = [], 0, ""
        for edit in audit:
            if edit != "D":
                role = rows[at][1] if edit == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
                last = role[:1]
            at += edit != "I"
        turns = {t for t, *_ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        return (max(turns) - min(turns) + 1 - len(turns), marks.count(C.BLANK), marks.count(C.DUPLICATE), marks.count(C.CUT),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_the_tables_accept_the_shape():
    stacks = C.Stacks()
    assert len(stacks.reachable()) == 8
    for n in range(7):
        for word in itertools.product("suax", repeat=n):
            tops = [stacks.root]
            for x in word:
                tops = [t for top in tops for t in stacks.shift(top, x)]
            assert any(map(stacks.accepts, tops)) == bool(SHAPE.fullmatch("".join(word))), word


def test_conversation_without_rows(spark):
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    rows = [(c, t, "user", "x.") for c, t in gone]
    got = C.repair_conversations(frame(spark, rows)).collect()
    assert len(got) == len({c for c, _ in gone})
    assert {tuple(r[1:]) for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    assert C.repair_conversations(frame(spark, [(1, 1, "user", "x.")]).limit(0)).collect() == []
