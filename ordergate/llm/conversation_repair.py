"""Conversation structure repair by generalised LR parsing over the role grammar.

The grammar of role initials, S -> empty | B | s B; B -> B P | P; P -> u a, is turned into LR
tables. All stacks that the repaired prefix may have reached are kept at once in a
graph-structured stack, whose nodes (state, node below) are shared between stacks. A row is
kept (its initial is shifted), rerolled to user or assistant, or deleted, and rows
may be inserted anywhere; stacks whose tops are one node merge, and the least
(cost, audit) stays. Reductions that every lookahead allows are made at once, so equal
prefixes meet in equal tops, and a prefix has few of them however long it is.

Rows are range-partitioned and sorted by conversation and place, so a task streams over
whole conversations and a conversation of any length lies on as many tasks as it fills.
One inside a task is repaired there. Others are cut into segments, each of which gives
the least (cost, audit) from every stack it may start with to every stack it may
end with; these are chained in order. Only the result's own columns need a
conversation in one task: its audit, and the SHA-256 over its repaired lines, which is read
as a stream.

Defined results: null roles and texts count as one space, null turns come first, rows with null
ids are one conversation; rows of one turn are ordered by role and the SHA-256 of their text (repeated
rows are interchangeable); a conversation without rows gives zeros, an empty audit and the hash of
nothing; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import store

GRAMMAR = [("S", ""), ("S", "B"), ("S", "sB"), ("B", "BP"), ("B", "P"), ("P", "ua")]
ROLES = {"u": "user", "a": "assistant"}     # roles that may be given to a row or inserted
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, CUT = range(4)      # a row's first fault
SEGMENT_ROWS, SEGMENT_BYTES = 256, 1 << 20
PAIRS = ("su", "ua", "au")                  # initials that may follow each other
SPACE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------------ LR tables and the stack

class Stacks:
    """LR tables of a grammar and the nodes of a graph-structured stack over them."""

    def __init__(self, rules=GRAMMAR, start: str = "S"):
        self.rules = [("", start), *rules]
        self.names = {left for left, _ in rules}
        self.follow = self._follow(start)
        self.states: list[frozenset] = []
        self.go: dict[tuple[int, str], int] = {}
        self._build()
        self.alone = [self._only_reduction(items) for items in self.states]
        self.below: list[tuple[int, int]] = []         # (state, node below) of each node
        self.number: dict[tuple[int, int], int] = {}
        self.shifted: dict[tuple[int, str], tuple[int, ...]] = {}
        self.root = self._node(0, -1)

    def _closure(self, items) -> frozenset:
        todo, seen = list(items), set(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right) and right[dot] in self.names:
                for i, (left, _) in enumerate(self.rules):
                    if left == right[dot] and (i, 0) not in seen:
                        seen.add((i, 0))
                        todo.append((i, 0))
        return frozenset(seen)

    def _build(self) -> None:
        self.states.append(self._closure([(0, 0)]))
        at = 0
        while at < len(self.states):
            after: dict[str, list] = {}
            for rule, dot in sorted(self.states[at]):
                right = self.rules[rule][1]
                if dot < len(right):
                    after.setdefault(right[dot], []).append((rule, dot + 1))
            for symbol, kernel in sorted(after.items()):
                items = self._closure(kernel)
                if items not in self.states:
                    self.states.append(items)
                self.go[at, symbol] = self.states.index(items)
            at += 1

    def _follow(self, start: str) -> dict[str, set[str]]:
        empty, first, follow = set(), {n: set() for n in self.names}, {n: set() for n in self.names}
        follow[start].add("$")
        while True:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for left, right in self.rules[1:]:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first[x] if x in self.names else {x}
                    if x not in empty:
                        break
                trail = set(follow[left])
                for x in reversed(right):
                    if x in self.names:
                        follow[x] |= trail
                        trail = first[x] | (trail if x in empty else set())
                    else:
                        trail = {x}
            if before == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                return follow

    def _only_reduction(self, items) -> int | None:
        """The rule that a state reduces by whatever comes next, if it can do nothing else."""
        if len(items) == 1:
            rule, dot = next(iter(items))
            if rule and dot == len(self.rules[rule][1]):
                return rule
        return None

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self.number:
            self.number[state, below] = len(self.below)
            self.below.append((state, below))
        return self.number[state, below]

    def _reduce(self, node: int, rule: int) -> int:
        left, right = self.rules[rule]
        for _ in right:
            node = self.below[node][1]
        return self._node(self.go[self.below[node][0], left], node)

    def _ready(self, node: int, symbol: str) -> Iterator[int]:
        """The tops that reductions before ``symbol`` lead to, the node itself first."""
        todo = [node]
        while todo:
            node = todo.pop()
            yield node
            for rule, dot in sorted(self.states[self.below[node][0]]):
                left, right = self.rules[rule]
                if rule and dot == len(right) and symbol in self.follow[left]:
                    todo.append(self._reduce(node, rule))

    def shift(self, node: int, symbol: str) -> tuple[int, ...]:
        """The tops after ``symbol``; none if it cannot come here."""
        if (node, symbol) not in self.shifted:
            out = []
            for top in self._ready(node, symbol):
                state = self.go.get((self.below[top][0], symbol)) if symbol not in self.names else None
                if state is None:
                    continue
                top = self._node(state, top)
                while self.alone[self.below[top][0]] is not None:
                    top = self._reduce(top, self.alone[self.below[top][0]])
                out.append(top)
            self.shifted[node, symbol] = tuple(out)
        return self.shifted[node, symbol]

    def accepts(self, node: int) -> bool:
        return any((0, 1) in self.states[self.below[top][0]] for top in self._ready(node, "$"))

    def reachable(self) -> list[int]:
        """Every top that some prefix of roles leads to, in a fixed order."""
        out = [self.root]
        for node in out:
            for symbol in "sua":
                out += [n for n in self.shift(node, symbol) if n not in out]
        return out


Front = dict[int, tuple[int, str]]     # stack top -> least (cost, audit)


class Repairer:
    """Moves the front of all stacks over the rows of a conversation."""

    def __init__(self):
        self.stacks = Stacks()
        self.tops = self.stacks.reachable()
        self.place = {node: i for i, node in enumerate(self.tops)}

    def start(self) -> Front:
        return self._inserted({self.stacks.root: (0, "")})

    def step(self, front: Front, initial: str, fault: int) -> Front:
        out: Front = {}
        more = TRUNCATED if fault == CUT else 0
        for node, (cost, audit) in front.items():
            _least(out, node, cost + DELETE, audit + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            for top in self.stacks.shift(node, initial):
                _least(out, top, cost + more, audit + "K")
            for role in ROLES:
                for top in self.stacks.shift(node, role):
                    _least(out, top, cost + REROLE + more, audit + "R")
        return self._inserted(out)

    def _inserted(self, front: Front) -> Front:
        todo = list(front)
        while todo:
            node = todo.pop()
            cost, audit = front[node]
            for role in ROLES:
                for top in self.stacks.shift(node, role):
                    if _least(front, top, cost + INSERT, audit + "I"):
                        todo.append(top)
        return front

    def finish(self, front: Front) -> tuple[int, str]:
        return min(value for node, value in front.items() if self.stacks.accepts(node))

    def rows(self, front: Front, rows) -> Front:
        for _, role, _, fault in rows:
            front = self.step(front, role[:1], fault)
        return front


def _least(front: Front, node: int, cost: int, audit: str) -> bool:
    # Equal costs at one place of a conversation never belong to an audit and its beginning,
    # so the smaller audit stays smaller whatever follows.
    if node not in front or (cost, audit) < front[node]:
        front[node] = (cost, audit)
        return True
    return False


class Repaired:
    """SHA-256 over the repaired lines, fed edit by edit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.hash, self.lines = audit, 0, "", hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.last = role[:1]

    def _due(self) -> str:
        return ROLES["a" if self.last == "u" else "u"]

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._line(self._due(), "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self._due(), text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


# ------------------------------------------------------------------ rows after damage

def damaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, digest, dropped: damage by the contract's rule. A dropped row stays, marked,
    so its conversation does not vanish."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds digest, row (a number fixed by writing) and fault, the row's first fault."""
    visible = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id(),
        "fault": F.when(visible == "", F.lit(BLANK)).when(F.right(visible, F.lit(1)).isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(CUT))})
    rows = store(rows, "damaged")
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"), F.col("row").alias("row"))
    # Only what occurs several times has a partner; a hot one is counted before the shuffle
    # and split in the join.
    several = (rows.where(~F.col("dropped") & (F.col("fault") != BLANK)).groupBy("conv_id", "role", "digest")
               .agg(F.count("*").alias("_n"), F.min(order).alias("_first")).where("_n > 1")
               .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first"))
    several = store(several, "said-before")
    same = rows["conv_id"].eqNullSafe(several["_conv"]) & (rows["role"] == several["_role"]) & (rows["digest"] == several["_digest"])
    again = ~F.col("dropped") & (F.col("fault") != BLANK) & F.coalesce(order > F.col("_first"), F.lit(False))
    return rows.join(several, same, "left").select(
        "conv_id", "turn", "role", "digest", "row", "text", "dropped", F.when(again, F.lit(DUPLICATE)).otherwise(F.col("fault")).alias("fault"))


# ------------------------------------------------------------------ segments

COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _segment_schema(kind: str) -> str:
    return (f"conv_id {kind}, place bigint, whole boolean, n_rows bigint, least_turn bigint, most_turn bigint, turns bigint, head string, "
            "tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, sha string, "
            "ways array<struct<before:int,after:int,cost:bigint,audit:string>>, lines array<struct<role:string,text:string>>")


def _figures(rows) -> dict:
    """What a run of rows adds to its conversation's counts (rows: turn, role, text, fault)."""
    turns = [t for t, *_ in rows if t is not None]
    initials = [role[:1] for _, role, _, _ in rows]
    faults = [f for *_, f in rows]
    return {"n_rows": len(rows), "least_turn": min(turns, default=None), "most_turn": max(turns, default=None), "turns": len(set(turns)),
            "head": initials[0] if rows else None, "tail": initials[-1] if rows else None, "blank": faults.count(BLANK),
            "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(a + b not in PAIRS for a, b in zip(initials, initials[1:]))}


def _segment(repairer: Repairer, conv, place: int, rows: list, starts: bool, ends: bool) -> dict:
    out = {"conv_id": conv, "place": place, "whole": starts and ends, **_figures(rows)}
    if starts and ends:
        cost, audit = repairer.finish(repairer.rows(repairer.start(), rows))
        hashed = Repaired(audit)
        for _, role, text, _ in rows:
            hashed.row(role, text)
        return out | {"cost": cost, "audit": audit, "sha": hashed.digest()}
    ways = []
    for before in [-1] if starts else range(len(repairer.tops)):
        front = repairer.start() if starts else {repairer.tops[before]: (0, "")}
        ways += [{"before": before, "after": repairer.place[node], "cost": cost, "audit": audit}
                 for node, (cost, audit) in sorted(repairer.rows(front, rows).items())]
    return out | {"ways": ways, "lines": [{"role": role, "text": text} for _, role, text, _ in rows]}


def segments(rows: DataFrame) -> DataFrame:
    """Repaired conversations (whole) and segments of those that a task does not hold as a whole."""
    keys = ["conv_id", "turn", "role", "digest", "row"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "fault", "dropped")
    schema = _segment_schema(rows.schema["conv_id"].dataType.simpleString())

    def run(batches):
        repairer = Repairer()
        place = TaskContext.get().partitionId() << 40
        conv, held, size, starts, begun = None, [], 0, False, False
        arrow = None
        for batch in batches:
            out = []
            if arrow is None:
                arrow = _arrow(batch.schema.field(0).type)
            for c, turn, role, text, fault, dropped in zip(*(x.to_pylist() for x in batch.columns)):
                if begun and c != conv:
                    out.append(_segment(repairer, conv, place, held, starts, True))
                    place += 1
                    held, size, starts = [], 0, True
                elif len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                    out.append(_segment(repairer, conv, place, held, starts, False))
                    place += 1
                    held, size, starts = [], 0, False
                conv, begun = c, True
                if not dropped:
                    held.append((turn, role, text, fault))
                    size += len(text)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if begun:
            yield pa.RecordBatch.from_pylist([_segment(repairer, conv, place, held, starts, False)], arrow)
    return ordered.mapInArrow(run, schema)


def _arrow(conv: pa.DataType) -> pa.Schema:
    way = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    line = pa.struct([("role", pa.string()), ("text", pa.string())])
    number = [(n, pa.int64()) for n in ("n_rows", "least_turn", "most_turn", "turns")]
    return pa.schema([("conv_id", conv), ("place", pa.int64()), ("whole", pa.bool_()), *number, ("head", pa.string()), ("tail", pa.string()),
                      *[(n, pa.int64()) for n in COUNTS], ("audit", pa.string()), ("sha", pa.string()),
                      ("ways", pa.list_(way)), ("lines", pa.list_(line))])


class _Chain:
    """One conversation's segments, read in order."""

    def __init__(self, repairer: Repairer):
        self.repairer = repairer
        self.front = {repairer.place[n]: v for n, v in repairer.start().items()}
        self.settled: list[str] = []     # what all audits of the front begin with
        self.total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.most = self.tail = None
        self.turns = 0

    def add(self, s: dict) -> None:
        for name in self.total:
            self.total[name] += s[name]
        if s["turns"]:
            self.turns += s["turns"] - (self.most is not None and self.most == s["least_turn"])
            self.least = s["least_turn"] if self.least is None else self.least
            self.most = s["most_turn"]
        if s["n_rows"]:
            if self.tail is not None:
                self.total["illegal"] += self.tail + s["head"] not in PAIRS
            self.tail = s["tail"]
        front: Front = {}
        for way in s["ways"]:
            if way["before"] < 0:
                _least(front, way["after"], way["cost"], way["audit"])
            elif way["before"] in self.front:
                cost, audit = self.front[way["before"]]
                _least(front, way["after"], cost + way["cost"], audit + way["audit"])
        common = os.path.commonprefix([audit for _, audit in front.values()])
        self.settled.append(common)
        self.front = {node: (cost, audit[len(common):]) for node, (cost, audit) in front.items()}

    def result(self) -> dict:
        cost, audit = self.repairer.finish({self.repairer.tops[i]: v for i, v in self.front.items()})
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, **self.total, "cost": cost, "audit": "".join(self.settled) + audit}


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_RESULT = [(n, pa.int64()) for n in ("gaps", *COUNTS)] + [("audit", pa.string())]


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def chained(parts: DataFrame) -> DataFrame:
    """The results of conversations that were cut into segments, but for the hash; a task holds one segment
    and one audit at a time."""
    names = ["conv_id", "n_rows", "least_turn", "most_turn", "turns", "head", "tail", "blank", "duplicate", "truncated", "illegal", "ways"]

    def run(batches):
        repairer = Repairer()
        conv, chain, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *_RESULT])
            out = []
            for row in batch.to_pylist():
                if chain is None or row["conv_id"] != conv:
                    if chain is not None:
                        out.append({"conv_id": conv, **chain.result()})
                    conv, chain = row["conv_id"], _Chain(repairer)
                chain.add(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if chain is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **chain.result()}], schema)
    kind = parts.schema["conv_id"].dataType.simpleString()
    return _by_conversation(parts.select("place", *names), "place").select(*names).mapInArrow(run, f"conv_id {kind}, {RESULT}")


def hashed(results: DataFrame, parts: DataFrame) -> DataFrame:
    """``results`` with the SHA-256 of the repaired lines, which come one by one, in order, after their audit."""
    names = [n for n, _ in _RESULT]
    kind = parts.schema["conv_id"].dataType.simpleString()
    lines = parts.select("conv_id", "place", F.posexplode("lines").alias("at", "line")).select(
        "conv_id", "place", "at", "line.role", "line.text")
    both = results.withColumns({"place": F.lit(-1).cast("bigint"), "at": F.lit(0)}).unionByName(lines, allowMissingColumns=True)

    def run(batches):
        current, state, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *_RESULT, ("sha", pa.string())])
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for conv, place, role, text, *figures in zip(*columns):
                if place < 0:
                    if state is not None:
                        out.append(current | {"sha": state.digest()})
                    current = {"conv_id": conv, **dict(zip(names, figures))}
                    state = Repaired(current["audit"])
                else:
                    state.row(role, text)
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([current | {"sha": state.digest()}], schema)
    ordered = _by_conversation(both, "place", "at").select("conv_id", "place", "role", "text", *names)
    return ordered.mapInArrow(run, f"conv_id {kind}, {RESULT}, sha string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of conversations given as rows
    (conv_id, turn, role, text, dropped)."""
    found = store(segments(with_faults(rows)), "segments")
    parts = found.where(~F.col("whole"))
    names = [n for n, _ in _RESULT]
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    whole = found.where("whole").withColumn("gaps", gaps).select("conv_id", *names, "sha")
    results = store(chained(parts), "chained")
    return whole.unionByName(hashed(results, parts)).withColumnRenamed("sha", "repaired_sha256")


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """:func:`repair` of the conversations after damage."""
    return repair(damaged(conversations, conv_col, turn_col, role_col, text_col))


# ------------------------------------------------------------------ SQL

def _plus(value: str, cost: int | str, edit: str) -> str:
    """SQL of a (cost, audit) text, twelve digits and the audit, with one more edit."""
    return (f"CASE WHEN {value} IS NULL THEN NULL ELSE lpad(CAST(CAST(left({value}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') "
            f"|| substr({value}, 13) || '{edit}' END")


def sql() -> str:
    """DuckDB SQL: one least (cost, audit) for each state of an automaton (0 nothing yet, 1 after the system
    row, 2 after a user row, 3 after an assistant row), carried over the rows by recursion."""
    delete = {s: _plus(f"s{s}", DELETE, "D") for s in range(4)}
    kept = "fault IN (0, 3)"
    more = f"CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END"

    def moved(s: int, initial: str, rerole: bool = True) -> list[str]:
        keep = f"CASE WHEN {kept} AND initial = '{initial}' THEN {_plus(f's{s}', more, 'K')} END"
        return [keep] + [f"CASE WHEN {kept} THEN {_plus(f's{s}', f'{REROLE} + {more}', 'R')} END"] * rerole

    def least(*of: str) -> str:
        return f"list_min([{', '.join(of)}])"
    step = (f"SELECT conv_id, i, {delete[0]} AS t0, {least(delete[1], *moved(0, 's', False))} AS t1, "
            f"{least(delete[2], *moved(0, 'u'), *moved(1, 'u'), *moved(3, 'u'))} AS t2, {least(delete[3], *moved(2, 'a'))} AS t3 "
            "FROM (SELECT r.conv_id, f.i, s0, s1, s2, s3, fault, initial FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1)")
    inserted = f"SELECT *, {least('t2', *[_plus(t, INSERT, 'I') for t in ('t0', 't1', 't3')])} AS u2 FROM ({step})"
    nothing = "'" + "0" * 12 + "'"
    one = f"lpad('{INSERT}', 12, '0') || 'I'"
    two = f"lpad('{2 * INSERT}', 12, '0') || 'II'"
    return rf"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, y:
                            CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
                    lambda x, y: xor(crc[CAST((xor(x, y) & 255) + 1 AS INT)], x >> 8))) % 20 AS kind FROM k, c),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM h)),
o AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role COLLATE "C", sha256(text)) AS i,
             right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                     WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {nothing} AS s0, CAST(NULL AS VARCHAR) AS s1, {one} AS s2, {two} AS s3 FROM conversations
      UNION ALL
      SELECT conv_id, i, t0, t1, u2, {least('t3', _plus('u2', INSERT, 'I'))} FROM ({inserted})),
e AS (SELECT conv_id, least(s0, s3) AS v FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
w AS (SELECT conv_id, unnest(range(1, len(v) - 11)) AS p, v[p + 12] AS edit,
             len(replace(v[13:p + 12], 'I', '')) AS i FROM e),
l AS (SELECT w.conv_id, p, edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
             row_number() OVER (PARTITION BY w.conv_id ORDER BY p) AS q,
             first_value(edit = 'K' AND f.initial = 's') OVER (PARTITION BY w.conv_id ORDER BY p) AS s
      FROM w LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i AND edit <> 'I' WHERE edit <> 'D'),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - CAST(s AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                 || ':' || text, chr(10) ORDER BY p) AS lines FROM l GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
             count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(v, 12) AS BIGINT) AS cost, substr(v, 13) AS audit,
       sha256(coalesce(lines, '')) AS repaired_sha256
FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON e.conv_id IS NOT DISTINCT FROM z.conv_id"""
