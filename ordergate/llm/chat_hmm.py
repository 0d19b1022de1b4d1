"""Chat formatting: roles of raw transcripts by a hidden Markov model.

A transcript is rows of raw text in order; their lines form one stream. Each line
has a hidden state: a role, and whether the line begins a turn. Observed are the
speaker marker in front of it, whether a blank line precedes, its length and a closing
question mark. Viterbi finds the likeliest states; the canonical rendering opens a
turn with ``<|role|>``, drops the marker and closes it with ``<|end|>``.

The model is counted from labelled transcripts. Rows are range-partitioned and sorted by
transcript and place, so that a transcript with most of the rows, or with no places at all, lies
on many tasks; their number in that order cuts long transcripts into segments of at most SEGMENT rows: a segment's lines condense into a max-plus matrix
(best score from any state before to any state at its end), matrices combine FAN at
a time until one per transcript is left, and the states at the borders come back down the
same tree. The result is that of Viterbi over the whole transcript, and no task
holds more than a segment or FAN matrices.

Defined results: every line is rendered as it is, but for the marker that opened its turn and for blank
lines before a transcript's first turn or directly before a line of the same row that
begins a turn; null and empty texts have no lines and render as nothing; the last row
of a transcript closes its last turn; rows with equal place are ordered by the first
KEY_CHARS characters of their text, then by its SHA-256 (repeated rows are interchangeable); null
transcript ids are one transcript; null places come first; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import store

ROLES = ("system", "user", "assistant")
#: Speaker names per role, in lower case.
NAMES = {"system": ("system", "instruction", "instructions", "context", "note"),
         "user": ("user", "human", "customer", "question", "q", "prompt", "you", "client"),
         "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "support")}
STATES = 2 * len(ROLES)  # 2 * role + 1 for a line that continues a turn
SEGMENT, FAN = 256, 256
KEY_CHARS = 32
LENGTHS = (24, 80, 240)  # bounds of the length classes
FEATURES = (len(ROLES) + 1, 2, len(LENGTHS) + 1, 2)  # marker, after a blank line, length, question

_OF = {name: i + 1 for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(r"^[\s#*\[<>|_-]*(" + "|".join(sorted(_OF, key=len, reverse=True)) + r")\b[\s*\]>|_]*(?:[:>\]]|\*\*|-\s)[\s*]*"
                    r"|^[\s]*(?:\*\*|\[|<\|?|#+\s*)(" + "|".join(sorted(_OF, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*$", re.I)


def observed(text: str | None) -> list[tuple[str, str, tuple[int, ...]]]:
    """(line, line without its marker, features) of each line that is not blank."""
    out, blank = [], False
    for line in _split(text):
        if not line.strip():
            blank = True
            continue
        m = MARKER.match(line)
        name = (m.group(1) or m.group(2)).lower() if m else None
        rest = line[m.end():] if m else line
        size = sum(len(rest) >= b for b in LENGTHS)
        out.append((line, rest, (_OF.get(name, 0), int(blank), size, int(line.rstrip().endswith("?")))))
        blank = False
    return out


def _split(text: str | None) -> list[str]:
    lines = (text or "").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def blank_runs(text: str | None) -> list[list[str]]:
    """The blank lines before each line that is not blank, and after the last one."""
    out = [[]]
    for line in _split(text):
        if line.strip():
            out.append([])
        else:
            out[-1].append(line)
    return out


@dataclass
class Model:
    first: np.ndarray          # log weight of each state for a transcript's first line
    change: np.ndarray         # log weight of a state after another
    emit: list[np.ndarray]     # per feature, log weight of each value in each state

    def scores(self, features: list[tuple[int, ...]]) -> np.ndarray:
        f = np.array(features, np.int64).reshape(-1, len(FEATURES))
        return sum(table[:, f[:, k]].T for k, table in enumerate(self.emit))

    def step(self, row: np.ndarray) -> np.ndarray:
        """Max-plus matrix of one line."""
        return self.change + row[None, :]


def smooth(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum(-1, keepdims=True))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def best_path(matrices: list[np.ndarray], entry: np.ndarray, exit_state: int | None) -> list[int]:
    """States after each matrix on the best way from the ``entry`` scores to ``exit_state``
    (None: any); the smaller state wins ties."""
    score, back = entry, []
    for m in matrices:
        way = score[:, None] + m
        back.append(way.argmax(0))
        score = way.max(0)
    state = int(score.argmax()) if exit_state is None else exit_state
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


NO_STATE = -1


def entry_scores(state: int) -> np.ndarray:
    return np.where(np.arange(STATES) == state, 0.0, -np.inf)


def _segment_matrices(model: Model, lines, opens: bool) -> list[np.ndarray]:
    """One matrix per line; where the transcript opens, the first line's does not depend on the state before."""
    scores = model.scores([f for *_, f in lines])
    out = [model.step(row) for row in scores]
    if opens and out:
        out[0] = np.repeat((model.first + scores[0])[None], STATES, 0)
    return out


def _rows(group: pa.Table) -> list[tuple]:
    """(number, place, text) in order."""
    return sorted(zip(group["number"].to_pylist(), group["place"].to_pylist(), group["text"].to_pylist()), key=lambda r: r[0])


def _lines(rows: list[tuple]) -> list[list[tuple]]:
    """Lines of each row of a segment; a row's end is no blank line."""
    return [observed(text) for *_, text in rows]


_PART = 33     # bits of a row's number within its partition


def segments(transcripts: DataFrame, id_col: str, place_col: str, text_col: str, segment: int) -> DataFrame:
    """(conv_id, place, text, number, segment, head, tail): rows of a transcript in order by number, in runs of at most
    ``segment`` rows; its first and last run."""
    keys = ["conv_id", "place", F.left(F.col("text"), F.lit(KEY_CHARS)), F.sha2("text", 256), "salt"]
    rows = transcripts.select(F.col(id_col).alias("conv_id"), F.col(place_col).cast("bigint").alias("place"), F.col(text_col).alias("text"),
                              F.monotonically_increasing_id().alias("salt"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    # Written once: the numbers must not change on a recomputation.
    numbered = store(ordered.withColumn("number", F.monotonically_increasing_id()), "transcripts")
    ends = numbered.groupBy("conv_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    ends = ends.select(F.col("conv_id").alias("_id"), "first", "last")

    def run(number: F.Column) -> F.Column:
        """Counted from the transcript's first row within that row's partition, from the partition's in later ones."""
        parts = F.shiftright(number, _PART) - F.shiftright("first", _PART)
        within = number.bitwiseAND(F.lit((1 << _PART) - 1))
        inner = F.floor(F.when(parts == 0, number - F.col("first")).otherwise(within) / segment).cast("bigint")
        return F.shiftleft(parts, _PART) + inner
    return (numbered.join(ends, numbered["conv_id"].eqNullSafe(ends["_id"]))
            .select("conv_id", "place", "text", "number", run(F.col("number")).alias("segment"),
                    F.lit(0).cast("bigint").alias("head"), run(F.col("last")).alias("tail")))


def _combine(matrices: DataFrame, fan: int) -> DataFrame:
    """Matrices of ``fan`` neighbours as one."""
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["segment"].to_pylist(), group["matrix"].to_pylist()))
        whole = np.frombuffer(rows[0][1]).reshape(STATES, STATES)
        for _, m in rows[1:]:
            whole = product(whole, np.frombuffer(m).reshape(STATES, STATES))
        return pa.table({"conv_id": pa.array([key[0].as_py()], group["conv_id"].type), "segment": [key[1].as_py()], "matrix": [whole.tobytes()]})
    kind = matrices.schema["conv_id"].dataType.simpleString()
    return (matrices.withColumn("up", F.floor(F.col("segment") / fan).cast("bigint")).groupBy("conv_id", "up")
            .applyInArrow(run, f"conv_id {kind}, segment bigint, matrix binary"))


def _borders(matrices: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """(conv_id, segment, before, after): best states at the ends of each matrix, given
    those of the matrix above (before NO_STATE: the transcript opens; after NO_STATE: any)."""
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["segment"].to_pylist(), group["matrix"].to_pylist()))
        before, after = group["before"][0].as_py(), group["after"][0].as_py()
        entry = np.zeros(STATES) if before == NO_STATE else entry_scores(before)
        path = best_path([np.frombuffer(m).reshape(STATES, STATES) for _, m in rows], entry, None if after == NO_STATE else after)
        return pa.table({"conv_id": group["conv_id"], "segment": pa.array([s for s, _ in rows]),
                         "before": pa.array([before, *path[:-1]], pa.int32()), "after": pa.array(path, pa.int32())})
    kind = matrices.schema["conv_id"].dataType.simpleString()
    up = above.select(F.col("conv_id").alias("_c"), F.col("segment").alias("up"), "before", "after")
    rows = matrices.withColumn("up", F.floor(F.col("segment") / fan).cast("bigint"))
    return (rows.join(up, rows["conv_id"].eqNullSafe(up["_c"]) & (rows["up"] == up["up"])).drop(up["up"]).drop("_c").groupBy("conv_id", "up")
            .applyInArrow(run, f"conv_id {kind}, segment bigint, before int, after int"))


def parse(transcripts: DataFrame, model: Model, id_col: str = "conv_id", place_col: str = "turn", text_col: str = "text",
          segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row per input row: conv_id, place, roles (of the turns that its lines begin), role
    (of its first line), rendered. The rendered texts of a transcript, joined in order, are its canonical form."""
    kind = transcripts.schema[id_col].dataType.simpleString()
    rows = segments(transcripts, id_col, place_col, text_col, segment)
    long = rows.where("head < tail")

    def condense(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lines = [x for own in _lines(_rows(group)) for x in own]
        whole = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for m in _segment_matrices(model, lines, key[1].as_py() == group["head"][0].as_py()):
            whole = product(whole, m)
        return pa.table({"conv_id": pa.array([key[0].as_py()], group["conv_id"].type), "segment": [key[1].as_py()], "matrix": [whole.tobytes()]})

    def render(group: pa.Table) -> pa.Table:
        own = _rows(group)
        lines = _lines(own)
        opens, closes = group["segment"][0].as_py() == group["head"][0].as_py(), group["segment"][0].as_py() == group["tail"][0].as_py()
        before, after = group["before"][0].as_py(), group["after"][0].as_py()
        entry = np.zeros(STATES) if before in (None, NO_STATE) else entry_scores(before)
        path = iter(best_path(_segment_matrices(model, [x for r in lines for x in r], opens), entry,
                              None if after in (None, NO_STATE) else after))
        open_turn = before not in (None, NO_STATE)
        out = {"place": [r[1] for r in own], "role": [], "roles": [], "rendered": []}
        for k, row in enumerate(lines):
            states, parts = [next(path) for _ in row], []
            *blanks, trailing = blank_runs(own[k][2])
            for (line, rest, f), blank, s in zip(row, blanks, states):
                begins = s % 2 == 0 or not open_turn
                if begins:
                    parts.append(("<|end|>\n" if open_turn else "") + f"<|{ROLES[s // 2]}|>\n")
                else:
                    parts += [x + "\n" for x in blank]
                # A marker is dropped only where it opened the turn of its own role.
                parts.append(rest + "\n" if begins and f[0] and rest.strip() else "" if begins and f[0] else line + "\n")
                open_turn = True
            if open_turn:
                parts += [x + "\n" for x in trailing]
            if closes and k == len(lines) - 1 and open_turn:
                parts.append("<|end|>\n")
            out["role"].append(ROLES[states[0] // 2] if states else None)
            out["roles"].append([ROLES[s // 2] for s in states if s % 2 == 0])
            out["rendered"].append("".join(parts))
        return pa.table({"conv_id": group["conv_id"], "place": pa.array(out["place"], pa.int64()), "role": pa.array(out["role"], pa.string()),
                         "roles": pa.array(out["roles"], pa.list_(pa.string())), "rendered": pa.array(out["rendered"], pa.string())})

    if long.isEmpty():
        marked = rows.withColumns({"before": F.lit(None).cast("int"), "after": F.lit(None).cast("int")})
    else:
        levels = [store(long.groupBy("conv_id", "segment").applyInArrow(condense, f"conv_id {kind}, segment bigint, matrix binary"), "matrices")]
        while levels[-1].agg(F.max("segment")).first()[0] > 0:
            levels.append(store(_combine(levels[-1], fan), "matrices"))
        # Above the last level every transcript is one matrix with free ends.
        found = levels[-1].select("conv_id", F.lit(0).cast("bigint").alias("segment"), F.lit(NO_STATE).alias("before"), F.lit(NO_STATE).alias("after"))
        for matrices in reversed(levels):
            found = store(_borders(matrices, found, fan), "borders")
        found = found.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), "before", "after")
        marked = rows.join(found, rows["conv_id"].eqNullSafe(found["_c"]) & (rows["segment"] == found["_s"]), "left").drop("_c", "_s")
    return marked.groupBy("conv_id", "segment").applyInArrow(
        render, f"conv_id {kind}, place bigint, role string, roles array<string>, rendered string")


def train(transcripts: DataFrame, id_col: str = "conv_id", place_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Count a model from labelled rows, each one turn: only sums over lines and over
    pairs of neighbouring rows reach the driver."""
    known = transcripts.where(F.col(role_col).isin(*ROLES)).select(
        F.col(id_col).alias("c"), F.col(place_col).cast("bigint").alias("p"), F.col(text_col).alias("x"), F.col(role_col).alias("r"))

    def lines(batches):
        for batch in batches:
            found: dict[tuple, int] = {}
            for text, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (*_, f) in enumerate(observed(text)):
                    key = (2 * ROLES.index(role) + (i > 0), *f)
                    found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int32()) for i in range(1 + len(FEATURES))]
                                             + [pa.array(list(found.values()), pa.int64())], ["state", "f0", "f1", "f2", "f3", "n"])
    counted = (known.select("x", "r").mapInArrow(lines, "state int, f0 int, f1 int, f2 int, f3 int, n bigint")
               .groupBy("state", "f0", "f1", "f2", "f3").agg(F.sum("n").alias("n")).collect())
    emit = [np.zeros((STATES, k)) for k in FEATURES]
    lengths = np.zeros(STATES)
    for row in counted:
        lengths[row["state"]] += row["n"]
        for k in range(len(FEATURES)):
            emit[k][row["state"], row[f"f{k}"]] += row["n"]
    # Counted per place and role first: many rows at one place are not paired one by one.
    counts = known.groupBy("c", "p", "r").agg(F.count("*").cast("double").alias("n"))
    before = counts.select(F.col("c").alias("_c"), (F.col("p") + 1).alias("_p"), F.col("r").alias("_r"), F.col("n").alias("_n"))
    pairs = (counts.join(before, counts["c"].eqNullSafe(before["_c"]) & (counts["p"] == before["_p"]), "left")
             .groupBy("_r", "r").agg(F.sum(F.col("n") * F.coalesce("_n", F.lit(1.0))).alias("count")).collect())
    first, turns = np.zeros(STATES), np.zeros((len(ROLES), len(ROLES)))
    for row in pairs:
        if row["_r"] is None:
            first[2 * ROLES.index(row["r"])] += row["count"]
        else:
            turns[ROLES.index(row["_r"]), ROLES.index(row["r"])] += row["count"]
    change = np.full((STATES, STATES), -np.inf)
    following = smooth(turns)
    for role in range(len(ROLES)):
        begun, more = lengths[2 * role] + 1, lengths[2 * role + 1]
        stay = (more + 0.5) / (begun + more + 1)
        for s in (2 * role, 2 * role + 1):
            change[s, 2 * role + 1] = np.log(stay)
            change[s, 0::2] = np.log1p(-stay) + following[role]
    opening = np.full(STATES, -np.inf)
    opening[0::2] = smooth(first[0::2])
    return Model(opening, change, [smooth(e) for e in emit])


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """Labelled turns (conv_id, turn, role, text) as raw transcripts would show them: by
    transcript, names with colons, letters, names on lines of their own, or blank lines
    only; one marker in ten is missing."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    text = F.coalesce("text", F.lit(""))

    def named(system, user, assistant):
        return F.when(F.col("role") == "system", system).when(F.col("role") == "user", user).otherwise(assistant)
    marked = (F.when(style == 0, F.concat(named("System: ", "User: ", "Assistant: "), text))
              .when(style == 1, F.concat(named("Note: ", "Q: ", "A: "), text))
              .when(style == 2, F.concat(named("**System**\n", "**Human**\n", "**AI**\n"), text))
              .otherwise(F.concat(F.lit("\n"), text)))
    bare = F.concat(F.lit("\n"), text)
    return turns.withColumn("text", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0, bare).otherwise(marked))
