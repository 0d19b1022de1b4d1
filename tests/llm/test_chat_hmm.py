import itertools

import numpy as np

from ordergate.llm import chat_hmm as C
from ordergate.llm.common import table
from ordergate.llm.registry import QUERIES


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4):
        matrices = [rng.normal(size=(C.STATES, C.STATES)) for _ in range(n)]
        entry = rng.normal(size=C.STATES)

        def score(states, start):
            return entry[start] + sum(m[a, b] for m, a, b in zip(matrices, (start, *states), states))
        for exit_state in (None, 3):
            options = [(score(s, start), s) for start in range(C.STATES) for s in itertools.product(range(C.STATES), repeat=n)
                       if exit_state is None or s[-1] == exit_state]
            assert tuple(C.best_path(matrices, entry, exit_state)) == max(options)[1]


def test_markers():
    for line, role in (("User: hi", 2), ("**AI**", 3), ("[system] x", 1), ("Q: why?", 2), ("### Human", 2), ("A bird: x", 0), ("Assistant > x", 3),
                       ("<|system|>", 1), ("usercode: x", 0), ("plain", 0)):
        got = C.observed(line)
        assert got[0][2][0] == role, line
    assert [(rest, f[1], f[3]) for _, rest, f in C.observed("\n\na?\n\nb\nc\n")] == [("a?", 1, 1), ("b", 1, 0), ("c", 0, 0)]


def test_roles_recovered(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_chat_hmm"](spark, sf)
    truth = table(spark, sf, "conversations")
    rows = got.join(truth.select("conv_id", truth["turn"].alias("place"), truth["role"].alias("true"), "text"), ["conv_id", "place"]).collect()
    assert len(rows) == truth.count()
    # The model is counted on conversations with an even checksum only.
    import zlib
    other = [r for r in rows if zlib.crc32(str(r.conv_id).encode()) % 2]
    assert sum(r.role == r.true for r in other) >= 0.95 * len(other)
    exact = [r for r in rows if r.roles == [r.true] and r.rendered.endswith("<|end|>\n") is False]
    assert sum(r.text.strip().split("\n")[-1] in r.rendered for r in exact) >= 0.99 * len(exact)


def test_segments_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    raw = C.raw_transcripts(table(spark, sf, "conversations"))
    model = C.train(raw)
    from pyspark.sql import functions as F
    whole = raw.drop("role").withColumn("conv_id", F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("conv_id")))
    whole = whole.withColumn("turn", F.col("turn") + 8 * F.crc32(F.col("text").cast("binary")) % 997)   # one long transcript among short ones
    a, b = (sorted(map(tuple, C.parse(whole, model, segment=s, fan=2).select("conv_id", "place", "role", "rendered").collect())) for s in (100_000, 16))
    assert a == b


def test_odd_rows(spark):
    model = C.train(C.raw_transcripts(table(spark, "/root/testdata/sf0.001", "conversations")))
    df = spark.createDataFrame([(1, 0, "User: hi"), (1, 1, None), (1, 2, ""), (1, 3, "Assistant: yo\nmore"), (1, 3, "Assistant: yo\nmore"),
                                (None, 0, "Q: a?"), (2, None, "System: be nice"), (2, 1, "x " * 200_000)], "conv_id bigint, turn bigint, text string")
    df = df.selectExpr("*", "'x' AS segment", "'y' AS place", "'z' AS role", "'w' AS head")
    got = C.parse(df, model).collect()
    assert len(got) == 8
    one = [r for r in sorted(got, key=lambda r: (r.place or 0)) if r.conv_id == 1]
    assert one[0].rendered == "<|user|>\nhi\n" and one[1].rendered == one[2].rendered == "" and one[1].role is None
    assert sum(r.rendered.count("<|end|>") for r in one) == sum(len(r.roles) for r in one)
    assert C.parse(df.limit(0), model).collect() == []


def rebuilt(texts, rendered):
    """Every line of the rows, from the rendering: markers and blank lines before a turn apart."""
    lines = [x for t in texts for x in (t or "").split("\n")[:-1 if (t or "").endswith("\n") else None] if t]
    shown = [x for x in "".join(rendered).split("\n")[:-1] if x not in ("<|end|>", *(f"<|{r}|>" for r in C.ROLES))]
    at = 0
    for line in lines:
        m = C.MARKER.match(line)
        if at < len(shown) and shown[at] in (line, line[m.end():] if m else line):
            at += 1
        else:
            assert not line.strip() or m and not line[m.end():].strip(), (line, shown[at:at + 2])
    assert at == len(shown)


def test_every_line_is_rendered(spark):
    """Paragraph breaks, code with blank lines, trailing blank lines; also across segments."""
    import random
    rng = random.Random(3)
    model = C.train(C.raw_transcripts(table(spark, "/root/testdata/sf0.001", "conversations")))
    kinds = ["User: hi", "Assistant: sure", "", "  ", "def f():", "    return 1", "**Human**", "What?", "\t", "A long line. " * 9]
    rows = [(c, t, rng.choice([None, "", "\n".join(rng.choices(kinds, k=rng.randint(1, 9))) + rng.choice(["", "\n", "\n\n"])]))
            for c in range(12) for t in range(rng.choice([1, 5, 40]))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").repartition(5)
    for segment in (256, 7):
        got = sorted((r.conv_id, r.place, r.rendered) for r in C.parse(df, model, segment=segment, fan=2).collect())
        assert [r[:2] for r in got] == [r[:2] for r in rows]
        for c in range(12):
            rebuilt([t for x, _, t in rows if x == c], [x for y, _, x in got if y == c])


def plain_model():
    """Markers begin turns, other lines continue them."""
    emit = [np.log(np.full((C.STATES, n), 1 / n)) for n in C.FEATURES]
    for s in range(C.STATES):
        marks = np.full(C.FEATURES[0], 0.01)
        marks[s // 2 + 1 if s % 2 == 0 else 0] = 0.97
        emit[0][s] = np.log(marks)
    change = np.full((C.STATES, C.STATES), -np.inf)
    for s in range(C.STATES):
        change[s, 0::2] = np.log(0.1)
        change[s, s | 1] = np.log(0.7)
    first = np.full(C.STATES, -np.inf)
    first[0::2] = np.log(1 / 3)
    return C.Model(first, change, emit)


def test_blank_lines(spark):
    """Kept inside a turn and at a row's end, dropped before the first turn and before a line that begins one."""
    rows = [(1, 0, "\nUser: a\n\nb\n \n"), (1, 1, "\nc\n\n\nAssistant: d\n"), (1, 2, "\n"), (2, 0, "\n\n")]
    got = sorted(C.parse(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"), plain_model()).collect(), key=lambda r: (r.conv_id, r.place))
    assert [r.rendered for r in got] == ["<|user|>\na\n\nb\n \n", "\nc\n<|end|>\n<|assistant|>\nd\n", "\n<|end|>\n", ""]


def test_many_rows_without_id_or_place(spark):
    """A third of the rows without id, a third at one place: segments stay bounded, training does not pair rows."""
    from pyspark.sql import functions as F
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("conv_id"), F.when(F.col("id") % 2 == 0, 5).cast("bigint").alias("turn"),
                                    F.concat(F.lit("User: "), (F.col("id") % 50).cast("string")).alias("text"), F.lit("user").alias("role"))
    found = C.segments(rows, "conv_id", "turn", "text", 100).groupBy("conv_id", "segment").count()
    assert found.agg(F.max("count")).first()[0] <= 100
    counted = C.train(rows.withColumn("turn", F.pmod(F.xxhash64("text"), F.lit(2))))
    assert counted.change.shape == (C.STATES, C.STATES)
    model = C.train(C.raw_transcripts(table(spark, "/root/testdata/sf0.001", "conversations")))
    a, b = (sorted((r.conv_id or 0, r.place or 0, r.rendered) for r in C.parse(rows.drop("role"), model, segment=s, fan=4).collect()) for s in (100, 1_000_000))
    assert a == b and len(a) == 6000


def test_pair_counts_against_brute_force(spark):
    """Roles that follow each other, counted per place, as if every pair of rows had been made."""
    import random
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 2, 3]), rng.choice(C.ROLES), "x") for _ in range(300)]
    model = C.train(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = np.zeros((3, 3))
    for c, p, r, _ in rows:
        for c2, p2, r2, _ in rows:
            if c == c2 and p is not None and p2 is not None and p2 == p + 1:
                turns[C.ROLES.index(r), C.ROLES.index(r2)] += 1
    following = C.smooth(turns)
    for role in range(3):
        stay = np.exp(model.change[2 * role, 2 * role + 1])
        assert np.allclose(model.change[2 * role, 0::2], np.log1p(-stay) + following[role])
