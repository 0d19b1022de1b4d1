import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordergate.llm import quality_crf as Q
from ordergate.llm.common import table
from tests.llm.helpers import by_id, documents, empty


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 6, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, change = rng.normal(size=first[-1]) * 3, rng.normal(size=(2, 2))
    good, pairs, total = Q.marginals(score, first, change)
    want_pairs, want_total = np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        weights, each = [], []
        for states in itertools.product((0, 1), repeat=b - a):
            w = sum(score[a + i] * s for i, s in enumerate(states)) + sum(change[x, y] for x, y in zip(states, states[1:]))
            weights.append(np.exp(w))
            each.append(states)
        z = sum(weights)
        want_total += np.log(z)
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for w, s in zip(weights, each) if s[i]) / z)
        for w, s in zip(weights, each):
            for x, y in zip(s, s[1:]):
                want_pairs[x, y] += w / z
    assert pairs == pytest.approx(want_pairs) and total == pytest.approx(want_total)


def test_lines_and_features():
    texts = ["one\ntwo two\n", "", "HEY!! $$ 12", "\n\n"]
    features, weight, first = Q.line_features(pa.array(texts, pa.large_string()))
    assert np.diff(first).tolist() == [3, 1, 1, 3] and weight.tolist() == [4, 8, 1, 1, 12, 1, 1, 1]
    different = features[:, 7]
    assert different[1] == 0.5 and different[0] == 1
    assert features[4, 1] == pytest.approx(3 / 4) and features[4, 2] == pytest.approx(2 / 12)
    assert features[:, 11].tolist() == [0, 0, 0, 0, 0, 0, 1, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_rows_do_not_train(spark):
    """Wrong labels on held-out rows change nothing."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    spoiled = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (Q.train(docs, x, sample=150) for x in (labels, spoiled))
    assert np.array_equal(a.weights, b.weights) and a.curve == b.curve


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 100_000), (None, "fine text here."), (4, "same"), (4, "same")]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = Q.classify(documents(spark, rows), known).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [True]
        same = [r.score for r in got if r.doc_id == 4]
        assert same[0] == same[1]
    assert Q.classify(empty(spark), labels).collect() == []
    kept = Q.keep_good(documents(spark, rows), labels)
    assert kept.columns == documents(spark, rows).columns


def test_held_out_is_the_contracts_remainder(spark):
    import zlib
    rows = [(i, "t") for i in range(200)]
    got = by_id(Q.classify(documents(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int")))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)


def test_pieces_give_the_marginals(monkeypatch):
    """Chains cut into pieces of three lines, a few at a time, as in one go."""
    monkeypatch.setattr(Q, "PIECE", 3)
    monkeypatch.setattr(Q, "BLOCK_LINES", 7)
    rng = np.random.default_rng(4)
    for lengths in ([1], [3], [4, 1, 2, 20, 3, 6], rng.integers(1, 30, 25).tolist()):
        first = np.concatenate([[0], np.cumsum(lengths)])
        score, change = rng.normal(size=first[-1]) * 5, rng.normal(size=(2, 2)) * 2
        assert Q.good_lines(score, first, change) == pytest.approx(Q.marginals(score, first, change)[0], abs=1e-12)


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    width = 4 * Q.SHAPES + 3
    return Q.Model(rng.normal(size=Q.SHAPES) * 0.1, np.full(Q.SHAPES, 0.7), rng.normal(size=width) * 0.5, rng.normal(size=(2, 2)), (4.0, -2.0))


def test_blocks_change_no_score(monkeypatch):
    import random
    rng = random.Random(6)
    texts = ["\n".join("".join(rng.choices("ab A9!$é.  ", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", "\n\n\n"]
    column, model = pa.array(texts, pa.large_string()), small_model()
    features, weight, first = Q.line_features(column)
    want = 1 / (1 + np.exp(-(4 * model.good_share(features, weight, first) - 2)))
    for block in (1, 5, 1 << 15):
        monkeypatch.setattr(Q, "BLOCK_LINES", block)
        assert model.score(column) == pytest.approx(want, abs=1e-9)


def test_very_many_short_lines_in_bounded_memory():
    """8 MB of one-letter lines in a fresh process: under a gigabyte."""
    import subprocess
    import sys
    code = ("import resource, pyarrow as pa; from tests.llm.test_quality_crf import small_model\n"
            "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "s = small_model().score(pa.array(['a\\n' * 4_000_000], pa.large_string()))\n"
            "print(0 <= s[0] <= 1, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)")
    shown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert shown[0] == "True" and int(shown[1]) < 1000, shown


def test_the_sample_is_bounded_in_all(spark, monkeypatch):
    docs = documents(spark, [(i, ("Good line here.\n" if i % 2 else "!!! $$$\n") * 900) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(Q, "TOTAL_LINES", 4000)
    monkeypatch.setattr(Q, "fit", lambda f, w, first, good: seen.append((len(f), len(w), first[-1], len(good))))
    Q.train(docs, labels)
    assert len(set(seen[0][:3])) == 1 and 2000 <= seen[0][0] <= 4000
