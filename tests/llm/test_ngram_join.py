import random
from collections import defaultdict

import numpy as np
import pytest

from ordergate.llm import ngram_join as N
from ordergate.llm.components import components
from tests.llm.helpers import by_id, documents, empty


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[root(i)].append(d)
    return {d: (len(sets[i]), min(members[root(i)])) for i, (d, _) in enumerate(rows)}


def near_copies(seed):
    """Groups of edited copies, chains of small steps, shared passages, short and odd texts."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: rng.choices(vocab, k=n)
    out = []
    for n in (4, 11, 40, 40, 120):
        base = text(n)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, n // 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(copy)
    step = text(80)
    for _ in range(12):
        step = step[1:] + text(1)
        out.append(list(step))
    passage = text(60)
    out += [passage + text(k) for k in (1, 2, 4, 8, 20, 60)]
    out += [text(3)] * 2 + [["a", "b"]] * 2 + [["B", "A"], ["a"], []]
    ids = rng.sample(range(5000), len(out))
    return [(i, " ".join(w).upper() if k % 7 == 0 else "\t".join(w)) for k, (i, w) in enumerate(zip(ids, out))] + [(9001, None), (9002, " \n ")]


@pytest.mark.parametrize("size,percent,block", [(3, 90, 512), (5, 80, 512), (3, 90, 3), (3, 70, 2)])
def test_against_brute_force(spark, size, percent, block):
    """Small blocks take the large groups through refinement, hub and blockwise search."""
    rows = near_copies(size * percent)
    got = by_id(N.ngram_join(documents(spark, rows), shingle=size, percent=percent, block=block))
    want = brute(rows, size, percent)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert len({c for _, c in want.values()}) < len(rows) - 10


def test_divide_skip_finds_every_link():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = []
    for k in range(60):
        keep = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.06, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)])))
    for percent in (60, 80, 90, 95):
        lists = N.DivideSkip(sets, percent)
        for i, q in enumerate(sets):
            want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
            assert sorted(lists.search(q, lambda d: False)) == want


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_share_a_part(percent):
    """The partition loses no linked pair, whatever the sizes."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.choice([1, 2, 5, 9, 10, 30, 150, 700]))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0, 0.05, 0.15])], rng.integers(0, 1 << 60, rng.integers(0, 1 + n // 8)).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        of, signature, family, surplus = N.part_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        # With any order of the parts, leaving out each set's surplus first ones leaves a common one.
        order = {x: (rng.random() < 0.5, i) for i, x in enumerate(sorted(set(signature.tolist())))}
        kept = [set(), set()]
        for text in (0, 1):
            for f in (0, 1):
                mine = (of == text) & (family == f)
                if mine.any():
                    kept[text] |= set(sorted(signature[mine].tolist(), key=order.get)[surplus[mine][0]:])
        assert kept[0] & kept[1]


def test_repeated_rows_and_empty_table(spark):
    rows = [(4, "one two three four"), (4, "one two three four"), (None, "one two three four"), (2, ""), (2, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in N.ngram_join(documents(spark, rows)).collect())
    assert got == [(0, 2, 4), (2, 0, 2), (2, 0, 2), (4, 2, 4), (4, 2, 4)]
    assert N.ngram_join(empty(spark)).collect() == []
    assert sorted(r.doc_id for r in N.keep_one(documents(spark, [(1, "a b c d"), (2, "A b c d"), (3, "z")])).collect()) == [1, 3]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(420)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i
    for a, b in edges:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for a, b in edges:
        if a != b:
            groups[root(a)] |= {a, b}
    assert set(got) == set().union(*groups.values())
    assert all(len({got[i] for i in g}) == 1 for g in groups.values())
    assert len(set(got.values())) == len(groups)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
