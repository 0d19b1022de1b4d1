import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from ordergate.llm import exact_dedup as X
from tests.llm.helpers import by_id, documents, empty


def lowered(text):
    return (text or "").encode().lower()


def texts(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "É", "é", "ß", "x" * 40, "\n", "  "]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 400]))) for _ in range(25)]
    base += [None, "", "A" * 9000, "a" * 9000, "long " * 60_000]
    out = base + rng.choices(base, k=40) + [(t or "").upper() for t in rng.choices(base, k=15)]
    return list(zip(rng.sample(range(1000), len(out)), out))


@pytest.mark.parametrize("digest_bytes", [1, 16])
def test_against_brute_force(spark, digest_bytes):
    """One-byte digests collide, are found out and widened."""
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    df = documents(spark, rows)
    if digest_bytes == 1:
        assert X.unverified(df, "text", 1) > 0
    got = by_id(X.exact_dedup(df, digest_bytes=digest_bytes))
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[lowered(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), i == max(own))
        assert r.text_sha256 == hashlib.sha256(lowered(t)).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same"), (7, "Same"), (7, "same"), (None, "same"), (None, "alone"), (2, "other")]
    got = X.exact_dedup(documents(spark, rows)).collect()
    same = [r for r in got if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {7} and [r.kept for r in same].count(True) == 1
    left = X.drop_copies(documents(spark, rows))
    assert set(left.columns) == set(documents(spark, rows).columns)
    assert sorted((r.doc_id or 0, r.text.lower()) for r in left.collect()) == [(0, "alone"), (2, "other"), (7, "same")]


def test_empty_table(spark):
    assert X.exact_dedup(empty(spark)).collect() == []
    assert X.drop_copies(empty(spark)).collect() == []


def test_cuts_follow_content():
    """The same bytes are cut alike wherever they start; bounds hold."""
    rng = np.random.default_rng(3)
    body = rng.integers(0, 256, 50_000, np.uint8).tobytes().lower()
    gear = X._gear()
    parts = [[bytes(c) for c in parts] for _, parts in X._chunked([body, b"short head " + body], gear)]
    assert all(b"".join(p) in (body, b"short head " + body) for p in parts)
    assert all(X.MIN_CHUNK <= len(c) <= X.MAX_CHUNK for p in parts for c in p[:-1])
    assert len(set(parts[0]) & set(parts[1])) > 0.8 * len(parts[0])
