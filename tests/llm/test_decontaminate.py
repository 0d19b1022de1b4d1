import hashlib
import random
import re

import pytest

from ordergate.llm import decontaminate as D
from tests.llm.helpers import documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        if item is None or not iw:
            continue
        k = min(window, len(iw))
        for s in range(len(iw) - k + 1):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == iw[s:s + k]:
                    hit.update(range(p, p + k))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS hash", "'y' AS window")


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["Ünï", "É", "x9"]
    item = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, item(n)) for i, n in enumerate([20, 13, 14, 40, 5, 3, 1, 12])] + [(8, None), (9, ""), (10, "..."), (None, item(20))]
    items += [(11, items[0][1]), (12, items[3][1].upper()), (100, items[1][1]), (100, items[2][1])]
    docs = []
    for i in range(60):
        parts = [item(rng.choice([0, 3, 30, 200]))]
        if i % 2:
            t = rng.choice(items)[1] or ""
            parts += [t if i % 4 == 1 else ", ".join(t.split()[2:18]), item(rng.choice([0, 10]))]
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "?!"), (63, items[0][1] + " " + items[0][1]), (64, "pad " * 20_000 + items[3][1]), (5, docs[5][1])]
    got = D.decontaminate(documents(spark, docs), benchmark(spark, items)).collect()
    assert len(got) == len(docs)
    want = sorted((i, *brute(t, items)) for i, t in docs)
    assert sorted(tuple(r) for r in got) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    clean = D.drop_contaminated(documents(spark, docs), benchmark(spark, items))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[-1])


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c")]), ([(1, "a b c"), (None, "a b")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    got = D.decontaminate(documents(spark, docs) if docs else empty(spark), benchmark(spark, items)).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got)


def test_long_items_and_texts_of_one_word(spark):
    """An item of 60,000 words, and texts that repeat one word a hundred thousand times, some thousand rows at once."""
    rng = random.Random(11)
    long = " ".join(rng.choices([f"v{i}" for i in range(2000)], k=60_000))
    items = [(1, long), (2, "same " * 13), (3, "other " * 40)]
    docs = [(1, "same " * 100_000), (2, long), (3, "x " + long[1000:3000] + " y"), (4, "same " * 12), (5, "clean words only")]
    got = {r.doc_id: r for r in D.decontaminate(documents(spark, docs), benchmark(spark, items)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (100_000, 100_000, 1)
    assert (got[2].n_hit, got[2].contaminated) == (60_000, True) and got[3].contaminated
    assert got[4].n_hit == got[5].n_hit == 0


def test_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS", 3)
    items = [(i, " ".join(f"w{j % 7}" for j in range(i + 10))) for i in range(6)]
    docs = [(i, " ".join(f"w{j % 7}" for j in range(i * 5))) for i in range(12)]
    got = sorted(tuple(r) for r in D.decontaminate(documents(spark, docs), benchmark(spark, items)).collect())
    assert got == sorted((i, *brute(t, items)) for i, t in docs)


def test_bitmaps_grow_with_the_hashes(spark, monkeypatch):
    """Every hash is marked, few others are, whatever the number; the size has bounds."""
    import numpy as np
    from ordergate.llm import common
    rng = np.random.default_rng(0)
    for n, bits in ((0, 16), (100, 16), (100_000, 20)):
        h = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "hash bigint")
        got = common.bitmap(spark, df).value
        assert len(got) == 1 << (bits - 3)
        assert len(common.marked(got, h)) == n
        other = rng.integers(0, 1 << 64, 100_000, np.uint64)
        assert len(common.marked(got, other)) <= 100_000 * (1.1 / common.SLOTS_PER_HASH) * 2
    monkeypatch.setattr(common, "MOST_SLOT_BITS", 17)
    got = common.bitmap(spark, df).value
    assert len(got) == 1 << 14 and len(common.marked(got, h)) == n
