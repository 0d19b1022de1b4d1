import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ordergate.llm import packing as P
from ordergate.llm.tokens import vocabulary_path, word_ids
from tests.llm.helpers import documents, empty


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def test_level_is_the_best_one():
    """Every placement minimises the sum of squares over all allowed levels."""
    rng = random.Random(2)
    packer, window = P.Packer(64), 64
    for doc in range(3000):
        size = rng.choice([1, 5, 16, 31, 33, 48, 63])
        before = packer.counts.copy()
        list(packer.add(doc, size))
        after = packer.counts.copy()
        after[0] = after[window] = 0

        def placed(level):
            n = before.copy()
            n[level] -= level > 0
            n[level + size] += 1
            n[0] = n[window] = 0
            return int((n ** 2).sum())
        options = [placed(h) for h in range(window - size + 1) if h == 0 or before[h]]
        assert int((after ** 2).sum()) == min(options)


@pytest.mark.parametrize("most_open", [4, 1000])
def test_all_ids_once_and_full_windows(most_open):
    rng = random.Random(3)
    lengths = [rng.choice([1, 2, 63, 64, 65, 200, 17]) for _ in range(700)]
    packer = P.Packer(64, most_open)
    windows = [w for d, n in enumerate(lengths) for w in packer.add(d, n)]
    assert packer.open <= most_open + 1
    windows += packer.finish()
    fill = sorted(sum(n for *_, n in w) for w in windows)
    assert fill[1:] == [64] * (len(windows) - 1)          # at most one window partly filled
    seen = defaultdict(list)
    for w in windows:
        for d, start, n in w:
            seen[d] += range(start, start + n)
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(lengths))


def test_pack_against_the_tokenizer(spark):
    texts = [None, "", "Hello, WORLD!  it's 2024", "é ü ß İ ☃ 日本語", "<|endoftext|> x", "word " * 5000, "tab\tnl\n\x00\x85y"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(0, "repeated"), (None, "no id")]
    tok, ids = tokenizer(), {}
    for i, t in rows[:-2]:
        ids[i] = tok.encode(t or "", add_special_tokens=False).ids + [1]
    pieces = P.pack(documents(spark, rows), window=64).collect()
    got, places = defaultdict(dict), defaultdict(dict)
    for r in pieces:
        own = np.frombuffer(r.ids, "<u4")
        assert len(own) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[(r.doc_id, r.doc_tokens)][r.start] = own.tolist()
        places[r.sequence_id][r.offset] = r.length
    for i, want in ids.items():
        parts = got[(i, len(want))]
        assert [x for s in sorted(parts) for x in parts[s]] == want
    for offsets in places.values():
        at = 0
        for o in sorted(offsets):
            assert o == at
            at += offsets[o]
        assert at <= 64
    assert sum(sum(o.values()) < 64 for o in places.values()) <= 3    # one per task
    again = P.pack(documents(spark, rows), window=64, with_ids=False)
    assert "ids" not in again.columns and again.count() == len(pieces)


def test_empty_table(spark):
    assert P.pack(empty(spark)).collect() == []


def test_words_like_the_tokenizer():
    import pyarrow as pa
    rng = random.Random(4)
    alphabet = "abcdefgéèüßñABCÉ'’.,!$%&*-_=+/0123456789ıſİΣσς日☃́ ẞ<|>"
    words = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(4000)] + ["don't", "we'LL", "'s", "''"]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(500)]
    ids, first = word_ids(vocabulary_path()).of_texts(pa.array(texts, pa.large_string()))
    want = tokenizer().encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == e.ids for a, b, e in zip(first, first[1:], want))
