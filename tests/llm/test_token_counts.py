import json
import random

import pytest

from ordergate.llm import token_counts as C
from ordergate.llm.tokens import vocabulary_path
from tests.llm.helpers import by_id, documents, empty


def greedy(text, pieces):
    longest, n, i = max(map(len, pieces)), 0, 0
    while i < len(text):
        for k in range(min(longest, len(text) - i), 0, -1):
            if text[i:i + k] in pieces:
                break
        else:
            return -1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_automaton_is_greedy(seed):
    rng = random.Random(seed)
    letters = b"abc"
    pieces = {bytes(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(25)} | ({b"a", b"b", b"c"} if seed % 2 else set())
    m = C.LongestMatch(pieces)
    for _ in range(3000):
        text = bytes(rng.choices(letters, k=rng.randint(0, 25)))
        assert m.count(text) == greedy(text, pieces), text


def vocabulary():
    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    letters = C._byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>") for t in spec["model"]["vocab"] if t not in special}


def test_documents_against_greedy(spark):
    pieces, split = vocabulary(), C.counter(vocabulary_path()).split
    rng = random.Random(9)
    words = ["the", "untranslatable", "é", "ça", "don't", "x" * 70, "$$$!!", "2024", "İx", "日本", "Übergrößenträger"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 9, 40])))) for i in range(60)] + [(100, None), (101, " \n "), (102, "same"), (102, "same")]
    rows.append((103, "zq" * 50_000))
    got = C.count_tokens(documents(spark, rows)).collect()
    assert len(got) == len(rows)

    def want(text):
        import unicodedata
        parts = split.findall(unicodedata.normalize("NFC", text or "").lower())
        return len((text or "").split()), sum(greedy(p.encode() + b"\0", pieces) for p in parts)
    assert sorted((r.doc_id, r.n_words, r.n_tokens) for r in got) == sorted((i, *want(t)) for i, t in rows)
    assert by_id(C.count_tokens(documents(spark, rows)))[100].n_tokens == 0
    assert C.count_tokens(empty(spark)).collect() == []
