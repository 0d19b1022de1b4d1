import random
import re

import pytest

from ordergate.llm import license_scan as L
from tests.llm.helpers import by_id, documents, empty

SMALL = [("plain", "a b", True), ("opt", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", False),
         ("gap", "b <<var;match=0..2>> a c", False), ("need", "c <<var;match=1..3>> d", False),
         ("either", "<<var;match=a b|c|>> d d", False), ("lead", "<<beginOptional>>d <<var;match=0..1>><<endOptional>> b b", False)]


def brute(words, using):
    """(label, first, longest end) by backtracking over every place and every end."""
    out = set()
    for label, markup, _ in using:
        pattern = re.compile(L.as_regex(L.parse(markup)))
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[i:j]))]
            if ends:
                out.add((label, i, max(ends)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdx", weights=[4, 4, 3, 4, 1], k=rng.choice([0, 1, 2, 7, 30]))) for _ in range(150)]
    got = by_id(L.scan(documents(spark, list(enumerate(texts))), using=SMALL))
    for i, t in enumerate(texts):
        assert {(m.label, m.first, m.after) for m in got[i].matches} == brute(t.split(), SMALL), t
        assert got[i].n_words == len(t.split())
    assert sum(len(r.matches) for r in got.values()) > 200


MIT = """Copyright (c) 2020 Jane Doe and others. Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_mandatory_wording_is_exact(spark):
    rows = [(1, MIT), (2, MIT.replace("free of charge", "for a fee")), (3, "\n * ".join(MIT.split("\n")).upper()),
            (4, MIT.replace("Jane Doe", "The Doe Foundation of Somewhere").replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM"))]
    got = by_id(L.digest(L.scan(documents(spark, rows))))
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["MIT-text", "", "MIT-text", "MIT-text"]
    assert 0.8 < got[1].score < 1 and got[2].score == 0


def test_contract_columns(spark):
    rows = [(1, "Under the MIT-License, UNDER  the mit license; CC BY-NC 4.0"), (2, None), (3, ""), (4, "under the mitt license"),
            (5, "Licensed under the Apache License, Version 2.0. All rights reserved."), (None, "cc by nc"), (None, "cc by nc"),
            (6, "cc byé nc Apache\nLicense Version 22"), (7, "a " * 300_000 + "cc by nc " * 2)]
    got = L.digest(L.scan(documents(spark, rows)))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    r = by_id(got.where("doc_id IS NOT NULL"))
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (13, 3, 0, 8, "cc-by-nc,mit")
    for i in (2, 3):
        assert (r[i].n_words, r[i].n_base, r[i].first_word, r[i].last_word, r[i].base_labels, r[i].labels, r[i].score) == (0, 0, None, None, "", "", 0)
    assert r[4].n_base == 0 and r[6].n_base == 0 and r[6].labels == ""
    assert r[5].base_labels == "apache-2" and r[5].labels == "Apache-2.0-notice,all-rights-reserved,apache-2"
    assert (r[7].n_words, r[7].n_base, r[7].first_word) == (300_006, 2, 300_000)
    assert [x.base_labels for x in got.where("doc_id IS NULL").collect()] == ["cc-by-nc"] * 2


def test_templates_are_sound(spark):
    """Every template compiles, and accepts its own wording without the optional regions."""
    for label, markup, _ in L.templates():
        parts = L.parse(markup)
        words = []
        for p in parts:
            words += [p[1]] if p[0] == "word" else ["x"] * p[1] if p[0] == "gap" else min(p[1], key=len) if p[0] == "either" else []
        one = L.Automaton([(label, markup, False)])
        assert one.matches([one.number.get(w, one.other) for w in words], 0) == [(0, len(words))], label
        assert L.mandatory(parts) >= 2
    with pytest.raises(ValueError):
        L.parse("a <<beginOptional>> b")
    with pytest.raises(ValueError):
        L.Automaton([("nothing", "<<var;match=0..2>>", False)])


def test_states_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_STATES", 2)
    rows = [(i, "a b c d d b b a c") for i in range(5)]
    got = by_id(L.scan(documents(spark, rows, partitions=1), using=SMALL))
    assert {(m.label, m.first, m.after) for m in got[3].matches} == brute(rows[0][1].split(), SMALL)


def test_empty_table(spark):
    assert L.digest(L.scan(empty(spark))).collect() == []
