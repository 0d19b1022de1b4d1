"""License scan by template markup compiled to token automata.

A template is mandatory wording with optional and replaceable regions
(:mod:`ordergate.llm.license_templates`). It is compiled to a position automaton over words: a
bit per position, and for each position the set of those that may follow, where
an optional region adds the ways around it and a replaceable one of up to n
words adds n positions that take any word. All templates, and the bare phrases
as templates without regions, run as one automaton, made deterministic as far as
texts need it. A text is accepted from a place on if its words match all
mandatory wording exactly, in order; of several ends the last one counts.

Only places whose first two words may begin a template are tried; each try ends
after the longest template at the latest, so the work is linear in the text.

Defined results: null text counts as empty; a text without words has no matches and
score 0; repeated rows and null ids are scanned each; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import byte_slices, split_words, translated
from ordergate.llm.license_templates import BASE, TEMPLATES

#: Word bytes: 0-9, a-z and everything beyond ASCII; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ANY = -1
MOST_STATES = 20_000   # deterministic states kept by a task before it starts anew

MARK = re.compile(r"<<\s*(beginOptional|endOptional|var;match=([^>]*))\s*>>")


def words_of(text: str) -> list[str]:
    return text.encode().translate(WORD_BYTES).decode().split()


# A template's parts: ("word", w), ("optional", parts), ("gap", least, most), ("either", [words, ...]).

def parse(markup: str) -> list[tuple]:
    """The parts of a template in order."""
    stack, at = [[]], 0
    for m in MARK.finditer(markup):
        stack[-1] += [("word", w) for w in words_of(markup[at:m.start()])]
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif span := re.fullmatch(r"(\d+)\.\.(\d+)", m[2]):
            stack[-1].append(("gap", int(span[1]), int(span[2])))
        else:
            stack[-1].append(("either", [words_of(x) for x in m[2].split("|")]))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + [("word", w) for w in words_of(markup[at:])]


def mandatory(parts: list[tuple]) -> int:
    """How many words every accepted text has in common, in order."""
    return sum(p[0] == "word" for p in parts)


class Automaton:
    """Position automaton of several templates, determinised on demand."""

    def __init__(self, templates: Iterable[tuple[str, str, bool]]):
        self.labels, self.base, self.length = [], [], []
        self.takes: list = []          # word of each position, or ANY
        self.follow: list[int] = []    # bit set of the positions after each
        self.first = 0
        self.ends: list[int] = []      # per template, its last positions
        for label, markup, base in templates:
            parts = parse(markup)
            empty, first, last = self._parts(parts)
            if empty:
                raise ValueError(f"template {label} accepts a text without words")
            self.labels.append(label)
            self.base.append(base)
            self.length.append(mandatory(parts))
            self.first |= first
            self.ends.append(last)
        self.number = {w: i for i, w in enumerate(sorted({w for w in self.takes if w != ANY}))}
        self.other = len(self.number)  # any word of no template
        everything = sum(1 << i for i, w in enumerate(self.takes) if w == ANY)
        self.accepts = [everything] * (self.other + 1)
        for i, w in enumerate(self.takes):
            if w != ANY:
                self.accepts[self.number[w]] |= 1 << i
        self._reset()
        self.starts = self._starts()

    def _position(self, word) -> tuple[bool, int, int]:
        self.takes.append(word)
        self.follow.append(0)
        bit = 1 << (len(self.takes) - 1)
        return False, bit, bit

    def _link(self, last: int, first: int) -> None:
        for i in _bits(last):
            self.follow[i] |= first

    def _row(self, pieces) -> tuple[bool, int, int]:
        """One piece after the other."""
        empty, first, last = True, 0, 0
        for e, f, l in pieces:
            self._link(last, f)
            first |= f if empty else 0
            last = l | (last if e else 0)
            empty = empty and e
        return empty, first, last

    def _parts(self, parts) -> tuple[bool, int, int]:
        return self._row(self._part(p) for p in parts)

    def _part(self, part) -> tuple[bool, int, int]:
        """(may be empty, first positions, last positions) of a part."""
        kind = part[0]
        if kind == "word":
            return self._position(part[1])
        if kind == "optional":
            _, first, last = self._parts(part[1])
            return True, first, last
        if kind == "gap":
            least, most = part[1:]
            return self._row((i >= least, *self._position(ANY)[1:]) for i in range(most))
        ways = [self._row(self._position(w) for w in words) for words in part[1]]
        empty, first, last = False, 0, 0
        for e, f, l in ways:
            empty, first, last = empty or e, first | f, last | l
        return empty, first, last

    def _reset(self) -> None:
        self.sets, self.names, self.next, self.accepted = [], {}, [], []
        self.root = {}

    def _name(self, bits: int) -> int:
        if bits not in self.names:
            self.names[bits] = len(self.sets)
            self.sets.append(bits)
            self.next.append({})
            self.accepted.append([t for t, last in enumerate(self.ends) if bits & last])
        return self.names[bits]

    def _step(self, state: int | None, word: int) -> int:
        """The state after ``word`` (0-based word number), -1 if no template goes on."""
        table = self.root if state is None else self.next[state]
        if word not in table:
            reach = self.first
            if state is not None:
                reach = 0
                for i in _bits(self.sets[state]):
                    reach |= self.follow[i]
            bits = reach & self.accepts[word]
            table[word] = self._name(bits) if bits else -1
        return table[word]

    def _starts(self) -> np.ndarray:
        """Whether a template may begin with two words (or be the first one alone, then with any second)."""
        n = self.other + 1
        out = np.zeros((n, n + 1), bool)         # the last column: no second word
        for w in range(n):
            state = self._step(None, w)
            if state >= 0:
                done = bool(self.accepted[state])
                out[w] = done
                for v in range(n):
                    out[w, v] |= self._step(state, v) >= 0
        return out

    def matches(self, words: list[int], at: int) -> list[tuple[int, int]]:
        """(template, end) of the longest match of each template from ``at`` on."""
        found: dict[int, int] = {}
        if len(self.sets) > MOST_STATES:
            self._reset()
        state = self._step(None, words[at])
        while state >= 0:
            at += 1
            for t in self.accepted[state]:
                found[t] = at
            if at == len(words):
                break
            state = self._step(state, words[at])
        return sorted(found.items())


def _bits(x: int) -> Iterable[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def templates() -> list[tuple[str, str, bool]]:
    return [(label, phrase, True) for phrase, label in BASE] + [(label, markup, False) for label, markup in TEMPLATES]


MATCH = "array<struct<label:string,base:boolean,first:bigint,after:bigint,mandatory:bigint>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("after", pa.int64()),
                             ("mandatory", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         using: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, matches (label, whether a bare phrase, its words
    [first, after), mandatory words of its template), in text order.

    ``using``: (label, markup, whether a bare phrase); by default the library's templates.
    """
    using = templates() if using is None else using

    def run(batches):
        automaton = Automaton(using)
        for batch in batches:
            n_words, out = [], []
            for _, texts in byte_slices(batch.column(1)):
                words, number, first = split_words(translated(texts, WORD_BYTES))
                known = np.fromiter((automaton.number.get(w, automaton.other) for w in words.to_pylist()), np.int64, len(words))
                ids = known[number]
                n_words.append(np.diff(first))
                out += _found(automaton, ids, first)
            n_words = np.concatenate(n_words) if n_words else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(out, _MATCH)],
                                             ["doc_id", "n_words", "matches"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words bigint, matches {MATCH}")


def _found(automaton: Automaton, ids: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The matches of each text of a slice (word numbers of all texts, first word of each and the end)."""
    out = [[] for _ in range(len(first) - 1)]
    if not len(ids):
        return out
    second = np.append(ids[1:], automaton.other + 1)
    ends = first[1:][np.diff(first) > 0] - 1
    second[ends] = automaton.other + 1           # a text's last word has none after it
    at = np.flatnonzero(automaton.starts[ids, second])
    of = np.searchsorted(first, at, "right") - 1
    words, text = [], None
    for place, t in zip(at.tolist(), of.tolist()):
        if t != text:
            text, words = t, ids[first[t]:first[t + 1]].tolist()
        start = place - int(first[t])
        out[t] += [{"label": automaton.labels[m], "base": automaton.base[m], "first": start, "after": end,
                    "mandatory": automaton.length[m]} for m, end in automaton.matches(words, start)]
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the score is the share of
    a text's words that the mandatory wording of its longest matching template makes up."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    most = F.array_max(F.transform("matches", lambda m: m["mandatory"]))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                          F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                          labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                          F.coalesce(F.try_divide(most.cast("double"), F.col("n_words").cast("double")), F.lit(0.0)).alias("score"))


def as_regex(parts: list[tuple]) -> str:
    """The template over words that are each followed by one space."""
    out = []
    for p in parts:
        if p[0] == "word":
            out.append(p[1] + " ")
        elif p[0] == "optional":
            out.append(f"(?:{as_regex(p[1])})?")
        elif p[0] == "gap":
            out.append(f"(?:[^ ]+ ){{{p[1]},{p[2]}}}")
        else:
            out.append("(?:" + "|".join("".join(w + " " for w in words) for words in p[1]) + ")")
    return "".join(out)


def sql(using: list[tuple[str, str, bool]] | None = None) -> str:
    """DuckDB SQL for :func:`digest`, by regular expressions over the joined words."""
    using = templates() if using is None else using
    base = [(label, words_of(markup)) for label, markup, b in using if b]
    hits = [(label, f"regexp_matches(t, ' {as_regex(parse(markup))}')", mandatory(parse(markup))) for label, markup, _ in using]

    def listed(pairs):
        return ("array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
            f"CASE WHEN {test} THEN '{label}' END" for label, test in pairs) + "], lambda x: x IS NOT NULL))), ',')")
    places = " || ".join(
        "list_filter(range(len(w)), lambda i: w[i + 1:i + {n}] = [{words}])".format(n=len(words), words=", ".join(f"'{x}'" for x in words))
        for _, words in base)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
p AS (SELECT *, {places} AS b FROM j)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base,
       CAST(list_min(b) AS BIGINT) AS first_word, CAST(list_max(b) AS BIGINT) AS last_word,
       {listed([(label, f"regexp_matches(t, ' {as_regex(parse(' '.join(words)))}')") for label, words in base])} AS base_labels,
       {listed([(label, test) for label, test, _ in hits])} AS labels,
       CASE WHEN len(w) = 0 THEN 0.0 ELSE CAST(greatest({", ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for _, test, n in hits)}) AS DOUBLE)
            / len(w) END AS score
FROM p"""
