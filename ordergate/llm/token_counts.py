"""Token counts by a linear longest-match automaton.

A word's pieces are found greedily, the longest vocabulary entry first. The
vocabulary is a trie; when no child continues, the failure link says where
matching goes on after the pieces that the node's text certainly starts with, and
how many pieces those are. So every character is read once, pieces are only
counted, and no text is backed up over.

Words and their splitting are the vocabulary's own (see :mod:`ordergate.llm.tokens`);
a word's end mark is its last character. Every distinct word of a batch is counted once.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ordergate.llm.common import byte_slices, split_words
from ordergate.llm.tokens import _END, _OTHER, _byte_letters, vocabulary_path

END = 0     # the byte that stands for a word's end
_WIDE = 9   # a trie edge is node << _WIDE | byte


class LongestMatch:
    """Trie with failure links and popped-piece counts over byte strings."""

    def __init__(self, pieces):
        self.edges: dict[int, int] = {}
        is_piece, parent = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for b in piece:
                edge = node << _WIDE | b
                child = self.edges.get(edge)
                if child is None:
                    child = self.edges[edge] = len(parent)
                    parent.append((node, b))
                    is_piece.append(False)
                node = child
            is_piece[node] = True
        # Nodes in order of depth: a node's failure link is found through its parent's.
        children: list[list[int]] = [[] for _ in parent]
        for v in range(1, len(parent)):
            children[parent[v][0]].append(v)
        self.fail: list[int] = [-1] * len(parent)
        self.popped: list[int] = [0] * len(parent)
        level = children[0]
        while level:
            for v in level:
                if is_piece[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                u, b = parent[v]
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and z << _WIDE | b not in self.edges:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z << _WIDE | b], n
            level = [c for v in level for c in children[v]]

    def count(self, text: bytes) -> int:
        """Pieces of the whole text; -1 if some of it starts no piece."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = n = 0
        for b in text:
            while (child := edges.get(node << _WIDE | b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = child
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


class Counter:
    """Counts the pieces of white-space separated words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        normalizer = Tokenizer.from_file(path).normalizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        self.matcher = LongestMatch(
            bytes(letters[c] for c in t.removesuffix(_END)) + bytes([END]) * t.endswith(_END)
            for t in spec["model"]["vocab"] if t not in special)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalize = normalizer.normalize_str

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Pieces of each word. A byte that starts no piece (none in byte-level vocabularies) makes its word one piece."""
        other = pc.match_substring_regex(words, _OTHER).to_pylist()
        known: dict[str, int] = {}
        out = np.empty(len(words), np.int64)
        count, split = self.matcher.count, self.split.findall
        for i, (word, strange) in enumerate(zip(words.to_pylist(), other)):
            total = 0
            for part in split(self.normalize(word) if strange else word.lower()):
                n = known.get(part)
                if n is None:
                    n = count(part.encode() + b"\0")
                    n = known[part] = n if n >= 0 else 1
                total += n
            out[i] = total
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process and vocabulary, kept between tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words (white-space separated), n_tokens."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        count = counter(path)
        for batch in batches:
            for row, texts in byte_slices(batch.column(1)):
                words, number, first = split_words(texts)
                total = np.concatenate([[0], np.cumsum(count.of_words(words)[number])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(np.diff(first)), pa.array(np.diff(total[first]))],
                    ["doc_id", "n_words", "n_tokens"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")
