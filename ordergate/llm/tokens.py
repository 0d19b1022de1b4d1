"""Token ids of whole texts, remembered by word.

The vocabulary's pre-tokenizer never lets a piece span white space, and its
normaliser (NFC, white space, lower case) works within words, so the ids of a
text are those of its white-space separated words in order, and each distinct
word of a batch is tokenized once.

Words in Latin letters (below U+0180, where NFC changes nothing) are
lower-cased and split by the vocabulary's own pattern, then merged by the byte
pair merger of tiktoken, loaded with the same merges; a piece's end mark is the
byte NUL. Any other word goes through the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ordergate.llm.common import split_words

#: Words the fast way must not take: control characters, U+0080 to U+00A0, U+0130 (its
#: lower case has two characters), anything from U+0180, and the start of special tokens.
_OTHER = r"[\x00-\x20\x7f-\x{a0}\x{130}\x{180}-\x{10ffff}]|<\|"
_END = "</w>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith(_END)
            return bytes(letters[c] for c in (token[:-len(_END)] if end else token)) + b"\0" * end

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        single = [c for c in letters if letters[c]]  # NUL itself is the end mark
        tokens = [c + _END for c in single] + ["".join(p) for p in pairs] + single
        ranks = {raw(t): i for i, t in enumerate(tokens)}
        self.ids_of_rank = np.array([vocab[t] for t in tokens] + [0], "<u4")
        ranks[b"\0"] = len(tokens)
        self.newline = ranks[b"\n"]
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(f"({pattern})")

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, first id of each word and the end)."""
        other = pc.match_substring_regex(words, _OTHER).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~other))
        newline = pa.scalar("\n", pa.large_string())
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), newline)[0].as_py() + "\n"
        marked = self.pieces.sub("\\1\0", lines.lower()) if len(plain) else ""
        ranks = np.asarray(self.merger.encode_ordinary(marked), np.int64)
        ends = np.flatnonzero(ranks == self.newline)
        counts = np.zeros(len(words), np.int64)
        counts[~other] = np.diff(ends, prepend=-1) - 1
        plain_ids = self.ids_of_rank[ranks[ranks != self.newline]]
        if not other.any():
            return plain_ids, np.concatenate([[0], np.cumsum(counts)])
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pa.array(other)).to_pylist(),
                                                                   add_special_tokens=False)]
        counts[other] = [len(e) for e in encoded]
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(first[-1], "<u4")
        from_other = np.repeat(other, counts)
        ids[from_other] = np.concatenate([np.asarray(e, "<u4") for e in encoded])
        ids[~from_other] = plain_ids
        return ids, first

    def of_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, first id of each text and the end) of a
        large_string column without nulls."""
        words, number, text_first = split_words(column)
        ids, first = self.of_words(words)
        counts = np.diff(first)[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        # The k-th id of a word's use lies k places after the word's first id.
        place = np.arange(ends[-1]) + np.repeat(first[:-1][number] - ends[:-1], counts)
        return ids[place], ends[text_first]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary, kept between tasks."""
    return WordIds(path)
