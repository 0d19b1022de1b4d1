"""Sum-of-squares online packing into fixed windows of token ids.

Every document is tokenized whole and closed by an end id. Full windows are cut
off first; the rest, shorter than a window, goes online to the fill level that
minimises the sum of squared counts of partially filled windows, which a level
array tracks. Windows still partial at the end of a task (or beyond OPEN of
them, which bounds the state) are merged by cutting their pieces, so a task
leaves at most one window partly filled. No shuffle: a task packs its part of
the scan, reruns give the same sequences, and a task's number leads its
sequence ids.

Defined results: null and empty texts are a document of the end id alone; null
or repeated ids are packed like others; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import byte_slices
from ordergate.llm.tokens import vocabulary_path, word_ids

WINDOW = 2048
END_ID = 1
OPEN = 8192  # partial windows a task keeps open before it merges the fullest half

Piece = tuple[int, int, int]  # document, start, length


class Packer:
    """Places pieces; closed windows are lists of pieces in order."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)  # partial windows per fill level
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.open = 0

    def add(self, doc: int, length: int) -> Iterator[list[Piece]]:
        """Place a document's ids; yields the windows that this closes."""
        whole = length - length % self.window
        for start in range(0, whole, self.window):
            yield [(doc, start, self.window)]
        size = length - whole
        if not size:
            return
        n = self.counts
        # Change of the sum of squares when a window moves from level h to h + size.
        after = n[size:self.window + 1]
        change = 2 * (after - n[:self.window - size + 1])
        change[0] = 2 * n[size] + 1                      # a new window
        change[1:] += 2
        if size < self.window:
            change[-1] = 1 - 2 * n[self.window - size]   # the window closes
        change[1:][n[1:self.window - size + 1] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin())
        pieces = self.levels[level].pop() if level else []
        if level:
            n[level] -= 1
            self.open -= 1
        pieces.append((doc, whole, size))
        if level + size == self.window:
            yield pieces
            return
        self.levels[level + size].append(pieces)
        n[level + size] += 1
        self.open += 1
        if self.open > self.most_open:
            yield from self.merge(self.open // 2, last=False)

    def merge(self, how_many: int, last: bool) -> Iterator[list[Piece]]:
        """Join partial windows, fullest first, cutting pieces at the window's end.
        The remainder goes back to its level, or is yielded when ``last``."""
        filled, level = [], 0
        for h in range(self.window - 1, 0, -1):
            while self.levels[h] and how_many:
                for doc, start, length in self.levels[h].pop():
                    while length:
                        take = min(length, self.window - level)
                        filled.append((doc, start, take))
                        level, start, length = level + take, start + take, length - take
                        if level == self.window:
                            yield filled
                            filled, level = [], 0
                self.counts[h] -= 1
                self.open -= 1
                how_many -= 1
        if filled and last:
            yield filled
        elif filled:
            self.levels[level].append(filled)
            self.counts[level] += 1
            self.open += 1

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.merge(self.open, last=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, with ``with_ids``, its ids as little-endian unsigned 32-bit numbers."""
    path = vocabulary or vocabulary_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        words, packer, held = word_ids(path), Packer(window), {}
        sequence, doc, kind = TaskContext.get().partitionId() << 40, 0, pa.int64()

        def rows(windows):
            nonlocal sequence
            out = [[] for _ in names]
            for pieces in windows:
                offset = 0
                for d, start, length in pieces:
                    own = held[d]
                    ids = own[1][4 * start:4 * (start + length)]
                    total = len(own[1]) // 4
                    for column, v in zip(out, (own[0], start, length, zlib.crc32(ids), total, sequence, offset, ids)):
                        column.append(v)
                    offset += length
                    own[2] -= length
                    if not own[2]:
                        del held[d]  # all its ids lie in closed windows
                sequence += 1
            types = [kind] + [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        for batch in batches:
            kind = batch.schema.types[0]
            keys = batch.column(0).to_pylist()
            for row, texts in byte_slices(batch.column(1)):
                ids, first = words.of_texts(texts)
                data, first, closed = ids.tobytes(), (4 * first).tolist(), []
                for key, s, e in zip(keys[row:row + len(texts)], first, first[1:]):
                    own = data[s:e] + end
                    held[doc] = [key, own, len(own) // 4]
                    closed += packer.add(doc, len(own) // 4)
                    doc += 1
                yield rows(closed)
        if packer.open:
            yield rows(packer.finish())

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:7]) + ", ids binary" * with_ids
    return docs.select(F.col(id_col), text_col).mapInArrow(run, schema)
