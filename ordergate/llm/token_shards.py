"""Token ids in training order: fixed-stride binary shards behind a keyed permutation.

The documents of each scan task form one stream of ids, cut into sequences of
SEQUENCE ids (the task's last one padded). A first scan counts the sequences per
task, which numbers all sequences without gaps; a second one gives sequence i the
global slot P(i), P a keyed Feistel permutation of the numbers below N: rounds on
the next even number of bits, walked until the result is below N. Slots are
evenly spread, so exact slot ranges partition them without sampling; each task
sorts its range and writes shards of SHARD sequences. A shard is nothing but
ids of fixed width: sequence slot s lies in shard s // SHARD at
(s % SHARD) * SEQUENCE * width, so training reads sequentially and resumes at any
slot by seeking. A shard that is complete already is not written again.

Defined results: null and empty texts add their end id only; repeated rows and null
ids are ordinary documents; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordergate.llm.common import byte_slices, new_folder, new_path, store
from ordergate.llm.tokens import vocabulary_path, word_ids

SEQUENCE = 2048
SHARD = 4096          # sequences per shard: 16 MB of 16-bit ids
SHARDS_PER_TASK = 4
END_ID = 1
PAD = 0xFFFF          # beyond the vocabulary
KEY = 20240229
ROUNDS = 6


class Permutation:
    """Keyed bijection of the numbers below n, both ways, on numpy arrays."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.Generator(np.random.Philox(key)).integers(0, 1 << 63, ROUNDS, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return left << np.uint64(self.half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while len(far := np.flatnonzero(out >= self.n)):  # the walk stays on x's cycle, which comes below n again
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, x) -> np.ndarray:
        return self._walk(x, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def sequences(docs: DataFrame, text_col: str, path: str, sequence: int, extra, schema: str) -> DataFrame:
    """mapInArrow over the scan: ``extra(first, rows)`` makes the batch for sequences
    first, first + 1, ... of a task, given as the rows of a 16-bit array."""
    def run(batches):
        words, rest, made = word_ids(path), np.empty(0, "<u2"), 0
        for batch in batches:
            for _, texts in byte_slices(batch.column(0)):
                ids, first = words.of_texts(texts)
                joined = np.insert(ids, first[1:], END_ID).astype("<u2")
                rest = np.concatenate([rest, joined])
                whole = len(rest) // sequence
                if whole:
                    yield from extra(made, rest[:whole * sequence].reshape(whole, sequence))
                    made, rest = made + whole, rest[whole * sequence:]
        if len(rest):
            yield from extra(made, np.pad(rest, (0, sequence - len(rest)), constant_values=PAD)[None])
    return docs.select(text_col).mapInArrow(run, schema)


def task_counts(docs: DataFrame, text_col: str, path: str, sequence: int) -> list[int]:
    """Number of sequences of each scan task: one number per task reaches the driver."""
    def count(first, rows):
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "n": [len(rows)]},
                                         pa.schema([("task", pa.int32()), ("n", pa.int64())]))
    got = dict(sequences(docs, text_col, path, sequence, count, "task int, n bigint").groupBy("task").agg(F.sum("n")).toArrow()
               .to_pandas().itertuples(index=False, name=None))
    return [int(got.get(t, 0)) for t in range(max(got, default=-1) + 1)]


def write_shards(docs: DataFrame, folder: str, text_col: str = "text", vocabulary: str | None = None,
                 sequence: int = SEQUENCE, shard: int = SHARD, key: int = KEY) -> tuple[DataFrame, int]:
    """Write all sequences below ``folder`` (a URI that all executors reach); returns
    (shard, sequences, crc32) rows and the number of sequences."""
    path = vocabulary or vocabulary_path()
    counts = task_counts(docs, text_col, path, sequence)
    base, total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tolist(), sum(counts)
    folder = new_folder(docs.sparkSession, folder)
    span = shard * SHARDS_PER_TASK  # slots per task

    def place(first, rows):
        task = TaskContext.get().partitionId()
        number = np.arange(first, first + len(rows)) + base[task]
        if number[-1] >= base[task + 1]:
            raise RuntimeError("the input changed between the two scans")
        slots = Permutation(total, key).slots(number)
        for a in range(0, len(rows), 2048):
            yield pa.RecordBatch.from_arrays([pa.array(slots[a:a + 2048]), pa.array((slots[a:a + 2048] // span).astype(np.int32)),
                                              pa.array([r.tobytes() for r in rows[a:a + 2048]], pa.binary())], ["slot", "range", "ids"])

    def write(batches):
        from pyarrow.fs import FileSystem, FileType
        fs, at = FileSystem.from_uri(folder)
        attempt, made, current, out, crc, n = TaskContext.get().taskAttemptId(), [], None, None, 0, 0

        def close():
            if current is None:
                return
            if n != min(shard, total - current * shard):
                raise RuntimeError(f"shard {current} got {n} sequences")
            final = f"{at}/shard-{current:08d}.bin"
            if out:
                out.close()
                fs.move(f"{at}/_attempt-{attempt}-{current}", final)
            made.append((current, n, crc))

        for batch in batches:
            for slot, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot // shard != current:
                    close()
                    current, crc, n = slot // shard, 0, 0
                    info = fs.get_file_info(f"{at}/shard-{current:08d}.bin")
                    done = info.type == FileType.File and info.size == 2 * sequence * min(shard, total - current * shard)
                    out = None if done else fs.open_output_stream(f"{at}/_attempt-{attempt}-{current}", compression=None)
                if slot != current * shard + n:
                    raise RuntimeError(f"slot {slot} where {current * shard + n} belongs")
                if out:
                    out.write(ids)
                crc, n = zlib.crc32(ids, crc), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(3)], ["shard", "sequences", "crc32"])

    rows = sequences(docs, text_col, path, sequence, place, "slot bigint, range int, ids binary")
    ranges = max(1, -(-total // span))
    ordered = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("slot").select("slot", "ids")
    return store(ordered.mapInArrow(write, "shard bigint, sequences bigint, crc32 bigint"), "shards"), total


def read_shards(spark: SparkSession, folder: str, total: int, sequence: int = SEQUENCE, shard: int = SHARD, key: int = KEY,
                resume_at: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per sequence from slot ``resume_at`` on: slot, sequence, shard, place, n_tokens, ids_crc32 and ids."""
    stride, names = 2 * sequence, ["slot", "sequence", "shard", "place", "n_tokens", "ids_crc32"]

    def run(batches):
        order = Permutation(total, key) if total else None
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, number = content.as_buffer(), int(path.rsplit("-", 1)[1].removesuffix(".bin"))
                if len(data) % stride:
                    raise ValueError(f"{path} has {len(data)} bytes, no multiple of {stride}")
                rows = np.frombuffer(data, "<u2").reshape(-1, sequence)
                rows = rows[max(0, resume_at - number * shard):]
                slots = np.arange(len(rows)) + max(number * shard, resume_at)
                columns = [slots, order.numbers(slots), np.full(len(rows), number), (slots % shard) * stride,
                           (rows != PAD).sum(1), np.array([zlib.crc32(r) for r in rows], np.int64)]
                for a in range(0, len(rows), 2048):
                    out = [pa.array(c[a:a + 2048], pa.int64()) for c in columns]
                    if with_ids:
                        out.append(pa.array([r.tobytes() for r in rows[a:a + 2048]], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
             .where(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("bigint") >= resume_at // shard))
    return files.select("path", "content").mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", ids binary" * with_ids)


def shard_round_trip(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back (no ids)."""
    folder = new_path(docs.sparkSession, "shards")
    _, total = write_shards(docs, folder, text_col, **options)
    options.pop("vocabulary", None)
    return read_shards(docs.sparkSession, folder, total, with_ids=False, **options)
