"""Helpers shared by the training-data operators: the shared folder, written
tables, word hashing and batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Unset is allowed on a local master only (tests): a private folder, one per
    application.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="ordergate-llm-")
    return "file://" + _LOCAL[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/ordergate-llm/{label}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, path: str) -> str:
    """Create the folder; its full URI, as pyarrow's file systems in tasks take it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    uri = fs.makeQualified(jpath).toUri().toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: the
    lineage ends there, and a lost executor re-reads files."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`store` that nothing reads any more."""
    spark = df.sparkSession
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(os.path.dirname(parent)) != "ordergate-llm":
            raise ValueError(f"{parent} is not a table of the shared folder")
        jpath = spark._jvm.org.apache.hadoop.fs.Path(parent)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes (a longer text alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only


def byte_slices(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, consecutive rows) of an Arrow text column, about ``most`` bytes
    each (a longer text alone); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1:column.offset + len(column) + 1]
    start, base = 0, int(ends[0]) - pc.binary_length(column[0]).as_py() if len(column) else 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, column.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """A large_string column without nulls, its bytes mapped one by one."""
    n, offset = len(column), column.offset
    ends = np.frombuffer(column.buffers()[1], np.int64)[offset:offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = bytes(memoryview(data)[ends[0]:ends[-1]]).translate(table) if data else b""
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their numbers in text order, first word of each text and the end):
    words stand between ASCII white space."""
    lists = pc.ascii_split_whitespace(column)
    first = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(first[0], first[-1] - first[0])
    first = first - first[0]
    filled = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves empty words
    if not filled.all():
        words = words.filter(pa.array(filled))
        first = np.concatenate([[0], np.cumsum(filled)])[first]
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words of an Arrow array."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k:k + n]) * _MUL
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


SLOTS_PER_HASH = 8
LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 28   # bitmaps of 8 KB to 32 MB


def bitmap(spark: SparkSession, hashes: DataFrame):
    """Broadcast filter over the column ``hash`` of a written table: a bit for the top bits of each hash, the table
    made as large as the counted hashes need, within fixed bounds. Beyond the upper one it lets more
    through; what it lets through must be joined exactly in any case."""
    n = hashes.count()
    width = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, (SLOTS_PER_HASH * n).bit_length()))
    # Put together by the tasks, in pieces of 4 KB (counted from 1, for numbers from 1 on).
    number = F.shiftrightunsigned("hash", 64 - width) + 1
    pieces = (hashes.select(number.alias("number")).groupBy(F.expr("bitmap_bucket_number(number)").alias("piece"))
              .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits")))
    out = np.zeros(1 << (width - 3), np.uint8)
    for batch in pieces.toArrow().to_batches():
        for piece, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[(piece - 1) * 4096:piece * 4096] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the uint64 hashes whose slot is set."""
    width = len(bits).bit_length() + 2
    slot = (h >> np.uint64(64 - width)).astype(np.int64)
    return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def row_keys(docs: DataFrame, id_col: str, nulls_first: bool) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a key that no other row has, and its name.

    The key orders rows by id, null ids first or last. An id that only one row
    has is its key; rows with null or repeated ids are written once with a
    number, so the key does not change on a recomputation.
    """
    name = "_row_key"
    while name in map(str.lower, docs.columns):
        name += "_"

    def key(rows, number):
        null = F.col(id_col).isNull()
        return rows.withColumn(name, F.struct((~null if nulls_first else null).alias("rank"), F.col(id_col).alias("id"),
                                              number.alias("number")))
    single = F.lit(-1).cast("long")
    odd = store(docs.groupBy(F.col(id_col).alias(name)).count().where((F.col("count") > 1) | F.col(name).isNull()).select(name), "odd-ids")
    if odd.isEmpty():
        return key(docs, single), name
    known, repeated = docs.where(F.col(id_col).isNotNull()), odd.where(F.col(name).isNotNull())
    same = known[id_col] == repeated[name]
    # Null ids take no part in a join, where they would meet in one task.
    several = docs.where(F.col(id_col).isNull()).unionByName(known.join(repeated, same, "left_semi"))
    numbered = store(key(several, F.monotonically_increasing_id()), "numbered")
    return key(known.join(repeated, same, "left_anti"), single).unionByName(numbered), name


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key (see :func:`row_keys`) is not in ``dropped``; the key goes."""
    gone = dropped.select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti").drop(key)
