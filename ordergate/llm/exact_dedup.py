"""Exact deduplication by content-defined chunk recipes.

Every text (A-Z lower-cased) is cut where a rolling gear hash of its last 32
bytes has its top bits zero, so equal texts are cut alike. Chunks get digests as
identifiers; the identifiers are verified by bringing the distinct chunks of
each digest together once (each chunk moves at most once per scan task, however
many documents hold it). If two different chunks share a digest, the digest is
widened and verified anew. A document is then its recipe, the ordered list of
its chunks' identifiers, and equal recipes mean equal texts: long texts are
never shuffled, only their lists.

Defined results: null text counts as empty; empty texts equal each other; of
equal texts the row with the largest id stays (null ids last); of repeated
rows with that id exactly one; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import row_keys, slices, store, utf8, without

WINDOW = 32                       # bytes that decide a cut
MIN_CHUNK, MAX_CHUNK = 128, 2048  # bytes; the minimum covers the window
CUT_BITS = 9                      # a cut about every 2**9 bytes beyond the minimum
DIGEST_BYTES, MOST_DIGEST_BYTES = 16, 64


def _gear() -> np.ndarray:
    """One pseudo-random 32-bit number per byte value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little")
                     for b in range(256)], np.uint32)


def cut_points(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Ends of windows whose gear hash (sum of gear[byte] << age) has CUT_BITS zero top bits."""
    h, width = gear[data], 1
    while width < WINDOW:
        h[width:] += h[:-width].copy() << np.uint32(width)
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(start: int, end: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of data[start:end], given all candidate cuts."""
    out, last = [], start
    lo, hi = np.searchsorted(cuts, (start + MIN_CHUNK, end))
    for c in cuts[lo:hi].tolist():
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if c - last >= MIN_CHUNK:
            out.append(c)
            last = c
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if end > last:
        out.append(end)
    return out


def _chunked(texts: list[bytes], gear: np.ndarray) -> Iterator[tuple[bytes, list[bytes]]]:
    """(normalised text, chunks) of each text."""
    for a, b in slices(texts, 1 << 20):
        lowered = [t.lower() for t in texts[a:b]]  # bytes.lower touches A-Z only
        joined = b"".join(lowered)
        cuts = cut_points(np.frombuffer(joined, np.uint8), gear) if joined else np.empty(0, np.int64)
        at = 0
        for t in lowered:
            ends = chunk_ends(at, at + len(t), cuts)
            yield t, [joined[s:e] for s, e in zip([at, *ends], ends)]
            at += len(t)


def chunks(docs: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """(digest, chunk) rows, each once per Arrow batch."""
    def run(batches):
        gear = _gear()
        for batch in batches:
            found = set()
            for _, parts in _chunked(utf8(batch.column(0)), gear):
                found.update(parts)
            parts = sorted(found)
            digests = [hashlib.blake2b(p, digest_size=digest_bytes).digest() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(parts, pa.binary())],
                                             ["digest", "chunk"])
    return docs.select(text_col).mapInArrow(run, "digest binary, chunk binary")


def unverified(docs: DataFrame, text_col: str, digest_bytes: int) -> int:
    """Number of digests that different chunks share (compared byte by byte)."""
    distinct = chunks(docs, text_col, digest_bytes).dropDuplicates(["digest", "chunk"])
    return distinct.groupBy("digest").count().where("count > 1").count()


def recipes(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """(doc_id, recipe, n_chunks, sha): the recipe is the concatenation of the
    chunks' fixed-width identifiers in text order."""
    def run(batches):
        gear = _gear()
        for batch in batches:
            recipe, count, sha = [], [], []
            for text, parts in _chunked(utf8(batch.column(1)), gear):
                recipe.append(b"".join(hashlib.blake2b(p, digest_size=digest_bytes).digest() for p in parts))
                count.append(len(parts))
                sha.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(recipe, pa.binary()), pa.array(count, pa.int32()),
                 pa.array(sha, pa.binary())], ["doc_id", "recipe", "n_chunks", "sha"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, recipe binary, n_chunks int, sha binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    while unverified(docs, text_col, digest_bytes):
        if digest_bytes >= MOST_DIGEST_BYTES:
            raise RuntimeError("different chunks share a 512-bit digest")
        digest_bytes = min(2 * digest_bytes, MOST_DIGEST_BYTES)
    # Written once: the row numbers below must not change on a recomputation.
    rows = store(recipes(docs, id_col, text_col, digest_bytes)
                 .withColumn("row", F.monotonically_increasing_id()), "recipes")
    # Only recipes of several documents need a partner; read from files, the
    # join below can split a hot recipe's documents over tasks.
    groups = store(rows.groupBy("recipe").agg(F.count("*").alias("group_size"),
                                              F.max(F.struct("doc_id", "row")).alias("keep"))
                   .where("group_size > 1"), "copies")
    joined = rows.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("n_chunks").cast("long").alias("n_chunks"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per distinct normalised text (all columns).

    Decided per row: rows with null or repeated ids stay or go by their own text."""
    rows, key = row_keys(docs, id_col, nulls_first=True)
    return without(rows, store(exact_dedup(rows, key, text_col).where("NOT kept").select("doc_id"), "copies-gone"), key)
