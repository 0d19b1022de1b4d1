"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window (WINDOW consecutive item words; a shorter item is one
window) occurs in a document exactly if all its word shingles do, in order. So
its shingles are ordered by rarity in the documents and the rarest alone is
the necessary prefix. Windows whose rarest shingle never occurs are out. One
scan counts the benchmark's shingles, a second one emits each occurrence of a
prefix shingle with the words around it; an equi-join pairs them with windows,
positions and lengths bound the start, and the words are compared exactly.

Both scans filter by a bitmap of the hashes, sized by their number within fixed bounds;
false positives only cost rows that the join removes. Windows and hits are rows of their own,
made some thousands at a time, so neither a long item nor a text that repeats one word fills a task.

Defined results: null or wordless texts have no words and are clean; items
with null or wordless text, or null id, have no windows; repeated items count
once; repeated documents are judged each; empty tables give empty results or
clean documents; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import (bitmap, byte_slices, marked, row_keys, shingle_hashes, split_words, store, translated, without,
                                  word_hashes)

WINDOW = 13
SHINGLE = 5
ROWS = 4096     # windows or hits made at once
#: Word bytes: 0-9, a-z and everything beyond ASCII; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item_id, window, length, parts): parts are (hash, offset, size) of its shingles."""
    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of((text.as_py() or "").encode())
                if not words or item is None:
                    continue
                length = min(window, len(words))
                size = min(shingle, length)
                h = shingle_hashes(word_hashes(pa.array(words, pa.large_binary())), size).view(np.int64)
                for s in range(len(words) - length + 1):
                    out.append({"item_id": item, "window": b" ".join(words[s:s + length]).decode(), "length": length,
                                "parts": [{"hash": int(h[s + o]), "offset": o, "size": size}
                                          for o in range(length - size + 1)]})
                    if len(out) == ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema)
    schema = pa.schema([("item_id", pa.string()), ("window", pa.string()), ("length", pa.int32()),
                        ("parts", pa.list_(pa.struct([("hash", pa.int64()), ("offset", pa.int32()),
                                                      ("size", pa.int32())])))])
    return items.select(F.col(id_col).cast("string"), text_col).mapInArrow(
        run, "item_id string, window string, length int, parts array<struct<hash:bigint,offset:int,size:int>>")


def _occurrences(column: pa.Array, sizes: list[int], bits: np.ndarray):
    """Per slice of texts: its first row, distinct words, word numbers, first word of each text,
    and (text, place within it, hash) arrays of the marked shingles."""
    for start, texts in byte_slices(column):
        words, number, first = split_words(translated(texts, WORD_BYTES))
        flat = word_hashes(words)[number]
        doc, place, found = [], [], []
        for size in sizes:
            h = shingle_hashes(flat, size)
            at = marked(bits, h)
            of = np.searchsorted(first, at, "right") - 1
            ok = at + size <= first[of + 1]
            doc.append(of[ok])
            place.append((at - first[of])[ok])
            found.append(h[at[ok]])
        if not sizes:
            doc = place = [np.empty(0, np.int64)]
            found = [np.empty(0, np.uint64)]
        yield start, words, number, first, np.concatenate(doc), np.concatenate(place), np.concatenate(found)


def shingle_counts(docs: DataFrame, text_col: str, sizes: list[int], bitmap) -> DataFrame:
    """(hash, n): occurrences in the documents of marked shingles."""
    def run(batches):
        for batch in batches:
            got = [h for *_, h in _occurrences(batch.column(0), sizes, bitmap.value)]
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *got]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])
    return (docs.select(text_col).mapInArrow(run, "hash bigint, n bigint")
            .groupBy("hash").agg(F.sum("n").alias("n")))


def prefix_hits(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], bitmap, window: int) -> DataFrame:
    """Rows (row, doc_id, n_words, hash, place, begin, context): one without hash per document, and one per occurrence of
    a marked shingle in it, with the words around. ``row`` numbers the documents of this run: write it before use."""
    fields = [("row", pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("begin", pa.int32()), ("context", pa.string())]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, words, number, first, doc, place, found in _occurrences(batch.column(1), sizes, bitmap.value):
                n, counts = len(first) - 1, np.diff(first)
                ids = batch.column(0).slice(start, n)
                none = [pa.nulls(n, t) for _, t in fields[2:]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(row + np.arange(n)), pa.array(counts, pa.int64()), *none],
                                                 ["doc_id", *(f for f, _ in fields)])
                for a in range(0, len(doc), ROWS):
                    d, p = doc[a:a + ROWS], place[a:a + ROWS]
                    begin = np.maximum(0, p - window + 1)
                    lo, hi = first[d] + begin, np.minimum(first[d] + p + window, first[d + 1])
                    ends = np.concatenate([[0], np.cumsum(hi - lo)])
                    around = np.repeat(lo - ends[:-1], hi - lo) + np.arange(ends[-1])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(number[around])).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), pa.array(row + d), pa.array(counts[d], pa.int64()), pa.array(found[a:a + ROWS].view(np.int64)),
                         pa.array(p, pa.int32()), pa.array(begin, pa.int32()), pc.binary_join(lists, " ")], ["doc_id", *(f for f, _ in fields)])
                row += n
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, row bigint, n_words bigint, hash bigint, place int, begin int, context string")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text",
                window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(scanned, found): scanned has row, doc_id, n_words for every document, found
    one row per document row, occurring window and item: row, start, end, item_id."""
    spark = docs.sparkSession
    windows = store(benchmark_windows(items, item_col, item_text_col, window, shingle), "windows")
    parts = windows.select("window", "length", F.explode("parts").alias("p")).select("window", "length", "p.*")
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())  # at most `shingle` numbers
    counts = store(shingle_counts(docs, text_col, sizes, bitmap(spark, parts.select("hash"))), "counts")
    rarest = (parts.distinct().join(counts, "hash")  # a shingle without count occurs nowhere
              .groupBy("window", "length").agg(
                  F.min(F.struct("n", "hash", "offset", "size")).alias("least"),
                  F.count_distinct("offset").alias("present"), F.max("size").alias("of_size"))
              .where(F.col("present") == F.col("length") - F.col("of_size") + 1))
    prefix = store(rarest.select(F.col("least.hash").alias("hash"), F.col("least.offset").alias("offset"),
                                 "window", "length"), "prefix")
    scanned = store(prefix_hits(docs, id_col, text_col, sizes, bitmap(spark, prefix.select("hash")), window), "hits")
    hits = scanned.where("hash IS NOT NULL").drop("doc_id")
    start = F.col("place") - F.col("offset")
    candidates = (hits.join(prefix, "hash").withColumn("start", start)
                  .where((F.col("start") >= F.col("begin")) & (F.col("start") + F.col("length") <= F.col("n_words"))))
    text = F.array_join(F.slice(F.split("context", " "), F.col("start") - F.col("begin") + 1, F.col("length")), " ")
    found = (candidates.where(text == F.col("window"))
             .select("row", "start", (F.col("start") + F.col("length")).alias("end"), "window").distinct()
             .join(windows.select("window", "item_id").distinct(), "window")
             .select("row", "start", "end", "item_id"))
    return scanned.where("hash IS NULL").select("row", "doc_id", "n_words"), found


def decontaminate(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit: words inside any occurrence of a window; contaminated: n_hit is over
    0 and at least a twentieth of the words.
    """
    scanned, found = occurrences(docs, items, **columns)
    spans = F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("s"),
                                                F.col("end").cast("long").alias("e"))))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["upto"]))).alias("n"),
            F.greatest(x["e"], acc["upto"]).alias("upto")), lambda acc: acc["n"])
    judged = (found.groupBy("row").agg(spans.alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
              .select(F.col("row").alias("hit_row"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.array_join("items", ",").alias("ids")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (scanned.join(judged, scanned["row"] == judged["hit_row"], "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones (all columns), decided per row whatever the ids."""
    rows, key = row_keys(docs, id_col, nulls_first=False)
    bad = decontaminate(rows, items, id_col=key, text_col=text_col).where("contaminated").select("doc_id")
    return without(rows, store(bad, "contaminated"), key)
