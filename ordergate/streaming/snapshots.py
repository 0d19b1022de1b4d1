"""Refresh when a new export of the order sheet lands.

The reference refreshes on demand (a schedule, an edit hook or a person).
Here the trigger is a file-source stream over a landing folder: every
micro-batch lists the export files that arrived since the last one (the
stream's checkpoint remembers which were seen, so each is handled exactly
once, also after a restart), and the newest of them goes through the same
``refresh`` as a manual run -- fingerprint, skip-if-unchanged, gate, checks,
atomic publish. Only file names reach the driver, never rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordergate.plans.refresh import RunResult, refresh
from ordergate.session import work_dir
from ordergate.sources.sheet import Source, _fs, is_folder, path_exists

FORMATS = {"parquet": "*.parquet", "csv": "*.csv", "json": "*.json"}
# The binaryFile source's fixed schema; only path and time are selected, so
# file contents are never read by the stream.
BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def arrivals(spark: SparkSession, landing: str, fmt: str = "csv") -> DataFrame:
    """Stream of newly landed export files (path and time only; no content)."""
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE)
            .option("pathGlobFilter", FORMATS[fmt])
            .option("recursiveFileLookup", "true")
            .load(landing)
            .select("path", "modificationTime"))


class IncompleteExport(RuntimeError):
    """The newest export has no ``_SUCCESS`` yet; the batch stays open and runs again."""


def newest_export(spark: SparkSession, arrived: list[tuple[str, object]], landing: str) -> str | None:
    """The export to refresh from, given (folder or file, newest time) pairs: a folder
    counts as a whole and only once its ``_SUCCESS`` is there; a file lying in the
    landing folder itself is an export of its own."""
    complete = [(t, p) for p, t in arrived if not is_folder(spark, p) or path_exists(spark, f"{p}/_SUCCESS")]
    if arrived and not complete:
        raise IncompleteExport(f"no complete export among {sorted(p for p, _ in arrived)}")
    return max(complete)[1] if complete else None


def refresh_on_arrival(spark: SparkSession, landing: str, root: str, hoy, fmt: str = "csv",
                       checkpoint: str | None = None, once: bool = True, **refresh_args):
    """Start the stream; each batch refreshes from the newest complete export that
    files arrived for, all its files included.

    ``once=True`` processes what has landed and stops (a scheduled run);
    otherwise the query keeps polling. Returns the streaming query and the
    list of run results it produced in this process.
    """
    results: list[RunResult] = []
    checkpoint = checkpoint or work_dir(spark, "streams", "sheet-arrivals")
    fs, jpath = _fs(spark, landing)
    top = fs.makeQualified(jpath).toString().rstrip("/")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        folder = F.regexp_replace("path", "/[^/]*$", "")
        same = F.regexp_replace(folder, "^([a-z0-9]+:)/+", "$1/") == F.lit(re.sub("^([a-z0-9]+:)/+", r"\1/", top))
        exports = (batch.select(F.when(same, F.col("path")).otherwise(folder).alias("export"), "modificationTime")
                   .groupBy("export").agg(F.max("modificationTime").alias("t")).collect())   # one row per export
        newest = newest_export(spark, [(r["export"], r["t"]) for r in exports], landing)
        if newest:
            results.append(refresh(spark, [Source("source", newest, fmt)], root, hoy, **refresh_args))

    writer = arrivals(spark, landing, fmt).writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if once:
        query.awaitTermination()
    return query, results
