"""Small inputs shared by the tests: odd texts, and columns whose names clash with internal ones."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASHING = ["row", "node", "hash", "recipe", "sha", "component", "segment", "tile", "_gone", "_id", "_text", "keep", "count"]


def documents(spark, rows, partitions=3):
    """(doc_id, text) rows with extra columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
