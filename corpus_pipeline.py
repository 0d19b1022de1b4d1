"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents`` (the last one: packed pieces). They
are written between stages, so a stage's decisions are fixed before the next
one reads them, and a lost executor re-reads files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordergate.llm import decontaminate, exact_dedup, ngram_join, packing, quality_crf
from ordergate.llm.common import store, table

NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level CRF does not accept go."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z case) the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by similarity the smallest id stays."""
    return ngram_join.keep_one(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length sequences of token ids, one row per piece."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("benchmark decontamination", clean_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
