"""Training takes its sample from the documents that are there and from whole texts."""

import numpy as np
from pyspark.sql import functions as F

from ordergate.llm import quality_crf as Q
from ordergate.llm.common import table
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    strangers = spark.range(10**9, 10**9 + 20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    more = labels.select("doc_id", "quality").unionByName(strangers, allowMissingColumns=True)
    a, b = (Q.train(docs, x, sample=150) for x in (labels, more))
    assert np.array_equal(a.weights, b.weights) and a.curve == b.curve


def test_without_a_model_all_documents_stay(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)] + [(None, None)])
    for labels in ([], [(i, 1) for i in range(20)], [(i, i % 2) for i in range(100, 120)]):
        known = spark.createDataFrame(labels, "doc_id bigint, quality int")
        assert Q.keep_good(docs, known).count() == 21


def test_training_lines_come_from_the_whole_text():
    for n in (1, 64, Q.TRAIN_LINES):
        assert Q.training_lines(n).tolist() == list(range(n))
    for n in (Q.TRAIN_LINES + 1, 5_000, 100_001):
        lines = Q.training_lines(n)
        assert len(set(lines.tolist())) == len(lines) and (np.diff(lines) > 0).all() and lines[-1] < n
        assert Q.TRAIN_LINES - Q.CHAIN < len(lines) <= Q.TRAIN_LINES
    last = [Q.training_lines(n)[-1] / n for n in range(5_000, 9_000, 10)]
    assert np.mean(last) > 0.8


def test_junk_beyond_the_first_lines_trains(spark):
    clean = "A plain sentence of the text follows here.\n"
    rows = [(i, clean * 600 + ("!!! $$$ BUY 99\n" * 6_000 if i % 2 else clean * 600)) for i in range(24)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(24)], "doc_id bigint, quality int")
    got = Q.classify(documents(spark, rows), labels).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got)
