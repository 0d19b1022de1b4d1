"""Column helpers: customer key, Unicode trim, dates, exact quantile."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordergate.functions import customer_key, customer_key_py, parse_fecha, utrim
from ordergate.operators.quantile import exact_quantile

SPELLINGS = ["Ferretería López", "  FERRETERIA LOPEZ ", "ferreteria  lopez", "Instal·lació Vidal S.L.",
             "Grup Elèctric Segrià", "Ｆｅｒｒｅ", "Łódź Sp. z o.o.", "ﬁnca", "Ærø\tA/S", "", "···", None]


def test_customer_key_udf_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in SPELLINGS], "cliente string")
    got = {r.cliente: r.k for r in df.select("cliente", customer_key(F.col("cliente")).alias("k")).collect()}
    assert got == {s: customer_key_py(s) for s in SPELLINGS}
    assert customer_key_py("Instal·lació Vidal S.L.") == "INSTALLACIO VIDAL SL"
    assert customer_key_py("ﬁnca") == "FINCA"          # NFKD decomposes the ligature


def test_utrim_like_python_strip(spark):
    vals = ["  a b ", " x　", "\x1cy\x1f", "\tz\n", "none"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.t for r in df.select(utrim(F.col("s")).alias("t")).collect()]
    assert got == [v.strip() for v in vals]


def test_parse_fecha(spark):
    vals = ["2025-03-10", "2025-03-10 10:30:00", "2025-03-10T10:30", " 2025-03-10 ", "2025-02-30",
            "10/03/2025", "12345", "mañana", None]
    df = spark.createDataFrame([(v,) for v in vals], "f string")
    got = [r.p for r in df.select(parse_fecha(F.col("f"), df.schema["f"].dataType).alias("p")).collect()]
    d = dt.datetime
    assert got == [d(2025, 3, 10), d(2025, 3, 10, 10, 30), d(2025, 3, 10, 10, 30), d(2025, 3, 10),
                   None, None, None, None, None]


@pytest.mark.parametrize("buckets", [2, 64, 4096])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.999, 1.0])
def test_exact_quantile_matches_numpy(spark, monkeypatch, buckets, p):
    from ordergate.operators import quantile
    monkeypatch.setattr(quantile, "BUCKETS", buckets)
    rng = random.Random(7)
    # Heavy tails, one value in many copies, a typo, nulls.
    vals = [round(rng.lognormvariate(8, 1.5), 2) for _ in range(2_000)] + [5.0] * 300 + [1e300, -3.25] + [None] * 10
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7).cache()
    want = float(np.quantile([v for v in vals if v is not None], p))
    assert exact_quantile(df, "x", p) == pytest.approx(want, rel=1e-12)


def test_exact_quantile_of_few_distinct_values(spark):
    df = spark.range(40_000).select((F.col("id") % 3).cast("double").alias("x"))
    assert [exact_quantile(df, "x", p) for p in (0.0, 0.3, 0.5, 0.999)] == [0.0, 0.0, 1.0, 2.0]


def test_exact_quantile_empty_and_single(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None
    assert exact_quantile(spark.createDataFrame([(3.0,)], "x double"), "x", 0.999) == 3.0


def test_row_position_multi_file_csv(spark, tmp_path):
    """Positions follow file name, then byte offset, across many splits."""
    import shutil

    from ordergate.sources.sheet import read_orders, with_row_position
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        flat = tmp_path / "flat"
        flat.mkdir()
        for i, (lo, hi) in enumerate([(0, 3000), (3000, 15000), (15000, 20000)]):
            out = tmp_path / f"part{i}"
            (spark.range(lo, hi, numPartitions=1).select(F.col("id").alias("k"),
                                                         F.lit("x" * 30).alias("pad"))
             .write.option("header", "true").csv(str(out)))
            shutil.copy(next(out.glob("*.csv")), flat / f"sheet-{i}.csv")
        df = read_orders(spark, str(flat), "csv")
        assert df.rdd.getNumPartitions() > 3
        pos = with_row_position(df)
        assert pos.count() == 20000
        assert pos.where(F.col("fila_origen") != F.col("k").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_python_float_text(spark):
    """Doubles print as Python's repr in the plain range (raw landing text)."""
    from ordergate.functions.numbers import python_float_text
    rng = random.Random(11)
    vals = [17.0, 5.5e7, 15317.169999999998, 0.0001, 1e-5, 1e16, -2.5e7, 123456789.125, 0.1 + 0.2,
            9999999.0, 10000000.0, 0.0, -0.0, 0.001, 0.00012345, -1.5e-7, None, float("nan")]
    vals += [rng.uniform(-1e9, 1e9) for _ in range(500)] + [round(rng.uniform(0, 1e8), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", python_float_text(F.col("x")).alias("t")).collect():
        if r.x is None or math.isnan(r.x):
            assert r.t is None
        elif abs(r.x) < 1e16:
            assert r.t == repr(r.x), (r.x, r.t)


@pytest.mark.parametrize("spelling, key", [
    ("  Maderas\u00a0Núñez,  S.L. ", "MADERAS NUNEZ, SL"), ("a\x1cb\t\n c", "A B C"), ("\u2028x\u3000y\x85", "X Y"), ("...", ""), ("", ""), ("¨abc", "ABC"),
    ("ﬁn½", "FIN12"), ("l·l ŀ", "LL L"), ("Ωmega ß", "MEGA"), ("i̇", "I"), ("日本 co.", "CO"), ("x . y", "X Y")])
def test_customer_key_by_definition(spelling, key):
    assert customer_key_py(spelling) == key


def test_zone_is_looked_for_only_where_a_sign_of_one_stands(spark):
    """Dates with and without zones, signs in odd places, spaces around."""
    texts = {"2001-02-03": "2001-02-03 00:00:00", " 2001-02-03 10:30:00 ": "2001-02-03 10:30:00", "2001-02-03 10:30Z": "2001-02-03 10:30:00",
             "2001-02-03T10:30:05+0200": "2001-02-03 10:30:05", "2001-02-03T10:30:05.25-02:00": "2001-02-03 10:30:05", "2001-02-03Z": None,
             "2001-02-30": None, "2001-02-03+02:00": None, "-2001-02-03": None, "Z": None, "": None}
    from ordergate.functions import parse_fecha
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    column = parse_fecha(F.col("t"), df.schema["t"].dataType)
    got = {r[0]: r[1] for r in df.select("t", F.date_format(column, "yyyy-MM-dd HH:mm:ss")).collect()}
    assert got == texts
    plan = df.select(column.alias("fecha"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()
