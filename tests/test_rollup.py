"""The dashboard's rollup against the order lines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.operators import dashboard as D, metrics as M, rollup as R
from ordergate.operators.gate import run_gate
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def clean(spark):
    return run_gate(dirty_orders(spark, SF_SMALL), TESTDATA_TODAY, eager_counts=False, materialize=True).clean


@pytest.fixture(scope="module")
def rolled(spark, clean, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup"))
    R.save(R.build(clean), path)
    return R.load(spark, path)


def test_any_window_and_filter(spark, clean, rolled):
    rng = random.Random(1)
    values = {c: [r[0] for r in clean.where(F.col(c).isNotNull()).select(c).distinct().limit(6).collect()] for c in R.CATEGORIES}
    first = dt.date(1994, 1, 1)
    for _ in range(6):
        chosen = {c: rng.choice(values[c]) for c in rng.sample(R.CATEGORIES, rng.randint(0, 2))}
        days = sorted(first + dt.timedelta(days=rng.randint(0, 2800)) for _ in range(2))
        f = D.Filters(**chosen, **rng.choice([{}, {"desde": days[0], "hasta": days[1]}, {"hasta": days[1]}]))
        assert R.dash_kpis(rolled, f).collect() == D.dash_kpis(clean, f).collect(), f
        assert sorted(R.dash_monthly(rolled, f).collect()) == sorted(D.dash_monthly(clean, f).collect()), f
        dimension = rng.choice(list(S.RANKING_SIZE))
        assert R.dash_top(rolled, f, dimension).collect() == D.dash_top(clean, f, dimension).collect(), (f, dimension)
    assert R.kpis(rolled).collect() == M.kpis(clean).collect()
    assert sorted(R.monthly_series(rolled).collect()) == sorted(M.monthly_series(clean).collect())


def test_nothing_matches_and_empty(spark, clean, rolled):
    none = D.Filters(comercial="nobody")
    assert R.dash_kpis(rolled, none).collect() == D.dash_kpis(clean, none).collect()
    empty = R.build(clean.limit(0))
    assert R.dash_kpis(empty, D.Filters()).collect() == D.dash_kpis(clean.limit(0), D.Filters()).collect()
    assert R.kpis(empty).collect() == M.kpis(clean.limit(0)).collect()


def test_customers_beyond_one_bitmap(spark, clean):
    """Distinct customers over several bitmaps, repeated over days and categories."""
    many = spark.range(100_000).select(
        F.lit("x").alias("pedido_id"), F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 40 as int))").alias("fecha"),
        F.lit("c").alias("comercial"), (F.col("id") % 3).cast("string").alias("zona"), F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(70_000))).alias("cliente"),
        F.lit("t").alias("tipo_cliente"), F.lit("p").alias("producto"), F.lit("f").alias("familia"), F.lit(1.0).alias("cantidad"),
        F.lit(2.0).alias("precio_unitario"), F.lit(2.0).alias("importe"), F.lit(False).alias("es_devolucion"), F.lit(False).alias("sospechoso"))
    f = D.Filters(zona="1", desde="2025-01-05", hasta="2025-02-01")
    assert R.dash_kpis(R.build(many), f).first() == D.dash_kpis(many, f).first()


def test_windows_reach_the_scan(rolled):
    win = D.Filters(desde="1996-01-01", hasta="1996-02-01")
    plan = R.kpi_frame(rolled, win, M.Window_(dt.date(1996, 1, 1), dt.date(1996, 2, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dia" in plan and "LessThanOrEqual(dia" in plan
