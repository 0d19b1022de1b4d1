"""Every registered query against its DuckDB SQL on the small testdata
(brute force on a small fixture; the driver repeats this at sf0.01)."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


from ordergate.plans.catalog import REGISTRY  # noqa: E402

SQL = {k: v for k, v in entry.oracle_sql().items() if k in REGISTRY}


SPARK_TO_DUCKDB = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows, cols = df.collect(), df.columns
    rel = con.sql(SQL[name])
    types = dict(zip(rel.columns, map(str, rel.types)))
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(cols) == sorted(dcols)
    assert {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString()) for f in df.schema.fields} == types
    assert _canon(rows, cols) == _canon(drows, dcols)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 4228
