"""What grows with the sheet: what the queries build, what a row costs, and which rows are shuffled."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordergate.functions.numbers import python_float_text
from ordergate.operators import gate as G
from ordergate.plans import catalog, digest, fileindex as I, publish as PB, refresh as RF, storage
from tests.fixtures import frame, gate_rows

HOY = "2025-06-30"
SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["src_fallback", "load_clean", "publish_staged"])
def test_only_the_history_refreshes(spark, monkeypatch, name):
    """a query that reads nothing of the refresh history does not run it."""
    monkeypatch.setattr(RF, "refresh", lambda *a, **k: pytest.fail("refreshed"))
    assert catalog.REGISTRY[name](spark, SMOKE).count() > 0


def _sheet(spark, path, rows=None):
    """The rows as a Parquet sheet of three files."""
    rows = rows or gate_rows() + [dict(gate_rows()[2], pedido_id=None), dict(gate_rows()[1], pedido_id=None)]
    frame(spark, rows).repartition(3, "fila_origen").write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_landing_code_is_compiled(spark, tmp_path):
    """No generated method of the raw landing is longer than the JVM compiles (8,000 bytes)."""
    land = PB.raw_landing(_sheet(spark, tmp_path / "t"), "x")
    stages = land._jdf.queryExecution().debug().codegenToSeq()
    assert all(stages.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(stages.size()))


def test_number_text(spark):
    numbers = [0.0, -0.0, 1.5, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 1e-3, 1e-4, 1.25e-4, 1e-5, -2.5e-9, 5e-324]
    rows = spark.createDataFrame([(x,) for x in [*numbers, float("nan"), None]], "x double")
    got = [r[0] for r in rows.select(python_float_text(F.col("x"))).collect()]
    assert got[:-3] == [repr(x) for x in numbers[:-1]] and got[-2:] == [None, None]


def test_sums_of_hashes(spark):
    """Exact sums, without a decimal for every row."""
    big = [(1 << 31) - 2] * 5 + [0, 1, 65535, 65536]
    rows = spark.createDataFrame([(x,) for x in big], "x long")
    assert int(rows.agg(digest._whole(F.col("x"))).first()[0]) == sum(big)
    assert rows.limit(0).agg(digest._whole(F.col("x"))).first()[0] == 0
    plan = digest.fingerprint(frame(spark, gate_rows()).where("fila_origen >= 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"sum\(cast\([^()]*(\([^()]*\)[^()]*)* as decimal", plan)


def test_duplicates_without_a_shuffle_of_rows(spark, tmp_path, monkeypatch):
    """rows learn whether they are duplicates from bitmaps of places, not from a join on their id."""
    typed = G.prepare(_sheet(spark, tmp_path / "t"))
    monkeypatch.setattr(G, "BLOCK_ROWS", 2)
    first = storage.materialize(G.first_rows(typed, True), "first")
    later = storage.materialize(G.later_rows(typed, first), "later")
    flagged = G.flag_later(typed, later)
    got = {(r.fila_origen, r._dup) for r in flagged.collect()}
    assert got == {(r.fila_origen, r._dup) for r in G.flag_duplicates(typed, True).collect()}
    assert {i for i, dup in got if dup} == {3, 5}
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    called = []
    monkeypatch.setattr(G, "flag_duplicates", lambda *a: called.append(a))
    v = G.run_gate(spark.read.parquet(str(tmp_path / "t")), HOY, materialize=True).verdicts
    assert v.count() == 6 and not called


def test_names_are_hashed_where_they_are_many(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
        clean = G.run_gate(frame(spark, gate_rows()), HOY, materialize=True).clean.select("cliente")
        assert "ShuffledHashJoin" in clean._jdf.queryExecution().sparkPlan().toString()
        assert {r[0] for r in clean.collect()} == {"Maderas Núñez"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_trigrams_once_a_file(monkeypatch):
    """a task hands on each trigram of a file's column about once, and no more than it may hold."""
    cells = {"archivo": ["a", "a", "b", "b"], "cliente": ["abcd", "abcd", None, "ab"], "producto": ["", "\U0001F600xy", "éñü", "abc"],
             "pedido_id": ["p1", "p12", "p12", None], "comercial": [None] * 4}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in cells.items()})
    want = [("a", "cliente", "abc"), ("a", "cliente", "bcd"), ("a", "pedido_id", "p12"), ("a", "producto", "\U0001F600xy"),
            ("b", "pedido_id", "p12"), ("b", "producto", "abc"), ("b", "producto", "éñü")]
    def terms(n):
        return [tuple(r.values()) for b in I._trigrams(iter([batch] * n)) for r in b.to_pylist()]
    assert sorted(terms(3)) == want
    monkeypatch.setattr(I, "KEPT_TERMS", 1)
    assert sorted(set(terms(2))) == want
