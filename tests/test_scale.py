"""What questions carry through joins and shuffles, on small rows of their own."""

import datetime as dt

from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.operators import explorer as E, gate as G, rollup as R
from ordergate.plans import storage
from tests.fixtures import frame, gate_rows

HOY = "2025-06-30"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _gate(spark):
    return G.run_gate(frame(spark, gate_rows()), HOY, materialize=True)


def test_equal_rows_drop_unneeded_cells(spark):
    """rows equal in every cell are counted without carrying cells that nobody asked for."""
    raw = frame(spark, gate_rows())
    v = G.verdicts(raw.unionByName(raw), HOY).groupBy("fila_origen", G.VERDICT).count()
    groups = [line for line in _plan(v).splitlines() if "Aggregate" in line]
    assert not any("producto" in line for line in groups)
    got = {(r[0], r[1]): r[2] for r in v.collect()}
    assert got[(0, S.VERDICT_PASS)] == 1 and got[(0, S.VERDICT_DUPLICATE)] == 1 and got[(3, S.VERDICT_DUPLICATE)] == 2


def test_many_copies_unfold(spark, monkeypatch):
    monkeypatch.setattr(G, "COPIES_AT_ONCE", 3)
    raw = frame(spark, gate_rows()[:2])
    v = G.verdicts(raw.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(8)))).drop("i"), HOY)
    got = {(r[0], r[1]): r[2] for r in v.groupBy("fila_origen", G.VERDICT).count().collect()}
    assert got == {(i, w): n for i in (0, 1) for w, n in ((S.VERDICT_PASS, 1), (S.VERDICT_DUPLICATE, 7))}


def test_customers_join_only_where_asked_for(spark):
    clean = _gate(spark).clean
    assert "Join" not in _plan(clean.where("sospechoso").select("pedido_id", "importe"))
    assert "Join" in _plan(clean.select("cliente"))
    assert {r[0] for r in clean.select("cliente").collect()} == {"Maderas Núñez"}


def test_page_carries_its_own_rows(spark):
    """The last key of a page enters its plan, nulls and ties included."""
    rows = spark.range(60).select(
        F.col("id").alias("fila_origen"), F.concat(F.lit("P"), "id").alias("pedido_id"),
        F.when(F.col("id") % 7 != 0, F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 5 as int))")).alias("fecha"),
        *[F.lit("x").alias(c) for c in ("comercial", "zona", "cliente", "tipo_cliente", "producto", "familia")],
        *[F.lit(1.0).alias(c) for c in ("cantidad", "precio_unitario", "importe")], F.lit(False).alias("es_devolucion"), F.lit(False).alias("sospechoso"))
    for orden, by_day in (("fecha", False), ("fecha", True), ("registro", False)):
        whole = [r[0] for r in rows.orderBy(*E.order_columns(rows, orden, by_day)).select("pedido_id").collect()]
        for offset in (0, 7, 45, 58, 60):
            q = E.Query(limite=10, offset=offset, orden=orden)
            got = E.page(rows, q, by_day).orderBy("posicion").collect()
            assert [r.pedido_id for r in got] == whole[offset:offset + 10]
    assert "2025-01-05" in _plan(E.page(rows, E.Query(limite=3)))


def test_rollup_sets_are_words(spark):
    """A set of one customer takes one word of 64, not a whole bitmap."""
    rolled = R.build(_gate(spark).clean)
    people = rolled.people.collect()
    assert people and all(isinstance(r["clientes"], int) and bin(r["clientes"] % (1 << 64)).count("1") == 1 for r in people)
    k = R.kpis(rolled, dt.date(2025, 1, 1), dt.date(2025, 12, 31)).first()
    assert k["clientes"] == 1


def test_sheet_is_joined_once(spark):
    from ordergate.plans import catalog
    assert "Join" not in _plan(catalog.orders_of(spark, "/root/testdata/sf0.001"))


def test_partitions_follow_the_files(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert storage.partitions_for(rows) == 1
    monkeypatch.setattr(storage, "SHUFFLED_BYTES", 100)
    assert storage.partitions_for(rows) > 7


def test_broken_sheet_is_refused_before_staging(spark, tmp_path, monkeypatch):
    """Without a quarantine a row that breaks a constraint ends the run before anything is staged."""
    import pytest
    from ordergate.plans import publish as PB, refresh as RF
    from ordergate.sources.sheet import Source
    rows = gate_rows()
    rows[2]["producto"] = None
    frame(spark, rows).write.parquet(str(tmp_path / "hoja" / "Pedidos"))
    monkeypatch.setattr(RF, "stage_observed", lambda *a: pytest.fail("staged"))
    with pytest.raises(PB.PublishError, match="constraint checks failed: {'producto_nulo': 1}"):
        RF.refresh(spark, [Source("source", str(tmp_path / "hoja"))], str(tmp_path / "pub"), HOY)
