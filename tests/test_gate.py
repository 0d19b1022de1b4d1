"""The gate on hand-made rows: purity, idempotency, each rule and its edges."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordergate import schema as S
from ordergate.operators import gate as G
from ordergate.operators.gate import run_gate, verdicts
from tests.fixtures import DIRTY, frame, gate_rows

HOY = dt.date(2025, 6, 30)


def _gate(spark, rows, hoy=HOY):
    return run_gate(frame(spark, rows), hoy)


def _verdicts(spark, rows, hoy=HOY):
    return [r["veredicto"] for r in verdicts(frame(spark, rows), hoy).orderBy("fila_origen").collect()]


def test_gate_on_rows(spark):
    res = _gate(spark, gate_rows())
    clean = res.clean.orderBy("fila_origen").collect()
    assert [r.pedido_id for r in clean] == ["A-100", "A-101", "A-102"]
    assert {r.cliente for r in clean} == {"Maderas Núñez"}        # the most frequent spelling
    assert [r.es_devolucion for r in clean] == [False, True, False]
    assert not any(r.sospechoso for r in clean)
    assert res.threshold == pytest.approx(85.0 + 0.999 * (124.0 - 85.0))
    lines = {r: n for _, r, n, _ in res.incident_rows()}
    assert lines == {S.RULE_SPELLINGS: 2, S.RULE_DUPLICATES: 1, S.RULE_RETURNS: 1}
    acc = [a for _, r, _, a in res.incident_rows() if r == S.RULE_SPELLINGS][0]
    assert acc == "unificados: 3 grafías → 1 clientes reales"


def test_idempotent(spark):
    once = _gate(spark, gate_rows()).clean
    twice = run_gate(once, HOY).clean
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_returns_subtract(spark):
    clean = _gate(spark, gate_rows()).clean
    row = clean.agg(F.sum("importe").alias("neta"),
                    F.sum(F.when(~F.col("es_devolucion"), F.col("importe"))).alias("bruta")).first()
    assert row.neta < row.bruta


@pytest.mark.parametrize("fecha", ["2025-06-30", "2025-06-30 10:30:00", "2025-06-30 23:59:59"])
def test_today_passes_any_time(spark, fecha):
    rows = gate_rows()
    rows[0]["fecha"] = fecha
    assert _verdicts(spark, rows)[0] == S.VERDICT_PASS


def test_tomorrow_is_future(spark):
    rows = gate_rows()
    rows[0]["fecha"] = "2025-07-01"
    v = _verdicts(spark, rows)
    assert v[0] == S.VERDICT_FUTURE.format(hoy="2025-06-30")
    assert v[3] == S.VERDICT_DUPLICATE          # Q12: the duplicate rule comes first


@pytest.mark.parametrize("fecha", [None, "el martes que viene", "12345", "2025-02-30", "10/03/2025"])
def test_unreadable_date(spark, fecha):
    rows = gate_rows()
    rows[1]["fecha"] = fecha
    res = _gate(spark, rows)
    lines = {r: n for _, r, n, _ in res.incident_rows()}
    assert lines[S.RULE_BAD_DATE] == 1
    assert _verdicts(spark, rows)[1] == S.VERDICT_BAD_DATE


def test_mismatch_explained(spark):
    from ordergate.operators.report import mismatch_explained
    rows = gate_rows()
    rows[0]["importe"] = 124.50
    v = verdicts(frame(spark, rows), HOY)
    r = mismatch_explained(v).first()
    assert (r.esperado, r.diferencia) == (124.0, 0.5)


def test_null_and_nan_amount_pass(spark):
    for bad in (None, math.nan):
        rows = gate_rows()
        rows[0]["importe"] = bad
        assert _verdicts(spark, rows)[0] == S.VERDICT_PASS


def test_bad_first_copy_discards_both(spark):
    rows = gate_rows()
    rows[0]["importe"] = 999.0                      # the first copy mismatches, the second is a duplicate
    v = _verdicts(spark, rows)
    assert v[0] == S.VERDICT_MISMATCH and v[3] == S.VERDICT_DUPLICATE


def test_zero_and_tolerance(spark):
    rows = gate_rows()
    rows[0]["cantidad"], rows[0]["importe"] = 0.0, 0.0
    assert _verdicts(spark, rows)[0] == S.VERDICT_ZERO
    rows = gate_rows()
    rows[0]["importe"] = 124.02
    assert _verdicts(spark, rows)[0] == S.VERDICT_PASS


def test_two_null_ids(spark):
    rows = gate_rows()
    rows[0]["pedido_id"] = None
    rows[1]["pedido_id"] = None
    v = _verdicts(spark, rows)
    assert v[0] == S.VERDICT_PASS and v[1] == S.VERDICT_DUPLICATE


def test_unreadable_number_counted(spark):
    from pyspark.sql import types as T
    rows = [("P1", "2025-03-10", "Marta", "X", "C", "R", "Prod", "F", "10", "11.2", "doce")]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["pedido_id", "fecha", "comercial", "zona", "cliente", "tipo_cliente",
                            "producto", "familia", "cantidad", "precio_unitario", "importe"]])
    res = run_gate(spark.createDataFrame(rows, schema), HOY)
    lines = {r: n for _, r, n, _ in res.incident_rows()}
    assert lines[S.RULE_BAD_NUMBER] == 1
    assert res.clean.count() == 1                   # NULL amount passes (reference behaviour)


def test_verdict_equals_gate(spark, ):
    from ordergate.sources.testdata import dirty_orders, TESTDATA_TODAY
    raw = dirty_orders(spark, "/root/testdata/sf0.001")
    res = run_gate(raw, TESTDATA_TODAY)
    passing = verdicts(raw, TESTDATA_TODAY).where(F.col("veredicto") == S.VERDICT_PASS)
    assert passing.select("fila_origen").exceptAll(res.clean.select("fila_origen")).count() == 0
    assert res.clean.count() == passing.count()


def test_every_loss_explained(spark):
    from ordergate.operators.report import conservation
    from ordergate.sources.testdata import dirty_orders, TESTDATA_TODAY
    res = run_gate(dirty_orders(spark, "/root/testdata/sf0.001"), TESTDATA_TODAY)
    assert conservation(res).first().cuadra


def test_repeated_and_null_positions_keep_one(spark):
    """Supplied positions that repeat or are missing still leave one row per id."""
    rows = [dict(r, pedido_id="A-1") for r in gate_rows()[:3]] + [dict(gate_rows()[0], pedido_id="A-1")]
    for positions in ((5, 5, 5, 5), (None, None, None, None), (7, None, 7, 9)):
        df = frame(spark, rows).withColumn("fila_origen", F.element_at(
            F.array(*[F.lit(p).cast("long") for p in positions]), (F.col("fila_origen") + 1).cast("int")))
        got = [r.veredicto for r in verdicts(df, HOY).collect()]
        assert got.count(S.VERDICT_DUPLICATE) == 3, positions


def test_huge_amount_does_not_stop_the_run(spark):
    from ordergate.operators.report import run_summary
    rows = gate_rows()
    rows[0]["importe"] = 1e300
    res = _gate(spark, rows)
    assert run_summary(res).first().facturacion_cruda == pytest.approx(-27.0 + 85.0 + 15.5)
    assert {r: n for _, r, n, _ in res.incident_rows()}[S.RULE_BEYOND] == 1


def test_dates_of_a_source(spark):
    rows = gate_rows()
    for r, text in zip(rows, ["14/02/2025", "2025-05-20T10:00:00Z", "7/1/2025", "31/02/2025"]):
        r["fecha"] = text
    v = verdicts(frame(spark, rows), HOY, ("dd/MM/yyyy", "d/M/yyyy")).orderBy("fila_origen").collect()
    assert [str(r.fecha) for r in v[:3]] == ["2025-02-14 00:00:00", "2025-05-20 10:00:00", "2025-01-07 00:00:00"]
    assert [r.veredicto for r in v] == [S.VERDICT_PASS] * 3 + [S.VERDICT_DUPLICATE] and v[3].fecha is None


@pytest.mark.parametrize("parts, seed", [(1, 1), (8, 2), (64, 3), (8, 3)])
def test_duplicates_depend_on_the_data_alone(spark, parts, seed):
    """Repeated and null positions, rows equal in every cell, null ids: one row of each id stays,
    the same one however the sheet is dealt."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        row = dict(gate_rows()[0], pedido_id=rng.choice([None, "A", "B", *map(str, range(150))]),
                   importe=rng.choice([124.0, 125.0, 0.0]))
        rows += [(rng.choice([None, 1, 2, i]), row)] * rng.choice([1, 1, 2, 3])
    random.Random(seed).shuffle(rows)
    schema = T.StructType([T.StructField("fila_origen", T.LongType()), *DIRTY.fields])
    raw = spark.createDataFrame([(p, *[r.get(f.name) for f in DIRTY.fields]) for p, r in rows], schema)
    got = G.verdicts(raw.repartition(parts), "2025-06-30").collect()
    assert len(got) == len(rows)
    stay = [r for r in got if r.veredicto != S.VERDICT_DUPLICATE]
    assert sorted(str(r.pedido_id) for r in stay) == sorted({str(r["pedido_id"]) for _, r in rows})
    for r in stay:
        least = min((p if p is not None else 1 << 62) for p, x in rows if x["pedido_id"] == r.pedido_id)
        assert (r.fila_origen if r.fila_origen is not None else 1 << 62) == least
    key = [(str(r.pedido_id), r.fila_origen, r.importe) for r in stay]
    _SEEN.setdefault("key", sorted(key, key=str))
    assert sorted(key, key=str) == _SEEN["key"]


_SEEN = {}


def test_very_many_equal_rows_are_unfolded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "COPIES_AT_ONCE", 7)
    raw = frame(spark, [gate_rows()[0]] * 50, with_position=False).withColumn("fila_origen", F.lit(None).cast("long"))
    counts = {r[0]: r[1] for r in G.verdicts(raw, "2025-06-30").groupBy("veredicto").count().collect()}
    assert counts[S.VERDICT_DUPLICATE] == 49 and sum(counts.values()) == 50
