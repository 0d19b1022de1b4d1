"""Golden values of the derived dirty table (FIXTURES.md §4.3, sf0.001) and
partition-count invariance of the results."""

from decimal import Decimal

import pytest

from ordergate.operators import dashboard as D, metrics as M, report as R
from ordergate.operators.gate import run_gate, verdicts
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def gate(spark):
    return run_gate(dirty_orders(spark, SF_SMALL), TESTDATA_TODAY, materialize=True)


def test_gate_golden(gate):
    c = gate.counts
    assert (c["crudas"], c["duplicados"], c["fecha_ilegible"], c["fecha_futura"], c["no_cuadra"],
            c["importe_cero"], c["limpias"]) == (6000, 1407, 48, 242, 44, 31, 4228)
    assert (c["grafias"], c["clientes"]) == (595, 150)
    assert (c["devoluciones"], c["senalados"]) == (125, 2)
    assert (c["huecos_comercial"], c["huecos_tipo_cliente"], c["huecos_familia"]) == (64, 97, 109)
    assert round(gate.threshold, 2) == 45937.33


def test_summary_golden(gate):
    s = R.run_summary(gate).first()
    assert s.filas_limpias == 4226
    assert Decimal(str(s.facturacion_cruda)) == Decimal("137585703.10")
    assert Decimal(str(s.facturacion_limpia)) == Decimal("91150251.20")


def test_kpi_golden(gate):
    base = M.metric_base(gate.clean)
    win = M.kpi_bounds(base)
    assert (str(win.desde), str(win.hasta)) == ("2000-06-30", "2001-06-30")
    k = M.kpi_frame(base, win).first()
    assert k.facturacion == Decimal("15177333.60") and k.pedidos == 677
    assert round(k.bruta / k.n_ventas, 2) == Decimal("23514.70")
    assert k.devoluciones == Decimal("365882.00")
    assert k.facturacion_anterior == Decimal("15002986.70")
    kpi = M.kpis(gate.clean).first()
    assert (kpi.facturacion, kpi.ticket, kpi.devoluciones) == (15177334, 23515, 365882)
    assert M.monthly_series(gate.clean).count() == 78


def test_payload_parts(gate):
    p = M.payload(gate.clean, TESTDATA_TODAY)
    assert p["kpi"].first().pedidos == 677
    tops = p["tops"].groupBy("dimension").count().collect()
    assert {r.dimension: r["count"] for r in tops}["producto"] == 10
    assert p["rango"].first().hasta.isoformat() == "2001-06-30"


def test_dashboard_summary_matches_parts(gate):
    f = D.Filters(tipo_cliente="BUILDING")
    parts = D.dash_summary(gate.clean, f)
    assert parts["kpis"].collect() == D.dash_kpis(gate.clean, f).collect()
    assert sorted(parts["mes"].collect()) == sorted(D.dash_monthly(gate.clean, f).collect())
    empty = D.dash_kpis(gate.clean, D.Filters(comercial="nobody")).first()
    assert (empty.facturacion, empty.pedidos, empty.ticket, empty.var_pct, empty.desde) == (0, 0, 0, None, None)


@pytest.mark.parametrize("parts", [1, 64])
def test_partition_invariance(spark, gate, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        raw = dirty_orders(spark, SF_SMALL).repartition(parts)
        other = run_gate(raw, TESTDATA_TODAY)
        assert other.counts == gate.counts
        assert other.threshold == gate.threshold
        cols = ["fila_origen", "cliente", "sospechoso"]
        assert other.clean.select(cols).exceptAll(gate.clean.select(cols)).count() == 0
        v = verdicts(raw, TESTDATA_TODAY).groupBy("veredicto").count()
        assert sorted(v.collect()) == sorted(R.verdict_summary(gate.verdicts).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_gate_idempotent_on_testdata(gate):
    again = run_gate(gate.clean, TESTDATA_TODAY)
    assert again.threshold == gate.threshold
    assert gate.clean.exceptAll(again.clean).count() == 0
    assert again.clean.exceptAll(gate.clean).count() == 0


def test_invariants_hold(gate):
    from ordergate.operators.checks import invariants
    broken = {r.invariante: r.filas_que_lo_rompen for r in invariants(gate.clean, TESTDATA_TODAY).collect()}
    assert set(broken) >= {"pedidos_duplicados", "fechas_futuras", "importes_no_cuadran", "importes_cero",
                           "claves_con_varios_nombres", "nombres_sin_recortar", "huecos_sin_etiqueta",
                           "neta_no_menor_que_bruta"}
    assert all(v == 0 for v in broken.values()), broken
