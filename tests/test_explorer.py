"""The explorer on seven hand-marked rows (no ``fila_origen``: old data)."""

import pytest
from pyspark.sql import functions as F

from ordergate.operators import explorer as E
from tests.fixtures import shop_rows


@pytest.fixture(scope="module")
def clean(spark):
    return shop_rows(spark).cache()


def _ids(df):
    return [r.pedido_id for r in df.orderBy("posicion").collect()]


def _total(clean, **kw):
    return E.totals(E.filtered(clean, E.Query(**kw))).first().total


def test_newest_first(clean):
    assert _ids(E.page(clean, E.Query()))[0] == "Q5"


def test_marks(clean):
    assert _total(clean) == 7
    assert _ids(E.page(clean, E.Query(marca="senalados"))) == ["Q6"]
    assert _ids(E.page(clean, E.Query(marca="devoluciones"))) == ["Q3"]
    assert _total(clean, marca="sin_senalados") == 6


def test_unknown_mark_rejected(clean):
    with pytest.raises(ValueError):
        E.filtered(clean, E.Query(marca="todo"))


@pytest.mark.parametrize("q,n", [("prat", 3), ("PRAT", 3), ("puerta", 2), ("Q5", 1), ("haya", 2),
                                 ("iker", 2), ("nothing", 0), ("  prat  ", 3), ("%", 0)])
def test_search(clean, q, n):
    assert _total(clean, q=q) == n


def test_rep_and_amount(clean):
    t = E.totals(E.filtered(clean, E.Query(comercial="Iker Otxoa", limite=1))).first()
    assert (t.total, t.importe) == (2, 986)
    assert len(_ids(E.page(clean, E.Query(comercial="Iker Otxoa", limite=1)))) == 1


def test_dates(clean):
    ids = _ids(E.page(clean, E.Query(desde="2025-03-01", hasta="2025-03-02")))
    assert sorted(ids) == ["Q4", "Q7"]


def test_combined(clean):
    assert _ids(E.page(clean, E.Query(comercial="Ona Vila", marca="devoluciones"))) == ["Q3"]


def test_pages_disjoint_and_complete(clean):
    pages = [_ids(E.page(clean, E.Query(limite=3, offset=o))) for o in (0, 3, 6, 9)]
    assert [len(p) for p in pages] == [3, 3, 1, 0]
    assert [i for p in pages for i in p] == _ids(E.page(clean, E.Query()))


def test_clamp(clean):
    q = E.Query(limite=99999, offset=-5).clamped()
    assert (q.limite, q.offset) == (200, 0)
    assert E.Query(limite=0).clamped().limite == 1


def test_keyset_matches_offset(spark):
    from ordergate.plans.catalog import gate_of
    clean = gate_of(spark, "/root/testdata/sf0.001").clean
    first = E.page(clean, E.Query(limite=50)).orderBy("posicion").collect()
    by_offset = [r.fila_origen for r in E.page(clean, E.Query(limite=50, offset=50))
                 .orderBy("posicion").collect()]
    last = clean.where(F.col("fila_origen") == first[-1].fila_origen).first()
    by_key = [r.fila_origen for r in E.page_after(clean, E.Query(limite=50), last.fecha,
                                                  last.fila_origen).orderBy("posicion").collect()]
    assert by_key == by_offset


def test_input_not_mutated(clean):
    before = clean.count()
    E.page(clean, E.Query(marca="senalados")).collect()
    assert clean.count() == before and "posicion" not in clean.columns


@pytest.mark.parametrize("by_day,orden", [(False, "fecha"), (True, "fecha"), (False, "registro")])
def test_pages_at_any_offset(spark, monkeypatch, by_day, orden):
    """Pages found by counting key ranges are the slices of the whole order."""
    from ordergate import schema as S
    from ordergate.plans.catalog import gate_of
    clean = gate_of(spark, "/root/testdata/sf0.001").clean.limit(1500).cache()
    # Some rows share a day, some the moment, some have none.
    clean = clean.withColumn("fecha", F.when(F.col("fila_origen") % 50 == 0, None)
                             .when(F.col("fila_origen") % 7 < 3, F.lit("2000-01-01 10:30:00").cast("timestamp_ntz"))
                             .otherwise(F.col("fecha"))).cache()
    monkeypatch.setattr(E, "NARROW", 8)
    monkeypatch.setattr(S, "PAGE_MAX", 40)
    order = [r.fila_origen for r in clean.orderBy(*E.order_columns(clean, orden, by_day)).collect()]
    for offset in (1, 39, 400, 777, 1480, 1499, 1500, 9999):
        got = E.page(clean, E.Query(limite=30, offset=offset, orden=orden), by_day=by_day).orderBy("posicion").collect()
        assert [r.fila_origen for r in got] == order[offset:offset + 30], offset
        assert [r.posicion for r in got] == list(range(offset + 1, offset + 1 + len(got)))
