"""The file index: answers equal to the whole table's, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from ordergate.operators import dashboard as D, explorer as E
from ordergate.plans import fileindex as I
from ordergate.plans.catalog import gate_of
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def clean(spark):
    """Moments and positions that repeat or are missing (a third of the rows at one moment), null
    categories, names beyond ASCII, of two letters or missing."""
    odd = F.col("fila_origen")
    k = F.pmod(F.xxhash64("pedido_id"), F.lit(60))
    rows = gate_of(spark, SF_SMALL).clean.limit(1200)
    return rows.withColumn("k", k).withColumns({
        "fecha": F.when(F.col("k") == 0, None).when(F.col("k") < 21, F.lit("2000-01-01 10:30:00").cast("timestamp_ntz")).otherwise(F.col("fecha")),
        "comercial": F.when(F.col("k") == 1, None).otherwise(F.col("comercial")),
        "cliente": F.when(F.col("k") == 2, "Ca l\u2019\u00c0ngel \U0001F600\U0001F601x").when(F.col("k") == 3, None)
                    .when(F.col("k") == 4, "ab").otherwise(F.col("cliente")),
        "fila_origen": F.when(F.col("k") == 5, None).when(F.col("k") == 6, 7).otherwise(odd)}).drop("k").cache()


@pytest.fixture(scope="module", params=I.LAYOUTS)
def indexed(spark, clean, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / request.param)
    I.save(clean, path, request.param, at_least=12)
    return request.param, I.load(spark, path)


def rows_in(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_rows(clean, indexed):
    assert rows_in(indexed[1].rows) == rows_in(clean.select(indexed[1].rows.columns))
    assert indexed[1].files.count() == 12


@pytest.mark.parametrize("by_day,orden", [(False, "fecha"), (True, "fecha"), (False, "registro")])
def test_pages(clean, indexed, by_day, orden):
    """Pages are the slices of the whole order. Rows equal in every sort key may stand either way."""
    layout, t = indexed
    total = clean.count()
    for offset in (0, 611, total - 1, 5000):
        q = E.Query(limite=25, offset=offset, orden=orden)
        assert rows_in(I.page(t, q, by_day)) == rows_in(E.page(clean, q, by_day)), (layout, offset)


def test_page_reads_few_files(clean, indexed):
    """In the explorer's layout a page lies in one or two files, at a moment shared by a third too."""
    layout, t = indexed
    if layout == "fecha":
        for offset in range(0, 1200, 300):
            files, skipped = I.page_files(t, E.Query(limite=25, offset=offset))
            assert files.count() <= 2 and skipped <= offset


def test_ranks_hold_every_row(clean, indexed):
    """Brute force: each row's rank lies within its file's."""
    _, t = indexed
    rows = t.rows.withColumn("archivo", F.col("_metadata.file_name"))
    first = rows.orderBy(*E.order_columns(rows, "fecha")).select("archivo").collect()
    ranks = {f.archivo: (f.fecha_antes, f.fecha_hasta) for f in t.files.collect()}
    for i, row in enumerate(first):
        lo, hi = ranks[row.archivo]
        assert lo <= i < hi


@pytest.mark.parametrize("needle", ["\u2019\u00c0ngel \U0001F600", "\U0001F600\U0001F601x", "AB", "ab", "custo", "00001", "%", "p1-6", "no such"])
def test_search(clean, indexed, needle):
    q = E.Query(q=needle)
    assert rows_in(I.search(indexed[1], q)) == rows_in(E.filtered(clean, q).select(indexed[1].rows.columns))
    assert I.totals(indexed[1], q).first() == E.totals(E.filtered(clean, q)).first()


def test_random_needles(clean, indexed):
    """Any stretch of any cell is found, and rules out some files."""
    rng = random.Random(5)
    cells = [c for r in clean.select("cliente", "producto", "pedido_id", "comercial").limit(200).collect() for c in r if c]
    fewer = 0
    for _ in range(5):
        cell = rng.choice(cells)
        a = rng.randrange(max(1, len(cell) - 3))
        q = E.Query(q=cell[a:a + rng.randint(3, 9)])
        if not q.q.strip():
            continue
        assert I.search(indexed[1], q).count() == E.filtered(clean, q).count() > 0
        fewer += I.chosen(indexed[1], q).count() < 12
    assert fewer


@pytest.mark.parametrize("kw", [dict(tipo_cliente="BUILDING"), dict(comercial="Supplier#000000003", familia="SMALL"),
                                dict(zona="none such"), dict(comercial="Supplier#000000003", q="brand#1", desde="1999-01-01", hasta="2000-06-30")])
def test_filters(clean, indexed, kw):
    q = E.Query(**kw, limite=200)
    assert rows_in(I.page(indexed[1], q)) == rows_in(E.page(clean, q))


def test_dashboard(clean, indexed):
    f = D.Filters(zona="NATION_16", familia="MEDIUM")
    layout, t = indexed
    got, want = I.dash_summary(t, f), D.dash_summary(clean, f)
    assert rows_in(got["kpis"]) == rows_in(want["kpis"]) and rows_in(got["rankings"]) == rows_in(want["rankings"])
    if layout == "filtros":
        assert I.chosen(t, E.Query(zona="NATION_16", familia="MEDIUM")).count() < 12


def test_figures(clean, indexed):
    from ordergate.operators.metrics import date_range, metric_base
    assert I.date_range(indexed[1]).first() == date_range(metric_base(clean)).first()
    assert I.totals(indexed[1], E.Query()).first() == E.totals(clean).first()


def test_many_files_and_ranges(spark, clean, indexed, monkeypatch, tmp_path):
    """More chosen files than are listed, and files counted by few or many ranges: same answers."""
    q = E.Query(q="brand#1", limite=200)
    monkeypatch.setattr(I, "LISTED", 2)
    assert rows_in(I.page(indexed[1], q)) == rows_in(E.page(clean, q))
    monkeypatch.setattr(I, "BUCKETS", 3)
    I.save(clean, f"{tmp_path}/t", at_least=12)
    again = I.load(spark, f"{tmp_path}/t")
    q = E.Query(offset=611)
    assert rows_in(I.page(again, q)) == rows_in(E.page(clean, q))


def test_numbers_of_bitmaps(spark):
    """File numbers beyond one bitmap come back as they went in."""
    wanted = [1, 8, 9, 32768, 32769, 40000, 65537, 400_000]
    bitmaps = (spark.createDataFrame([(n,) for n in wanted], "numero long")
               .groupBy(F.expr("bitmap_bucket_number(numero)").alias("tramo"))
               .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(numero))").alias("archivos")))
    assert sorted(r.numero for r in I._numbers(bitmaps).collect()) == wanted


@pytest.mark.parametrize("layout", I.LAYOUTS)
def test_empty(spark, clean, tmp_path, layout):
    I.save(clean.limit(0), f"{tmp_path}/t", layout)
    t = I.load(spark, f"{tmp_path}/t")
    assert I.page(t, E.Query()).count() == 0 and I.page(t, E.Query(q="abc", zona="x", offset=3)).count() == 0
    assert tuple(I.totals(t, E.Query()).first()) == (0, 0)
    assert tuple(I.date_range(t).first()) == (None, None)


def test_unknown_layout(clean, tmp_path):
    with pytest.raises(ValueError):
        I.save(clean, f"{tmp_path}/t", "otra")
