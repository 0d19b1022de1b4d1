"""Sheet reading: tab choice, column contract, all-text reads, fallback."""

import pytest
from pyspark.sql import functions as F

from ordergate.sources.sheet import (MissingColumns, NoSource, Source, check_columns, conform,
                                     first_available, read_orders, resolve_tab, with_row_position)
from ordergate.sources.testdata import dirty_orders


@pytest.fixture(scope="module")
def small(spark):
    return dirty_orders(spark, "/root/testdata/sf0.001").limit(50).cache()


def test_tab_choice(spark, small, tmp_path):
    small.write.parquet(str(tmp_path / "book" / "Otra"))
    small.limit(5).write.parquet(str(tmp_path / "book" / "Pedidos"))
    assert resolve_tab(spark, str(tmp_path / "book")).endswith("/Pedidos")
    assert read_orders(spark, str(tmp_path / "book")).count() == 5
    small.write.parquet(str(tmp_path / "book2" / "Hoja1"))
    assert resolve_tab(spark, str(tmp_path / "book2")).endswith("/Hoja1")
    with pytest.raises(NoSource):
        resolve_tab(spark, str(tmp_path / "missing"))


def test_contract(small):
    check_columns(small)
    with pytest.raises(MissingColumns, match="importe"):
        check_columns(small.drop("importe"))
    extra = conform(small.drop("zona", "comercial"))
    assert {"zona", "comercial"} <= set(extra.columns)


def test_csv_all_text(spark, small, tmp_path):
    small.write.option("header", "true").csv(str(tmp_path / "csv"))
    df = read_orders(spark, str(tmp_path / "csv"), "csv")
    assert all(t == "string" for _, t in df.dtypes)
    from ordergate.operators.gate import prepare
    typed = prepare(df)
    assert dict(typed.dtypes)["importe"] == "double" and dict(typed.dtypes)["fecha"] == "timestamp_ntz"
    joined = typed.alias("a").join(small.alias("b"), "fila_origen")
    assert joined.where(~F.col("a.importe").eqNullSafe(F.col("b.importe"))).count() == 0


def test_fallback_order(spark, small, tmp_path):
    small.write.parquet(str(tmp_path / "good"))
    spark.range(3).write.parquet(str(tmp_path / "wrong"))
    got = first_available(spark, [Source("source", str(tmp_path / "nothing")),
                                  Source("cache", str(tmp_path / "wrong")),
                                  Source("reference", str(tmp_path / "good"))])
    assert got.origen == "reference" and "source" in got.aviso and "cache" in got.aviso
    assert first_available(spark, [Source("source", str(tmp_path / "good"))]).aviso is None
    with pytest.raises(NoSource):
        first_available(spark, [Source("source", str(tmp_path / "wrong"))])


def test_partitioned_folder_is_one_sheet(spark, small, tmp_path):
    """Partition folders are not tabs, and several tabs without Pedidos are refused."""
    path = str(tmp_path / "by_year")
    small.withColumn("year", F.when(F.col("fila_origen") % 2 == 0, 2024).otherwise(2025)).write.partitionBy("year").parquet(path)
    assert read_orders(spark, path).count() == small.count()
    for tab in ("A", "B"):
        small.write.parquet(str(tmp_path / "tabs" / tab))
    with pytest.raises(NoSource, match="Pedidos"):
        read_orders(spark, str(tmp_path / "tabs"))


def test_csv_headers_and_quotes(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('cliente,producto\n"Say ""hi""",p1\n')
    df = read_orders(spark, str(folder), "csv")
    assert [tuple(r) for r in df.select("cliente", "producto").collect()] == [('Say "hi"', "p1")]
    (folder / "b.csv").write_text("producto,cliente\np2,c2\n")
    with pytest.raises(Exception, match="header"):
        read_orders(spark, str(folder), "csv").collect()


def test_positions_over_files(spark, small, tmp_path):
    """Files follow each other by the value of their numbers; the cache keeps positions and fingerprint."""
    import os
    from ordergate.plans.refresh import fingerprint
    from ordergate.sources.sheet import cache_snapshot, natural_order, switch_cache, with_row_position
    names = ["part-99999-x.parquet", "part-100000-x.parquet", "part-00002-x.parquet", "a10b2", "a9b10"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_order(F.col("n"))).collect()]
    assert got == ["a9b10", "a10b2", "part-00002-x.parquet", "part-99999-x.parquet", "part-100000-x.parquet"]
    rows = [r.pedido_id for r in small.orderBy("fila_origen").collect()]
    sheet = tmp_path / "sheet"
    for name, part in (("part-100000.parquet", rows[35:]), ("part-99999.parquet", rows[5:35]), ("part-7.parquet", rows[:5])):
        spark.createDataFrame([(p,) for p in part], "pedido_id string").coalesce(1).write.parquet(str(tmp_path / "one"), mode="overwrite")
        file = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
        os.makedirs(sheet, exist_ok=True)
        os.rename(tmp_path / "one" / file, sheet / name)
    df = spark.read.parquet(str(sheet))
    placed = {r.fila_origen: r.pedido_id for r in with_row_position(df).collect()}
    assert [placed[i] for i in range(len(rows))] == rows
    cache = str(tmp_path / "cache")
    copy = cache_snapshot(df, cache, "v1")
    switch_cache(spark, cache, "v1")
    again = read_orders(spark, cache)
    assert again.exceptAll(copy).count() == 0
    assert fingerprint(again).first().huella == fingerprint(with_row_position(df)).first().huella
    cache_snapshot(df.limit(3), cache, "v2")              # written, not yet the cached sheet
    assert read_orders(spark, cache).count() == len(rows)


def test_text_positions_survive_other_splits(spark, tmp_path):
    """How a text file is cut depends on the parallelism at planning; no row goes when it changes in between."""
    n = 200_000
    path = str(tmp_path / "rows")
    spark.range(n).select(F.col("id").cast("string").alias("pedido_id"), F.lit("x").alias("zona")).coalesce(3) \
        .write.option("header", "true").csv(path)
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        placed = with_row_position(read_orders(spark, path, "csv"))
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        assert placed.count() == n
        assert placed.agg(F.count_distinct("fila_origen"), F.max("fila_origen")).first() == (n, n - 1)
        assert placed.where(F.col("fila_origen") != F.col("pedido_id").cast("long")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)


HEADER = "pedido_id,fecha,cliente,producto,cantidad,precio_unitario,importe"


def test_lines_that_do_not_parse_are_counted(spark, tmp_path):
    from ordergate import schema as S
    from ordergate.operators import report as R
    from ordergate.operators.gate import run_gate
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(f"""{HEADER}
A1,2025-01-02,"Two
lines",p,1,2,2
A2,2025-01-02,short
A3,2025-01-02,c,p,1,2,2,too,long
A4,2025-01-02,c,p,1,2,2
""")
    (folder / "b.csv").write_text(f"{HEADER}\nA4,2025-01-03,c,p,1,2,2\n,2025-01-03,c,p,1,2,2\n")
    split = run_gate(read_orders(spark, str(folder), "csv"), "2025-06-30").counts
    assert (split["crudas"], split["registro_ilegible"], split["limpias"]) == (7, 4, 2)      # both lines of the first record
    raw = read_orders(spark, str(folder), "csv", multiline=True)
    res = run_gate(raw, "2025-06-30", materialize=True)
    c = res.counts
    assert c["crudas"] == 6 and c["registro_ilegible"] == 2 and c["duplicados"] == 1 and c["limpias"] == 3
    assert R.conservation(res).first().cuadra
    assert {r: n for _, r, n, _ in res.incident_rows()}[S.RULE_BAD_RECORD] == 2
    assert {r.cliente for r in res.clean.collect()} == {"Two\nlines", "c"}
    json = tmp_path / "json"
    json.mkdir()
    good = '{"pedido_id":"B%d","fecha":"2025-01-02","cliente":"c","producto":"p","cantidad":1,"precio_unitario":2,"importe":2}'
    (json / "a.json").write_text("\n".join([good % 1, (good % 2)[:50], good % 3]) + "\n")
    res = run_gate(read_orders(spark, str(json), "json"), "2025-06-30")
    assert (res.counts["crudas"], res.counts["registro_ilegible"], res.counts["limpias"]) == (3, 1, 2)
