"""Refresh and publish on a temporary shared folder: skip, force, new rules,
a failed check leaves the published data untouched, retention."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.plans import publish as PB
from ordergate.plans.refresh import fingerprint, refresh, unchanged
from ordergate.sources.sheet import NoSource, Source
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sheet(spark):
    path = tempfile.mkdtemp(prefix="og-sheet-") + "/hoja"
    dirty_orders(spark, SF).write.parquet(f"{path}/Pedidos")
    return path


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="og-pub-")


def test_blocked_publish_keeps_current(spark, sheet, root):
    ok = refresh(spark, [Source("source", sheet)], root, TESTDATA_TODAY, quarantine=True)
    assert ok.estado == "ok" and ok.resultado == "primera_carga"
    before = PB.current_pointer(spark, root)
    with pytest.raises(PB.PublishError):
        refresh(spark, [Source("source", sheet)], root, TESTDATA_TODAY, forzar=True)
    assert PB.current_pointer(spark, root) == before
    assert PB.read_state(spark, root)["ultimo_estado"] == "error"
    # the failed run's staging is gone
    assert len(PB.expired_versions(spark, root, dt.datetime.now(dt.timezone.utc)
                                   + dt.timedelta(days=30))) == 0
    runs = PB.read_runs(spark, root).groupBy("estado").count().collect()
    assert {r.estado: r["count"] for r in runs} == {"ok": 1, "error": 1}


def test_skip_force_and_fallback(spark, sheet, root):
    src = [Source("source", sheet), Source("cache", f"{root}/cache")]
    first = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    again = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert again.estado == "unchanged" and again.huella == first.huella
    lost = refresh(spark, [Source("source", f"{root}/nothing"), Source("cache", f"{root}/cache")],
                   root, TESTDATA_TODAY, quarantine=True)
    assert lost.origen == "cache" and lost.aviso and lost.estado == "unchanged"
    forced = refresh(spark, src, root, TESTDATA_TODAY, forzar=True, quarantine=True)
    assert forced.estado == "ok" and forced.resultado == "dato_nuevo"
    assert PB.current_pointer(spark, root)["seq"] == 2
    published = PB.load_current(spark, root).count()
    assert 0 < published < first.resumen["filas_publicadas"]     # quarantined rows set aside


def test_new_cut_off_reprocesses(spark, sheet, root):
    src = [Source("source", sheet)]
    refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    later = refresh(spark, src, root, "2001-12-31", quarantine=True)
    assert later.estado == "ok"             # future-dated rows may now be valid (Q13)


def test_rule_version_change(monkeypatch):
    state = dict(ultima_huella="h", version_puerta=S.RULE_VERSION, ultimo_estado="ok", filas_limpias=1)
    hoy = dt.date(2001, 6, 30)
    assert unchanged(state, "h", hoy, True)
    assert not unchanged(state, "h", hoy, True, forzar=True)
    assert not unchanged(dict(state, version_puerta=S.RULE_VERSION - 1), "h", hoy, True)
    assert not unchanged(state, "h", hoy, False)
    assert not unchanged(dict(state, ultimo_estado="error"), "h", hoy, True)


def test_no_source(spark, root):
    with pytest.raises(NoSource):
        refresh(spark, [Source("source", f"{root}/none")], root, TESTDATA_TODAY)
    assert PB.read_state(spark, root)["ultimo_estado"] == "error"


def test_fingerprint_contract(spark):
    raw = dirty_orders(spark, SF)
    a = fingerprint(raw).first().huella
    assert fingerprint(raw.repartition(5)).first().huella == a          # partitioning-free
    changed = raw.withColumn("importe", F.when(F.col("fila_origen") == F.lit(
        raw.agg(F.min("fila_origen")).first()[0]), F.lit(1.0)).otherwise(F.col("importe")))
    assert fingerprint(changed).first().huella != a
    moved = raw.withColumn("fila_origen", F.col("fila_origen") + 1)
    assert fingerprint(moved).first().huella != a                       # order matters
    blanked = raw.withColumn("zona", F.coalesce(F.col("zona"), F.lit("")))
    assert fingerprint(blanked).first().huella != a                     # NULL is not 


def test_retention(spark, sheet, root):
    src = [Source("source", sheet)]
    refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    refresh(spark, src, root, TESTDATA_TODAY, forzar=True, quarantine=True)
    # Written long ago but replaced just now: its readers may still be at work.
    soon = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1)
    assert PB.expired_versions(spark, root, soon) == []
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=8)
    gone = PB.apply_retention(spark, root, later)
    assert len(gone) == 2                   # raw + clean of the first run; current kept
    assert PB.load_current(spark, root).count() > 0


@pytest.mark.parametrize("step", ["apply_retention", "append_run", "write_state", "switch_cache"])
def test_failures_after_the_pointer_lose_nothing(spark, sheet, root, monkeypatch, step):
    """What fails after the commit is a warning; readers get the new version in full."""
    from ordergate.plans import refresh as RF
    src = [Source("source", sheet)]
    first = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    published = {"yes": False}
    pointer = PB.publish_pointer

    def commit(*a, **k):
        out = pointer(*a, **k)
        published["yes"] = True
        return out
    monkeypatch.setattr(PB, "publish_pointer", commit)
    where = RF if step == "switch_cache" else PB
    real = getattr(where, step)

    def broken(*a, **k):
        if published["yes"]:
            raise OSError("disk gone")
        return real(*a, **k)
    monkeypatch.setattr(where, step, broken)
    second = refresh(spark, src, root, TESTDATA_TODAY, forzar=True, quarantine=True)
    assert second.estado == "ok" and any("disk gone" in w for w in second.advertencias)
    assert PB.current_pointer(spark, root)["sync_id"] == second.sync_id
    assert PB.load_current(spark, root).count() == first.pointer["filas"]["clean"]


def test_half_written_pointer_is_passed_over(spark, sheet, root):
    import os
    src = [Source("source", sheet)]
    first = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    with open(f"{root}/_pointers/{2:012d}.json", "w"):
        pass
    assert PB.load_current(spark, root).count() == first.pointer["filas"]["clean"]
    again = refresh(spark, src, root, TESTDATA_TODAY, forzar=True, quarantine=True)
    assert again.pointer["seq"] == 3 and PB.current_pointer(spark, root)["sync_id"] == again.sync_id
    with pytest.raises(Exception):
        PB.write_text(spark, f"{root}/_pointers/{3:012d}.json", "{}", replace=False)
    assert not [n for n in os.listdir(f"{root}/_pointers") if n.startswith("_tmp")]


def test_every_row_accounted_for(spark, sheet, root):
    run = refresh(spark, [Source("source", sheet)], root, TESTDATA_TODAY, quarantine=True)
    aside = {line["regla"]: line["filas"] for line in run.incidencias if line["regla"].startswith("Cuarentena")}
    assert sum(aside.values()) == run.pointer["filas"]["cuarentena"] > 0
    assert run.resumen["filas_publicadas"] == run.pointer["filas"]["clean"] + run.pointer["filas"]["cuarentena"]
    assert f"{run.pointer['filas']['clean']:,} rows published" in run.mensaje
    later = refresh(spark, [Source("source", sheet)], root, "2001-12-31", quarantine=True)
    assert later.antes["filas_limpias"] == run.resumen["filas_limpias"]
    assert later.delta["filas_limpias"] == later.resumen["filas_limpias"] - run.resumen["filas_limpias"] != 0
    assert f"{later.delta['filas_limpias']:+,}" in later.mensaje
    state = PB.read_state(spark, root)
    assert state["origen_dato"] == "source" and state["dato_de"] is not None and state["aviso"] is None


def test_quality_documents(spark, root):
    import json
    from ordergate.operators.dashboard import dash_quality
    empty = dash_quality(PB.read_runs(spark, root), PB.read_state_frame(spark, root)).first()
    assert (empty.sync, empty.calidad) == ("{}", "{}")
    now = dt.datetime.now(dt.timezone.utc)
    PB.append_run(spark, root, {"id": "x", "estado": "running", "created_at": now, "started_at": now})
    PB.write_state(spark, root, {"ultimo_estado": "running"})
    got = dash_quality(PB.read_runs(spark, root), PB.read_state_frame(spark, root)).first()
    assert len(json.loads(got.sync)) == 7 and len(json.loads(got.calidad)) == 12
    assert json.loads(got.calidad)["mensaje"] is None


def _written(monkeypatch):
    """Paths of the tables written while it is in force."""
    from pyspark.sql.readwriter import DataFrameWriter
    paths, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (paths.append(path), parquet(self, path, *a, **k))[1])
    return paths


def test_an_unchanged_sheet_is_neither_copied_nor_read(spark, root, tmp_path, monkeypatch):
    """Ten files: one rewritten with the same rows is read alone; nothing is copied; a changed one gives a new load."""
    import os
    import shutil
    from ordergate.plans import digest
    folder = str(tmp_path / "hoja de pedidos" / "Pedidos")
    dirty_orders(spark, SF).drop("fila_origen").repartition(10, "producto").write.parquet(folder)
    src = [Source("source", str(tmp_path / "hoja de pedidos"))]
    first = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert first.estado == "ok"
    raw = spark.read.parquet(folder)
    assert first.huella == fingerprint(raw).first().huella              # of a full pass
    read = []
    digests = digest.file_digests
    monkeypatch.setattr(digest, "file_digests", lambda df, paths=None: (read.append(paths), digests(df, paths))[1])
    written = _written(monkeypatch)
    same = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert same.estado == "unchanged" and same.huella == first.huella and read == []
    assert not any("/cache/" in p or "/raw/" in p or "/clean/" in p for p in written)
    one = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))[3]
    os.utime(f"{folder}/{one}", (1, 1))
    touched = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert touched.estado == "unchanged" and len(read) == 1 and len(read[0]) == 1 and read[0][0].endswith(one)
    assert not any("/cache/" in p for p in written)
    again = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)   # the touched file is known by now
    assert again.estado == "unchanged" and len(read) == 1
    spark.read.parquet(f"{folder}/{one}").limit(7).coalesce(1).write.parquet(str(tmp_path / "less"))
    part = next(f for f in os.listdir(tmp_path / "less") if f.endswith(".parquet"))
    for crc in (f"{folder}/.{one}.crc",):
        os.path.exists(crc) and os.remove(crc)
    shutil.copy(tmp_path / "less" / part, f"{folder}/{one}")
    spark.catalog.refreshByPath(folder)
    changed = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert changed.estado == "ok" and changed.huella != first.huella
    assert changed.huella == fingerprint(spark.read.parquet(folder)).first().huella
    assert len(read) == 2 and len(read[1]) == 1


def test_files_merge_to_the_whole(spark, tmp_path):
    """Digests of files with their own positions and of files without, empty ones included."""
    from ordergate.plans import digest
    from ordergate.sources.sheet import Fetched, read_orders
    for n, df in enumerate((dirty_orders(spark, SF), dirty_orders(spark, SF).drop("fila_origen"), dirty_orders(spark, SF).limit(0))):
        path = str(tmp_path / f"s{n}" / "Pedidos")
        df.repartition(7, "zona").sortWithinPartitions("importe").write.parquet(path)
        df.limit(0).coalesce(1).write.mode("append").parquet(path)
        sheet = read_orders(spark, str(tmp_path / f"s{n}"))
        huella, files = digest.from_files(spark, Fetched(sheet, "source", None, str(tmp_path / f"s{n}")), None, None)
        assert huella == fingerprint(sheet).first().huella
        assert files.agg(F.sum("n")).first()[0] == df.count()


def test_csv_unchanged_and_changed(spark, root, tmp_path):
    path = tmp_path / "csv" / "Pedidos"
    dirty_orders(spark, SF).drop("fila_origen").coalesce(3).write.option("header", "true").csv(str(path))
    src = [Source("source", str(path), "csv")]
    first = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert refresh(spark, src, root, TESTDATA_TODAY, quarantine=True).estado == "unchanged"
    part = sorted(path.glob("*.csv"))[0]
    text = part.read_text()
    part.write_text(text[:text.rindex("\n", 0, -1) + 1])      # a row less
    (path / f".{part.name}.crc").unlink()
    less = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert less.estado == "ok" and less.delta["filas_crudas"] == -1 and less.huella != first.huella


def test_figures_of_a_write_equal_those_of_a_scan(spark, sheet, root, monkeypatch):
    """Constraint counts, totals and rows set aside, as the checks count them on the written tables; a broken row is
    written once, to the quarantine."""
    from ordergate.operators import checks
    from ordergate.operators.gate import run_gate
    from ordergate.plans import refresh as RF
    raw = dirty_orders(spark, SF)
    written = _written(monkeypatch)
    gate = run_gate(raw, TESTDATA_TODAY, materialize=True)
    typed = PB.clean_typed(gate.clean, "x")
    found, aside, paths = RF.stage_observed(spark, raw, typed, root, "x", True)
    want = checks.constraint_counts(typed, spark.read.parquet(paths["raw"])).first().asDict()
    assert {k: found[k] for k in (*checks.CONSTRAINTS, "filas_crudas", "crudo_fila_repetida")} == {
        k: want[k] for k in (*checks.CONSTRAINTS, "filas_crudas", "crudo_fila_repetida")}
    broken = typed.withColumn("r", RF.broken_constraint()).where("r IS NOT NULL").groupBy("r").count().collect()
    assert aside == {r["r"]: r["count"] for r in broken} and sum(aside.values()) > 0
    assert found["filas_limpias"] == typed.count() - sum(aside.values()) == spark.read.parquet(paths["clean"]).count()
    assert spark.read.parquet(f"{root}/quarantine/sync_id=x").groupBy("restriccion").count().count() == len(aside)
    assert sum("/clean/" in p for p in written) == 1
    gate.release()


def test_files_read_by_a_refused_or_a_fallback_run_are_known(spark, sheet, root, monkeypatch):
    """A run that is refused has read the files; the next ones from the same source need not, also after a run from the cache."""
    from ordergate.plans import digest
    read, digests = [], digest.file_digests
    monkeypatch.setattr(digest, "file_digests", lambda df, paths=None: (read.append(df.inputFiles()), digests(df, paths))[1])
    src = [Source("source", sheet), Source("cache", f"{root}/cache")]
    with pytest.raises(PB.PublishError):
        refresh(spark, src, root, TESTDATA_TODAY)
    assert len(read) == 1
    first = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    assert first.estado == "ok" and first.huella == fingerprint(spark.read.parquet(f"{sheet}/Pedidos")).first().huella
    assert refresh(spark, src, root, TESTDATA_TODAY, quarantine=True).estado == "unchanged" and len(read) == 1
    lost = [Source("source", f"{root}/nothing"), src[1]]
    assert refresh(spark, lost, root, TESTDATA_TODAY, quarantine=True).estado == "unchanged" and len(read) == 2
    forced = refresh(spark, src, root, TESTDATA_TODAY, forzar=True, quarantine=True)
    assert forced.estado == "ok" and forced.huella == first.huella and len(read) == 2
    assert refresh(spark, lost, root, TESTDATA_TODAY, quarantine=True).estado == "unchanged"   # the cache is a new copy by now
    assert len(read) == 3


def test_a_changed_file_after_a_refused_run_is_seen(spark, root, tmp_path):
    src = [Source("source", str(tmp_path / "hoja"))]
    rows = dirty_orders(spark, SF).drop("fila_origen")
    rows.write.parquet(str(tmp_path / "hoja" / "Pedidos"))
    with pytest.raises(PB.PublishError):
        refresh(spark, src, root, TESTDATA_TODAY)
    rows.limit(500).write.mode("append").parquet(str(tmp_path / "hoja" / "Pedidos"))
    spark.catalog.refreshByPath(str(tmp_path / "hoja" / "Pedidos"))
    second = refresh(spark, src, root, TESTDATA_TODAY, quarantine=True)
    raw = spark.read.parquet(str(tmp_path / "hoja" / "Pedidos"))
    assert second.huella == fingerprint(raw).first().huella and second.pointer["filas"]["raw"] == raw.count()


def test_supplied_positions_are_looked_at_once(spark, sheet, root, tmp_path, monkeypatch):
    """Positions that the gate found unique are not grouped again; repeated ones are still counted and refused."""
    from ordergate.operators import checks
    grouped, rows = [], checks._duplicate_rows
    monkeypatch.setattr(checks, "_duplicate_rows", lambda df, keys: (grouped.append(keys), rows(df, keys))[1])
    assert refresh(spark, [Source("source", sheet)], root, TESTDATA_TODAY, quarantine=True).estado == "ok" and not grouped
    raw = spark.read.parquet(f"{sheet}/Pedidos")
    raw.unionByName(raw.orderBy(S.ROW_POSITION).limit(3)).write.parquet(str(tmp_path / "twice" / "Pedidos"))
    for quarantine in (False, True):
        with pytest.raises(PB.PublishError, match="'crudo_fila_repetida': 3"):
            refresh(spark, [Source("source", str(tmp_path / "twice"))], str(tmp_path / "pub"), TESTDATA_TODAY, quarantine=quarantine)
    assert grouped


def test_published_files_are_sorted(spark, sheet, root):
    """Inside each published file dates go up, also where rows were set aside."""
    run = refresh(spark, [Source("source", sheet)], root, TESTDATA_TODAY, quarantine=True)
    assert run.pointer["filas"]["cuarentena"] > 0
    rows = PB.load_current(spark, root).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), "fecha", "pedido_id")
    before = F.lag(F.struct("fecha", "pedido_id")).over(Window.partitionBy("f").orderBy("i"))
    assert rows.withColumn("p", before).where("p > struct(fecha, pedido_id)").count() == 0


def test_side_by_side_steps(spark):
    """Results in order; an error is raised only when every step has ended."""
    import time
    from ordergate.plans.storage import at_once
    assert at_once(spark, lambda: spark.range(5).count(), lambda: "x") == [5, "x"]
    ended = []

    def slow():
        time.sleep(1)
        ended.append(1)

    def broken():
        raise ValueError("no")
    with pytest.raises(ValueError):
        at_once(spark, broken, slow)
    assert ended == [1]
