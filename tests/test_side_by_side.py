"""What a load runs side by side, and which columns it shuffles."""

import threading

from pyspark.sql import functions as F

from ordergate.operators import gate as G
from ordergate.plans import catalog, publish as PB, refresh as RF
from ordergate.sources.sheet import Source
from tests.fixtures import frame, gate_rows

HOY = "2025-06-30"


def _sheet(spark, tmp_path):
    frame(spark, gate_rows()).write.parquet(str(tmp_path / "hoja" / "Pedidos"))
    return [Source("source", str(tmp_path / "hoja"))]


def test_landing_does_not_wait_for_the_gate(spark, tmp_path, monkeypatch):
    """A run with a quarantine lands the raw rows while the gate's small jobs run."""
    landing, seen = threading.Event(), []
    land, gate = PB.land, RF.run_gate
    monkeypatch.setattr(PB, "land", lambda *a: (landing.set(), land(*a)))
    monkeypatch.setattr(RF, "run_gate", lambda *a, **k: (seen.append(landing.wait(60)), gate(*a, **k))[1])
    run = RF.refresh(spark, _sheet(spark, tmp_path), str(tmp_path / "pub"), HOY, quarantine=True)
    assert seen == [True] and run.estado == "ok"
    assert PB.load_current(spark, str(tmp_path / "pub"), "raw").count() == 4


def test_a_failed_gate_leaves_no_landing(spark, tmp_path, monkeypatch):
    """What was landed beside a gate that fails goes with it."""
    def broken(*a, **k):
        raise RuntimeError("gate")
    monkeypatch.setattr(RF, "run_gate", broken)
    try:
        RF.refresh(spark, _sheet(spark, tmp_path), str(tmp_path / "pub"), HOY, quarantine=True)
    except RuntimeError as exc:
        assert str(exc) == "gate"
    assert list((tmp_path / "pub" / "raw").iterdir()) == []


def test_published_columns_are_made_after_the_exchange(spark, tmp_path, monkeypatch):
    """The exchange by date carries the clean rows as they are; constants, decimals and checks come after it."""
    placed, place = [], PB.placed_for_storage
    monkeypatch.setattr(PB, "placed_for_storage", lambda df, keys, *a: (placed.append(df.dtypes), place(df, keys, *a))[1])
    raw = frame(spark, gate_rows())
    gate = G.run_gate(raw, HOY, materialize=True)
    found, aside, paths = RF.stage_observed(spark, raw, gate.clean, str(tmp_path / "pub"), "x", True, lambda df: PB.clean_typed(df, "x"))
    assert placed == [gate.clean.dtypes] and not {"sync_id", "restriccion"} & {c for c, _ in placed[0]}
    rows = spark.read.parquet(paths["clean"])
    assert {"created_at", "updated_at", "sync_id"} < set(rows.columns) and dict(rows.dtypes)["importe"].startswith("decimal")
    assert found["filas_crudas"] == 4 and found["filas_limpias"] == rows.count() == 3 and not aside
    assert rows.where(F.col("sync_id") == "x").count() == 3
    gate.release()


def test_the_conservation_check_gates_beside_the_history(spark, tmp_path, monkeypatch):
    """the history and the gate run side by side; the answer is that of one after the other."""
    both = threading.Barrier(2, timeout=60)
    sf = "/root/testdata/sf0.001"
    history, verdicts = catalog.history_of, catalog._verdicts
    monkeypatch.setattr(catalog, "history_of", lambda *a: (both.wait(), history(*a))[1])
    monkeypatch.setattr(catalog, "_verdicts", lambda *a: (both.wait(), verdicts(*a))[1])
    row = catalog.REGISTRY["publish_conservation"](spark, sf).first()
    assert row["cuadra"] and row["crudas"] == 6000
