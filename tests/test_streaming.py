"""Refresh on arrival: each landed export is handled once, a repeat is skipped."""

import tempfile

from ordergate.plans import publish as PB
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders
from ordergate.streaming.snapshots import refresh_on_arrival


def test_refresh_on_arrival(spark):
    base = tempfile.mkdtemp(prefix="og-stream-")
    landing, root, ckpt = f"{base}/landing", f"{base}/pub", f"{base}/ckpt"
    sheet = dirty_orders(spark, "/root/testdata/sf0.001")
    sheet.repartition(6).write.option("header", "true").csv(f"{landing}/export-1")
    n = sheet.count()
    _, runs = refresh_on_arrival(spark, landing, root, TESTDATA_TODAY, checkpoint=ckpt, quarantine=True)
    assert [r.estado for r in runs] == ["ok"]
    assert runs[0].resumen["filas_crudas"] == n          # all six files of the export
    # nothing new: the stream's checkpoint remembers the file
    _, runs = refresh_on_arrival(spark, landing, root, TESTDATA_TODAY, checkpoint=ckpt, quarantine=True)
    assert runs == []
    # a second export with the same content: processed, then skipped as unchanged
    sheet.coalesce(1).write.option("header", "true").csv(f"{landing}/export-2")
    _, runs = refresh_on_arrival(spark, landing, root, TESTDATA_TODAY, checkpoint=ckpt, quarantine=True)
    assert [r.estado for r in runs] == ["unchanged"]
    assert PB.current_pointer(spark, root)["seq"] == 1


def test_incomplete_export_waits(spark, tmp_path):
    import os
    import pytest
    landing = tmp_path / "landing"
    sheet = dirty_orders(spark, "/root/testdata/sf0.001")
    sheet.coalesce(2).write.option("header", "true").csv(str(landing / "export-1"))
    os.remove(landing / "export-1" / "_SUCCESS")
    args = (spark, str(landing), str(tmp_path / "pub"), TESTDATA_TODAY)
    kw = dict(checkpoint=str(tmp_path / "ckpt"), quarantine=True)
    with pytest.raises(Exception, match="no complete export"):
        refresh_on_arrival(*args, **kw)
    assert PB.current_pointer(spark, str(tmp_path / "pub")) is None
    (landing / "export-1" / "_SUCCESS").touch()
    _, runs = refresh_on_arrival(*args, **kw)
    assert [r.estado for r in runs] == ["ok"]
