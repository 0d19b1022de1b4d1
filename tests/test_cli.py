"""The command line on the small test data."""

import io

from ordergate.__main__ import parser
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders


def test_diagnose_and_refresh(spark, tmp_path):
    sheet = str(tmp_path / "sheet")
    dirty_orders(spark, "/root/testdata/sf0.001").write.parquet(sheet)
    out = io.StringIO()
    args = parser().parse_args(["diagnose", "--source", sheet, "--hoy", TESTDATA_TODAY, "--discarded"])
    assert args.func(args, out) == 0
    text = out.getvalue()
    assert "1,407  DESCARTADA · pedido_id repetido" in text and text.count("-> DESCARTADA") == 15
    out = io.StringIO()
    args = parser().parse_args(["diagnose", "--source", sheet, "--hoy", TESTDATA_TODAY, "NO-SUCH-ID"])
    assert args.func(args, out) == 1 and "not in the sheet" in out.getvalue()
    out = io.StringIO()
    args = parser().parse_args(["refresh", "--source", sheet, "--root", str(tmp_path / "pub"),
                                "--hoy", TESTDATA_TODAY, "--quarantine"])
    assert args.func(args, out) == 0
    assert "Result : ok (primera_carga)" in out.getvalue() and "Pedidos duplicados" in out.getvalue()
