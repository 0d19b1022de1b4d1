"""Property test: Spark verdicts vs a row-by-row brute force of the rules."""

import datetime as dt
import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ordergate import schema as S
from ordergate.functions.dates import DATE_TEXT_PATTERN
from ordergate.operators.gate import verdicts
from tests.fixtures import frame

HOY = dt.date(2025, 6, 30)

dates = st.sampled_from(["2025-06-29", "2025-06-30", "2025-06-30 23:59:59", "2025-07-01", "2024-02-29",
                         "2025-02-30", "mañana", "", None, "2025-06-30T10:30", "1/2/2025"])
amounts = st.sampled_from([112.0, 112.02, 112.03, 111.97, 0.0, -22.4, None, math.nan])
rows = st.lists(st.fixed_dictionaries({
    "pedido_id": st.sampled_from(["P1", "P2", "P3", "p1", None]),
    "fecha": dates,
    "cliente": st.sampled_from(["Ferretería López", " FERRETERIA LOPEZ", None]),
    "cantidad": st.sampled_from([10.0, 0.0, -2.0, None]),
    "precio_unitario": st.sampled_from([11.2, 0.0]),
    "importe": amounts,
}), min_size=1, max_size=12)


def brute_force(rs):
    seen, out = set(), []
    for r in rs:
        key = r["pedido_id"]
        text = (r["fecha"] or "").strip()
        when = None
        if re.match(DATE_TEXT_PATTERN, text):
            try:
                when = dt.datetime.fromisoformat(text)
            except ValueError:
                when = None
        num = {k: (None if r[k] is None or (isinstance(r[k], float) and math.isnan(r[k])) else r[k])
               for k in ("cantidad", "precio_unitario", "importe")}
        if key in seen:
            v = S.VERDICT_DUPLICATE
        elif when is None:
            v = S.VERDICT_BAD_DATE
        elif when.date() > HOY:
            v = S.VERDICT_FUTURE.format(hoy=HOY.isoformat())
        elif None not in num.values() and abs(num["importe"] - num["cantidad"] * num["precio_unitario"]) > 0.02:
            v = S.VERDICT_MISMATCH
        elif num["importe"] == 0:
            v = S.VERDICT_ZERO
        else:
            v = S.VERDICT_PASS
        seen.add(key)
        out.append(v)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows)
def test_verdicts_match_brute_force(spark, rs):
    full = [dict(r, comercial="X", zona="Z", tipo_cliente="T", producto="P", familia="F") for r in rs]
    got = [r.veredicto for r in verdicts(frame(spark, full), HOY).orderBy("fila_origen").collect()]
    assert got == brute_force(full)
