"""

Setup (not timed): the dirty order sheet is derived from the testdata tables
and written once as Parquet, like an exported sheet. Then each workload runs
one warm-up and ``BENCH_REPS`` timed repetitions; the median is reported.

Prints one JSON line:
  {"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from ordergate.operators import dashboard as D, explorer as E, metrics as M, report as R  # noqa: E402
from ordergate.operators.gate import run_gate, verdicts  # noqa: E402
from ordergate.plans import publish as PB  # noqa: E402
from ordergate.plans.refresh import fingerprint, refresh  # noqa: E402
from ordergate.session import local_session  # noqa: E402
from ordergate.sources.sheet import Source, read_orders  # noqa: E402
from ordergate.sources.tables import load_clean, save_clean  # noqa: E402
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders  # noqa: E402
from ordergate.operators import checks  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, memory="16g")
    scratch = tempfile.mkdtemp(prefix="ordergate-bench-")
    sheet = f"{scratch}/sheet"
    # An exported sheet in position-ordered parts (one file per part).
    (dirty_orders(spark, sf_dir).repartitionByRange(int(cpus) * 2, "fila_origen")
        .sortWithinPartitions("fila_origen").write.parquet(sheet))
    raw = read_orders(spark, sheet)

    # B1 writes a new clean table each run; the read workloads use the first.
    clean_path = f"{scratch}/clean-0"
    save_clean(run_gate(raw, TESTDATA_TODAY, eager_counts=False, materialize=True).clean, clean_path)
    clean = load_clean(spark, clean_path)

    def b1():
        res = run_gate(read_orders(spark, sheet), TESTDATA_TODAY, materialize=True, eager_counts=False)
        save_clean(res.clean, f"{scratch}/clean-{uuid.uuid4().hex}")
        R.incidents(res).collect()
        res.release()

    def b2():
        R.verdict_summary(verdicts(read_orders(spark, sheet), TESTDATA_TODAY)).collect()

    def b3():
        out = M.payload(clean, TESTDATA_TODAY)
        for df in out.values():
            df.collect()

    deep = clean.count() // 2
    # The same sheet without supplied positions, in the same parts.
    bare = f"{scratch}/bare"
    spark.read.parquet(sheet).drop("fila_origen").write.parquet(bare)

    filters = D.Filters(comercial="Supplier#000000003", zona="NATION_11",
                        familia="SMALL", tipo_cliente="BUILDING")

    def b4():
        parts = D.dash_summary(clean, filters)
        for key in ("kpis", "mes", "rankings"):
            parts[key].collect()
        D.dash_filter_values(clean).collect()

    def b5():
        q = E.Query(q="customer#00000012")
        E.totals(E.filtered(clean, q)).collect()
        E.page(clean, q).collect()
        E.page(clean, E.Query(limite=200, offset=0)).collect()
        E.page(clean, E.Query(limite=25, offset=5000)).collect()
        E.page(clean, E.Query(limite=25, offset=deep)).collect()

    def b6():
        fingerprint(read_orders(spark, sheet)).collect()

    def b7():
        sync = uuid.uuid4().hex
        root = f"{scratch}/pub"
        paths = PB.stage(PB.raw_landing(raw, sync), PB.clean_typed(clean, sync), root, sync)
        row = checks.constraint_counts(spark.read.parquet(paths["clean"]),
                                       spark.read.parquet(paths["raw"])).first()
        counts = PB.guards(spark, paths, {"raw": row["filas_crudas"], "clean": row["filas_limpias"]})
        PB.publish_pointer(spark, root, sync, paths, counts)

    def b8():
        run = refresh(spark, [Source("source", bare)], f"{scratch}/refresh", TESTDATA_TODAY, forzar=True, quarantine=True)
        assert run.estado == "ok"

    work = {"B1_gate_write": b1, "B2_verdict_summary": b2, "B3_payload": b3,
            "B4_dashboard_filters": b4, "B5_explorer": b5, "B6_fingerprint": b6,
            "B7_stage_check_swap": b7, "B8_refresh_no_positions": b8}
    only = [w for w in os.environ.get("BENCH_ONLY", "").split(",") if w]
    results = {}
    for name, fn in work.items():
        if only and name not in only:
            continue
        fn()                                   # warm-up
        times = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
        print(f"# {name}: {results[name]}s {[round(t, 2) for t in times]}", file=sys.stderr)

    print(json.dumps({"metric": "total_median_sec", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
