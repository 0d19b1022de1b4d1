"""Execute the headline plans and summarise their final (AQE) physical plans.

    python tools/show_plans.py [sf_dir] > PLANS.md

For each plan: the exchanges (shuffles / broadcasts), join strategies, pushed
filters and read schemas of the scans, window-group limits and top-k nodes.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ordergate.operators import dashboard as D, explorer as E, metrics as M, report as R  # noqa: E402
from ordergate.operators.gate import prepare, verdict_table, run_gate  # noqa: E402
from ordergate.session import local_session  # noqa: E402
from ordergate.sources.sheet import read_orders  # noqa: E402
from ordergate.sources.tables import load_clean, save_clean  # noqa: E402
from ordergate.sources.testdata import TESTDATA_TODAY, dirty_orders  # noqa: E402

NODES = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "WindowGroupLimit", "TakeOrderedAndProject", "Expand", "ArrowEvalPython", "Window ")


def summary(df) -> list[str]:
    qe = df._jdf.queryExecution()
    qe.toRdd().count()                        # run this plan, so AQE finalises it
    plan = qe.executedPlan().toString()
    if "== Initial Plan ==" in plan:                 # keep AQE's final plan only
        plan = plan.split("== Initial Plan ==")[0]
    out = []
    shuffles = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)"
                          r"(\([^)]*\))?", plan)
    out.append(f"- exchanges: {len(shuffles)} shuffle(s) "
               f"[{', '.join(k + (a[:60] if a else '') for k, a in shuffles)}], "
               f"{plan.count('BroadcastExchange')} broadcast(s)")
    for node in NODES:
        n = len(re.findall(re.escape(node) + r"(\(|\s|\[)", plan))
        if n:
            extra = " (skew split)" if node == "SortMergeJoin" and "skew=true" in plan else ""
            out.append(f"- {node.strip()}: {n}{extra}")
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan):
        cols, filt = m.group(1), m.group(2)
        cols = ", ".join(c.split("#")[0] for c in cols.split(","))
        out.append(f"- scan columns: {cols}")
        if filt:
            out.append(f"  - pushed filters: {filt[:240]}")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(cores=8, shuffle_partitions=16)
    scratch = tempfile.mkdtemp(prefix="ordergate-plans-")
    dirty_orders(spark, sf).repartitionByRange(16, "fila_origen").write.parquet(f"{scratch}/sheet")
    raw = read_orders(spark, f"{scratch}/sheet")
    res = run_gate(raw, TESTDATA_TODAY, materialize=True, eager_counts=False)
    save_clean(res.clean, f"{scratch}/clean")
    clean = load_clean(spark, f"{scratch}/clean")
    f4 = D.Filters(comercial="Supplier#000000003", tipo_cliente="BUILDING")
    plans = {
        "verdict table (raw sheet -> typed -> duplicate join -> rule chain)":
            verdict_table(prepare(raw), TESTDATA_TODAY),
        "clean table (materialised verdicts -> name map join -> marks)": res.clean,
        "incident report": R.incidents(res),
        "KPIs, default window (clean table)": M.kpis(clean),
        "six rankings in one pass": M.top_all(clean),
        "monthly series": M.monthly_series(clean),
        "dashboard rankings with two filters": D.dash_rankings(clean, f4),
        "explorer: search + first page": E.page(clean, E.Query(q="customer#00000012")),
        "explorer: date range page": E.page(clean, E.Query(desde="2000-01-01", hasta="2000-03-31")),
    }
    print(f"# PLANS\n\nFinal physical plans (after AQE) of the headline queries, from "
          f"`tools/show_plans.py` on `{sf}` with `local[8]`, 16 shuffle partitions. "
          f"The clean table read by the analytics is the range-sorted Parquet the gate writes.\n")
    for title, df in plans.items():
        print(f"## {title}\n")
        print("\n".join(summary(df)))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
