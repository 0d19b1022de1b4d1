"""Command line: ``python -m ordergate refresh|diagnose ...``.

refresh   fetch (with fallbacks), skip if unchanged, gate, check, publish;
          prints the outcome, the raw vs clean summary and the incident report.
diagnose  the verdict of every row of a sheet, without storing anything:
          counts per verdict, one order's verdict, or the newest rows.

Only small results are printed (at most 15 rows); all work runs on Spark.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F

from ordergate import schema as S


def _session():
    from pyspark.sql import SparkSession

    from ordergate.session import SESSION_DEFAULTS, ensure_checkpoint_dir
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("ordergate")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def cmd_refresh(args, out=sys.stdout) -> int:
    from ordergate.plans.refresh import refresh
    from ordergate.sources.sheet import Source
    spark = _session()
    sources = [Source("source", args.source, args.fmt)]
    if args.cache:
        sources.append(Source("cache", args.cache, "parquet"))
    run = refresh(spark, sources, args.root, args.hoy, forzar=args.force, origen=args.origen,
                  quarantine=args.quarantine)
    print(f"Source : {run.origen}", file=out)
    if run.aviso:
        print(f"WARNING: {run.aviso}", file=out)
    print(f"Result : {run.estado} ({run.resultado})", file=out)
    if run.resumen:
        r = run.resumen
        print(f"{r['filas_crudas']:,} raw rows -> {r['filas_limpias']:,} counted "
              f"({r['filas_publicadas']:,} published)", file=out)
        print(f"Raw turnover  : {r['fact_crudo']:>15,}", file=out)
        print(f"Clean turnover: {r['fact_limpio']:>15,}", file=out)
    for line in run.incidencias:
        print(f"  {line['regla']:<45} {line['filas']:>8}  {line['accion']}", file=out)
    return 0


def cmd_diagnose(args, out=sys.stdout) -> int:
    from ordergate.operators.gate import verdicts
    from ordergate.operators.report import verdict_lookup, verdict_newest, verdict_summary
    from ordergate.sources.sheet import read_orders
    spark = _session()
    v = verdicts(read_orders(spark, args.source, args.fmt), args.hoy)
    print(f"Cut-off day: {args.hoy}", file=out)
    for row in verdict_summary(v).orderBy(F.desc("filas")).collect():
        print(f"  {row['filas']:>10,}  {row['veredicto']}", file=out)
    expected = F.bround(F.col("cantidad") * F.col("precio_unitario"), 2)
    v = v.withColumns({"esperado": F.when(F.col("veredicto") == S.VERDICT_MISMATCH, expected)})
    if args.pedido:
        rows = verdict_lookup(v, args.pedido).orderBy(S.ROW_POSITION)
    else:
        rows = verdict_newest(v, 15, discarded_only=args.discarded).orderBy("posicion")
    found = 0
    for r in rows.toLocalIterator():       # every row of the order, however many
        found += 1
        day = r["fecha"].date().isoformat() if r["fecha"] else "(empty)"
        mark = "+" if r["veredicto"] == S.VERDICT_PASS else "x"
        print(f"\n  {mark} {r['pedido_id']}  {day}  {r['cliente']}", file=out)
        print(f"      {r['producto']}  {r['cantidad']} x {r['precio_unitario']} = {r['importe']}", file=out)
        print(f"      -> {r['veredicto']}", file=out)
        if r["esperado"] is not None:
            print(f"      quantity x price = {r['esperado']}, the sheet says {r['importe']} "
                  f"(difference {round(r['importe'] - r['esperado'], 2)})", file=out)
    if args.pedido and not found:
        print(f"\nOrder {args.pedido!r} is not in the sheet.", file=out)
        return 1
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m ordergate")
    sub = p.add_subparsers(dest="command", required=True)
    today = dt.date.today().isoformat()

    r = sub.add_parser("refresh", help="gate and publish the latest sheet")
    r.add_argument("--source", required=True, help="sheet export (folder of tabs or files)")
    r.add_argument("--fmt", default="parquet", choices=("parquet", "csv", "json"))
    r.add_argument("--cache", help="last good copy, used when the source cannot be read")
    r.add_argument("--root", required=True, help="shared folder of the published tables")
    r.add_argument("--hoy", default=today, help="cut-off day (default: today)")
    r.add_argument("--force", action="store_true", help="reprocess even if unchanged")
    r.add_argument("--quarantine", action="store_true",
                   help="set rows breaking a constraint aside instead of refusing the publish")
    r.add_argument("--origen", default="manual", help="what started the run")
    r.set_defaults(func=cmd_refresh)

    d = sub.add_parser("diagnose", help="verdict of every row, nothing stored")
    d.add_argument("--source", required=True)
    d.add_argument("--fmt", default="parquet", choices=("parquet", "csv", "json"))
    d.add_argument("--hoy", default=today)
    d.add_argument("pedido", nargs="?", help="one order id (case-insensitive)")
    d.add_argument("--discarded", action="store_true", help="newest discarded rows only")
    d.set_defaults(func=cmd_diagnose)
    return p


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    return args.func(args)


if __name__ == "__main__":
    raise SystemExit(main())
