"""The SQL-dashboard functions (D1-D10) as DataFrame builders.

Differences from the per-row metrics, kept on purpose: everything is scoped to
the window, amounts round half away from zero, a NULL zone is labelled, dates
are days. ``actual`` is read once: one bounds aggregate, one wide aggregate
for KPIs, one long-form aggregate for the six rankings.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import as_date, money_sum, whole_up
from ordergate.operators import explorer as E
from ordergate.operators.metrics import (Window_, day_at_least, day_at_most, kpi_frame,
                                         metric_base, minus_months)


@dataclass(frozen=True)
class Filters:
    comercial: str | None = None
    zona: str | None = None
    familia: str | None = None
    tipo_cliente: str | None = None
    desde: object = None
    hasta: object = None


def dash_filtered(clean: DataFrame, f: Filters) -> DataFrame:
    """Non-flagged rows, with only the category filters that were set."""
    d = metric_base(clean)
    for col in ("comercial", "zona", "familia", "tipo_cliente"):
        val = getattr(f, col)
        if val:
            d = d.where(F.col(col) == F.lit(val))
    return d


def dash_bounds_frame(base: DataFrame, f: Filters) -> DataFrame:
    """D2 as a one-row frame: first/last day, and the window."""
    return base.agg(F.to_date(F.min("fecha")).alias("fecha_minima"),
                    F.to_date(F.max("fecha")).alias("fecha_maxima"))


def dash_window(base: DataFrame, f: Filters) -> tuple[Window_, dt.date | None, dt.date | None]:
    row = dash_bounds_frame(base, f).first()
    hasta = as_date(f.hasta) or row["fecha_maxima"]
    desde = as_date(f.desde)
    if desde is None and hasta is not None:
        desde = minus_months(hasta, 12)
    return Window_(desde, hasta), row["fecha_minima"], row["fecha_maxima"]


def dash_bounds(clean: DataFrame, f: Filters) -> DataFrame:
    """first/last day of the filtered base and the window (one row)."""
    b = dash_bounds_frame(dash_filtered(clean, f), f)
    hasta = F.coalesce(F.lit(as_date(f.hasta)).cast("date"), F.col("fecha_maxima"))
    desde = F.coalesce(F.lit(as_date(f.desde)).cast("date"), F.add_months(hasta, -12))
    return b.select("fecha_minima", "fecha_maxima", desde.alias("desde"), hasta.alias("hasta"))


def actual(base: DataFrame, win: Window_) -> DataFrame:
    """Rows of the current window (empty when there are no bounds)."""
    if win.hasta is None:
        return base.where(F.lit(False))
    return base.where(day_at_least(win.desde) & day_at_most(win.hasta))


def dash_windows(clean: DataFrame, f: Filters) -> DataFrame:
    """D3: sizes of the current and previous sets, from one pass."""
    base = dash_filtered(clean, f)
    win, _, _ = dash_window(base, f)
    k = kpi_frame(base, win)
    return k.select(F.col("pedidos").alias("filas_actual"),
                    F.col("facturacion").cast("double").alias("importe_actual"),
                    F.col("pedidos_anterior").alias("filas_anterior"),
                    F.col("facturacion_anterior").cast("double").alias("importe_anterior"),
                    "desde", "hasta")


def dash_kpis(clean: DataFrame, f: Filters, win: Window_ | None = None) -> DataFrame:
    """KPI row with numeric half-up rounding; null variation when the
    previous window sums to 0; returns % is 0 when gross is 0."""
    base = dash_filtered(clean, f)
    return kpi_row(kpi_frame(base, win or dash_window(base, f)[0]))


def kpi_row(k: DataFrame) -> DataFrame:
    """D4's figures of a ``kpi_frame``."""
    fact, prev = F.col("facturacion").cast("double"), F.col("facturacion_anterior").cast("double")
    bru, dev = F.col("bruta").cast("double"), F.col("devoluciones").cast("double")
    return k.select(
        whole_up(F.col("facturacion")).alias("facturacion"),
        F.when(prev != 0, F.round((fact / prev - 1) * 100, 1)).alias("var_pct"),
        F.col("pedidos"),
        F.coalesce(whole_up(F.try_divide(F.col("bruta"), F.col("n_ventas"))), F.lit(0).cast("bigint")).alias("ticket"),
        F.col("clientes"),
        whole_up(F.col("devoluciones")).alias("devoluciones"),
        F.when(bru == 0, F.lit(0.0)).otherwise(F.round(dev / bru * 100, 1)).alias("dev_pct"),
        "desde", "hasta")


def dash_monthly(clean: DataFrame, f: Filters, win: Window_ | None = None) -> DataFrame:
    """Months of the window: rounded amount and row count."""
    base = dash_filtered(clean, f)
    win = win or dash_window(base, f)[0]
    return (actual(base, win).groupBy(F.date_format("fecha", "yyyy-MM").alias("mes"))
            .agg(whole_up(money_sum(F.col("importe"))).alias("facturacion"),
                 F.count(F.lit(1)).alias("pedidos")))


def dash_rankings(clean: DataFrame, f: Filters, win: Window_ | None = None) -> DataFrame:
    """The six rankings of the window in one aggregate:
    ``(dimension, nombre, importe, posicion)``; NULL zone labelled."""
    base = dash_filtered(clean, f)
    win = win or dash_window(base, f)[0]
    cur = actual(base, win).withColumn("zona", F.coalesce(F.col("zona"), F.lit(S.BLANK_LABEL)))
    dims = ", ".join(f"'{name}', {col}" for name, col, _ in S.RANKINGS)
    long = cur.select(F.expr(f"stack({len(S.RANKINGS)}, {dims}) as (dimension, nombre)"), "importe")
    sums = long.groupBy("dimension", "nombre").agg(money_sum(F.col("importe")).alias("_s"))
    w = Window.partitionBy("dimension").orderBy(F.desc("_s"), F.asc_nulls_last("nombre"))
    size = F.lit(8)
    for name, _, n in S.RANKINGS:
        size = F.when(F.col("dimension") == name, F.lit(n)).otherwise(size)
    max_n = max(n for _, _, n in S.RANKINGS)
    return (sums.withColumn("posicion", F.row_number().over(w))
                .where(F.col("posicion") <= max_n)
                .where(F.col("posicion") <= size)
                .select("dimension", "nombre", whole_up(F.col("_s")).alias("importe"), "posicion"))


def dash_top(clean: DataFrame, f: Filters, dimension: str) -> DataFrame:
    """D6 for one dimension: only its column is read and aggregated."""
    base = dash_filtered(clean, f)
    win = dash_window(base, f)[0]
    column, size = S.RANKING_COLUMN[dimension], S.RANKING_SIZE[dimension]
    name = F.coalesce(F.col(column), F.lit(S.BLANK_LABEL)) if column == "zona" else F.col(column)
    sums = actual(base, win).groupBy(name.alias("nombre")).agg(money_sum(F.col("importe")).alias("_s"))
    order = [F.desc("_s"), F.asc_nulls_last("nombre")]
    return (sums.orderBy(*order).limit(size).withColumn("posicion", F.row_number().over(Window.orderBy(*order)))
            .select("nombre", whole_up(F.col("_s")).alias("importe"), "posicion"))


def dash_summary(clean: DataFrame, f: Filters) -> dict[str, DataFrame]:
    """D2-D6 sharing one bounds aggregate: KPI row, months, six rankings."""
    win, lo, hi = dash_window(dash_filtered(clean, f), f)
    return {"kpis": dash_kpis(clean, f, win), "mes": dash_monthly(clean, f, win),
            "rankings": dash_rankings(clean, f, win), "rango": (lo, hi)}


def dash_json(clean: DataFrame, f: Filters) -> DataFrame:
    """The whole summary as one JSON document (the thin edge). Each part
    is aggregated in Spark first; only the small results are nested. The bounds, the
    KPIs, the months and the rankings are one scan each."""
    parts = dash_summary(clean, f)
    kpi = parts["kpis"]
    mes = parts["mes"].agg(F.sort_array(F.collect_list(F.struct(
        "mes", "facturacion", "pedidos"))).alias("mes"))
    names = [name for name, _, _ in S.RANKINGS]
    # At most 52 rows: one list, split by dimension.
    tops = parts["rankings"].agg(F.sort_array(F.collect_list(F.struct("posicion", "dimension", "nombre", "importe"))).alias("all"))
    def top(name):
        own = F.filter("all", lambda s: s["dimension"] == name)
        return F.transform(own, lambda s: F.struct(s["nombre"].alias("nombre"), s["importe"].alias("importe")))
    tops = tops.select(*[top(n).alias(n) for n in names])
    rango = F.array(*[F.lit(d).cast("date") for d in parts["rango"]])
    doc = kpi.select(F.struct(*kpi.columns).alias("kpis"), rango.alias("rango_total")).crossJoin(mes).crossJoin(tops)
    return doc.select(F.to_json(F.struct("kpis", "rango_total", "mes", *names), {"ignoreNullFields": "false"}).alias("resumen"))


def dash_filter_values(clean: DataFrame) -> DataFrame:
    """Distinct non-null values of the four filters, and the first and last day
    (``rango_desde``, ``rango_hasta``), from one scan: ``(lista, valor)`` in order. The
    sort is by ranges over tasks; no list has to fit one."""
    lists = (("comerciales", "comercial"), ("zonas", "zona"),
             ("familias", "familia"), ("tipos_cliente", "tipo_cliente"))
    spec = ", ".join(f"'{name}', {col}" for name, col in lists)
    cells = metric_base(clean).select(F.expr(
        f"stack({len(lists) + 1}, {spec}, 'rango', cast(to_date(fecha) as string)) as (lista, valor)"))
    is_range = F.col("lista") == "rango"
    found = (cells.where(F.col("valor").isNotNull())
             .groupBy("lista", F.when(~is_range, F.col("valor")).alias("uno"))
             .agg(F.min("valor").alias("a"), F.max("valor").alias("b")))
    def row(name, value):
        return F.struct(name.alias("lista"), value.alias("valor"))
    rows = F.when(is_range, F.array(row(F.lit("rango_desde"), F.col("a")), row(F.lit("rango_hasta"), F.col("b")))) \
            .otherwise(F.array(row(F.col("lista"), F.col("a"))))
    return found.select(F.inline(rows)).orderBy("lista", "valor")


def dash_orders(clean: DataFrame, query: E.Query) -> DataFrame:
    """The explorer with zone/family/type filters, ordered by day."""
    q = query.clamped()
    return E.page(clean, q, by_day=True)


def dash_orders_totals(clean: DataFrame, query: E.Query) -> DataFrame:
    """D9's head: rows and half-up amount of the whole filtered set, and the
    clamped limit, offset and order that the page was cut with."""
    q = query.clamped()
    return E.totals(E.filtered(clean, q), half_even=False).select(
        "total", F.lit(q.offset).cast("long").alias("offset"), F.lit(q.limite).cast("long").alias("limite"),
        F.lit(q.orden).alias("orden"), "importe")


STATE_FIELDS = (("estado", "ultimo_estado"), ("ultima_sincronizacion", "ultima_sincronizacion"),
                ("ultima_comprobacion", "ultima_comprobacion"), ("version_puerta", "version_puerta"),
                ("filas_crudas", "filas_crudas"), ("filas_limpias", "filas_limpias"), ("ultimo_error", "ultimo_error"))
RUN_FIELDS = ("id", "estado", "origen", "started_at", "finished_at", "filas_crudas", "filas_limpias",
              "facturacion_cruda", "facturacion_limpia", "incidencias", "mensaje", "version_puerta")


def dash_quality(runs: DataFrame, state: DataFrame) -> DataFrame:
    """The state's 7 fields and the latest run's 12 (by ``created_at``) as
    JSON, null members kept; ``{}`` where there is none."""
    last = runs.agg(F.max_by(F.struct(*RUN_FIELDS), F.col("created_at")).alias("calidad"))
    st = state.where(F.col("dataset_key") == S.DATASET_KEY).agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in STATE_FIELDS]), F.col("updated_at")).alias("sync"))
    keep = {"ignoreNullFields": "false"}
    return st.crossJoin(last).select(F.coalesce(F.to_json("sync", keep), F.lit("{}")).alias("sync"),
                                     F.coalesce(F.to_json("calidad", keep), F.lit("{}")).alias("calidad"))
