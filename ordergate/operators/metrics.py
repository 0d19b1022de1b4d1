"""Metrics on the clean table (M1-M10): rankings, monthly series, KPIs with
previous-window variation.

Money is summed as ``decimal(18,2)`` (exact, order-independent) and rounded
half-to-even to whole units, like the per-row metrics of the reference.
Windows compare calendar days. Bounds are read first as one tiny aggregate so
the window becomes a literal range filter that reaches the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import as_date, money, money_sum, whole_even


def metric_base(clean: DataFrame) -> DataFrame:
    """M1: rows that count -- everything but the flagged outliers."""
    if "sospechoso" in clean.columns:
        return clean.where(~F.col("sospechoso"))
    return clean


def midnight(d: dt.date) -> Column:
    """``timestamp_ntz`` literal for the start of day ``d``, built from text so
    no session or process time zone can move it."""
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day_at_least(d: dt.date) -> Column:
    """``day(fecha) >= d`` written on the raw column so Parquet can skip."""
    return F.col("fecha") >= midnight(d)


def day_at_most(d: dt.date) -> Column:
    """``day(fecha) <= d`` as ``fecha < d + 1 day`` (pushable)."""
    return F.col("fecha") < midnight(d + dt.timedelta(days=1))


def day_before(d: dt.date) -> Column:
    return F.col("fecha") < midnight(d)


# --------------------------------------------------------------------------
# M2 rankings
# --------------------------------------------------------------------------

def top(clean: DataFrame, dimension: str, n: int | None = None) -> DataFrame:
    """Top-n of one dimension by summed amount: ``(nombre, importe, posicion)``.

    Null keys are dropped; ties break by name ascending. The grouped set is
    reduced by a window-group limit (top-n per partition before one merge).
    """
    col = S.RANKING_COLUMN.get(dimension, dimension)
    n = n or S.RANKING_SIZE.get(dimension, 8)
    sums = (metric_base(clean).where(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("nombre"))
            .agg(money_sum(F.col("importe")).alias("_s")))
    w = Window.orderBy(F.desc("_s"), F.asc("nombre"))
    return (sums.withColumn("posicion", F.row_number().over(w))
                .where(F.col("posicion") <= n)
                .select("nombre", whole_even(F.col("_s")).alias("importe"), "posicion"))


def top_all(clean: DataFrame) -> DataFrame:
    """All six rankings in one scan and one shuffle:
    ``(dimension, nombre, importe, posicion)``.

    Rows are unpivoted to ``(dimension, nombre, importe)`` and pre-aggregated
    map-side, so the shuffle carries one row per (dimension, name, task).
    """
    dims = ", ".join(f"'{name}', {col}" for name, col, _ in S.RANKINGS)
    long = (metric_base(clean)
            .select(F.expr(f"stack({len(S.RANKINGS)}, {dims}) as (dimension, nombre)"),
                    "importe")
            .where(F.col("nombre").isNotNull()))
    sums = long.groupBy("dimension", "nombre").agg(money_sum(F.col("importe")).alias("_s"))
    w = Window.partitionBy("dimension").orderBy(F.desc("_s"), F.asc("nombre"))
    size = F.lit(8)
    for name, _, n in S.RANKINGS:
        size = F.when(F.col("dimension") == name, F.lit(n)).otherwise(size)
    max_n = max(n for _, _, n in S.RANKINGS)
    return (sums.withColumn("posicion", F.row_number().over(w))
                .where(F.col("posicion") <= max_n)        # literal: window-group limit
                .where(F.col("posicion") <= size)
                .select("dimension", "nombre", whole_even(F.col("_s")).alias("importe"),
                        "posicion"))


def top_share(ranking: DataFrame) -> DataFrame:
    """M9: share of the shown total and bar width relative to the largest.
    Runs on a top-n result (at most n rows)."""
    w = Window.partitionBy()
    return ranking.select(
        "*",
        F.round(F.try_divide(F.col("importe"), F.sum("importe").over(w)) * 100, 1).alias("cuota_pct"),
        F.round(F.try_divide(F.col("importe"), F.max("importe").over(w)) * 100, 1).alias("barra_pct"))


# --------------------------------------------------------------------------
# M3 monthly series
# --------------------------------------------------------------------------

def monthly_series(clean: DataFrame) -> DataFrame:
    """Per calendar month: amount and count of order ids. Empty months absent."""
    return (metric_base(clean)
            .groupBy(F.date_format("fecha", "yyyy-MM").alias("mes"))
            .agg(whole_even(money_sum(F.col("importe"))).alias("importe"),
                 F.count("pedido_id").alias("pedidos")))


# --------------------------------------------------------------------------
# M4-M8 KPIs
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Window_:
    desde: dt.date | None
    hasta: dt.date | None

    @property
    def days(self) -> int:
        return (self.hasta - self.desde).days

    @property
    def prev_start(self) -> dt.date:
        return self.desde - dt.timedelta(days=self.days)


def minus_months(d: dt.date, months: int) -> dt.date:
    """Calendar months back, end-of-month clamped (like ``interval`` math)."""
    y, m = divmod(d.year * 12 + (d.month - 1) - months, 12)
    m += 1
    last = (dt.date(y + (m == 12), m % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(y, m, min(d.day, last))


def date_range(base: DataFrame) -> DataFrame:
    """M8 range: first and last day of the base (one row)."""
    return base.agg(F.to_date(F.min("fecha")).alias("desde"),
                    F.to_date(F.max("fecha")).alias("hasta"))


def kpi_bounds(base: DataFrame, desde=None, hasta=None) -> Window_:
    """M4: ``hasta`` = given or last day; ``desde`` = given or hasta - 12 months."""
    hasta = as_date(hasta)
    if hasta is None:
        last = base.agg(F.max("fecha").alias("m")).first()["m"]
        hasta = last.date() if last is not None else None
    desde = as_date(desde)
    if hasta is not None and desde is None:
        desde = minus_months(hasta, 12)
    return Window_(desde, hasta)


def kpi_frame(base: DataFrame, win: Window_) -> DataFrame:
    """M5-M7 in one aggregate over the rows of both windows (one row).

    Also returns the raw sums that the dashboard variant rounds differently.
    """
    if win.hasta is None or win.desde is None:
        rows = base.where(F.lit(False))
        in_win = in_prev = F.lit(False)
    else:
        lo = min(win.prev_start, win.desde)
        rows = base.where(day_at_least(lo) & day_at_most(win.hasta))
        in_win = day_at_least(win.desde) & day_at_most(win.hasta)
        in_prev = day_at_least(win.prev_start) & day_before(win.desde)
    ret = F.col("es_devolucion")
    amount = money(F.col("importe"))
    zero = F.lit(0).cast(S.PUBLISHED_SCHEMA["importe"].dataType)
    return rows.agg(
        F.coalesce(F.sum(F.when(in_win, amount)), zero).alias("facturacion"),
        F.count_if(in_win).alias("pedidos"),
        F.coalesce(F.sum(F.when(in_win & ~ret, amount)), zero).alias("bruta"),
        F.count(F.when(in_win & ~ret, amount)).alias("n_ventas"),
        F.count_if(in_win & ~ret).alias("filas_ventas"),
        F.count_distinct(F.when(in_win, F.col("cliente"))).alias("clientes"),
        F.coalesce(-F.sum(F.when(in_win & ret, amount)), zero).alias("devoluciones"),
        F.count_if(in_prev).alias("pedidos_anterior"),
        F.coalesce(F.sum(F.when(in_prev, amount)), zero).alias("facturacion_anterior"),
    ).withColumn("desde", F.lit(win.desde).cast("date")).withColumn(
        "hasta", F.lit(win.hasta).cast("date"))


def kpis(clean: DataFrame, desde=None, hasta=None) -> DataFrame:
    """M5 KPI row (v1 rounding: half to even, whole units / one decimal)."""
    base = metric_base(clean)
    return kpi_row(kpi_frame(base, kpi_bounds(base, desde, hasta)))


def kpi_row(k: DataFrame) -> DataFrame:
    """The KPI row of a :func:`kpi_frame`."""
    fact, prev = F.col("facturacion").cast("double"), F.col("facturacion_anterior").cast("double")
    bru, dev = F.col("bruta").cast("double"), F.col("devoluciones").cast("double")
    return k.select(
        whole_even(F.col("facturacion")).alias("facturacion"),
        F.when((F.col("pedidos_anterior") > 0) & (prev != 0),
               F.bround((fact / prev - 1) * 100, 1)).alias("var_pct"),
        F.col("pedidos"),
        F.when(F.col("n_ventas") > 0,
               whole_even(F.try_divide(F.col("bruta"), F.col("n_ventas"))))
         .when(F.col("filas_ventas") > 0, F.lit(None))
         .otherwise(F.lit(0)).cast("bigint").alias("ticket"),
        F.col("clientes"),
        whole_even(F.col("devoluciones")).alias("devoluciones"),
        F.when(bru != 0, F.bround(dev / bru * 100, 1)).otherwise(F.lit(0.0)).alias("dev_pct"),
        "desde", "hasta")


def kpi_alert(kpi: DataFrame) -> DataFrame:
    """The returns alert of the dashboard (returns above 3% of gross)."""
    return kpi.withColumn("alerta_devoluciones", F.col("dev_pct") > F.lit(S.RETURNS_ALERT_PCT))


def payload(clean: DataFrame, hoy=None) -> dict[str, DataFrame]:
    """M8: everything the dashboard shows, as DataFrames (JSON only at the edge).

    One small aggregate reads the first and last day; the KPI window and the
    range both come from it, so the payload costs four scans, not six.
    """
    base = metric_base(clean)
    row = base.agg(F.min("fecha").alias("a"), F.max("fecha").alias("b")).first()
    first = row["a"].date() if row["a"] is not None else None
    last = row["b"].date() if row["b"] is not None else None
    win = Window_(minus_months(last, 12) if last else None, last)
    spark = clean.sparkSession
    rango = spark.range(1).select(F.lit(first).cast("date").alias("desde"),
                                  F.lit(last).cast("date").alias("hasta"))
    if hoy is not None:
        rango = rango.withColumn("actualizado", F.lit(as_date(hoy)))
    return {"kpi": kpis(clean, win.desde, win.hasta), "mes": monthly_series(clean),
            "tops": top_all(clean), "rango": rango}
