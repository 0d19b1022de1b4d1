"""A rollup for the dashboard: figures per day and category instead of a scan per click.

Written next to the clean table, from its rows that count:

* ``days``: per day, category (the four filters) and kind (sale or return): rows, ids,
  amounts and their exact sum;
* ``names``: per day and category, the sum of each product and each customer;
* ``people``: per day and category, the set of customers as bitmaps of 64 numbers each, so a
  set of few customers takes a few numbers and one of many a bit each.

Sums add up and bitmaps merge by OR, so KPIs, months, rankings and the number of distinct
customers of any window and any filters are exact. A question reads as much as its window
holds days and categories, however many order lines there are; all three lie in day order,
so the window reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import money, whole_even, whole_up
from ordergate.operators import dashboard as D, metrics as M

CATEGORIES = ("comercial", "zona", "familia", "tipo_cliente")
NAMES = {"producto": "producto", "clientes": "cliente"}      # dimension -> column of ``names``
ZERO = "cast(0 as decimal(18,2))"


@dataclass
class Rollup:
    days: DataFrame
    names: DataFrame
    people: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"days": self.days, "names": self.names, "people": self.people}


def build(clean: DataFrame) -> Rollup:
    """The three tables of a clean table; each is one aggregate, pre-aggregated before its shuffle."""
    from ordergate.plans.storage import materialize, ordered_position
    base = M.metric_base(clean).withColumns({"dia": F.to_date("fecha"), "_m": money(F.col("importe"))})
    keys = ["dia", *CATEGORIES]
    # Four jobs read these columns; what is behind the clean table runs once.
    base = materialize(base.select(*keys, "es_devolucion", F.col("pedido_id").isNotNull().alias("_id"), "_m", *NAMES.values()), "rollup-base")
    days = base.groupBy(*keys, "es_devolucion").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if("_id").alias("pedidos"), F.count("_m").alias("importes"), F.sum("_m").alias("importe"))
    pairs = ", ".join(f"'{name}', {column}" for name, column in NAMES.items())
    long = base.select(*keys, "_m", F.expr(f"stack({len(NAMES)}, {pairs}) as (dimension, nombre)"))
    names = long.groupBy("dimension", *keys, "nombre").agg(F.sum("_m").alias("importe"))
    who = ordered_position(base.where(F.col("cliente").isNotNull()).select("cliente").distinct(), [F.col("cliente")])
    numbered = base.select(*keys, "cliente").join(who.select("cliente", F.col("posicion").alias("numero")), "cliente")
    people = (numbered.groupBy(*keys, F.shiftright("numero", 6).alias("tramo"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(numero & 63 as int))")).alias("clientes")))
    return Rollup(days, names, people)


def save(rollup: Rollup, path: str) -> None:
    """Each table sorted by day (names by dimension first), so that windows skip files and row groups."""
    for name, df in rollup.tables().items():
        keys = ["dimension", "dia"] if name == "names" else ["dia"]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Rollup:
    return Rollup(*(spark.read.parquet(f"{path}/{name}") for name in ("days", "names", "people")))


def _filtered(df: DataFrame, f: D.Filters) -> DataFrame:
    for column in CATEGORIES:
        if getattr(f, column):
            df = df.where(F.col(column) == F.lit(getattr(f, column)))
    return df


def bounds(rollup: Rollup, f: D.Filters) -> tuple[M.Window_, object, object]:
    """The window, and the first and last day."""
    days = _filtered(rollup.days, f).agg(F.min("dia").alias("a"), F.max("dia").alias("b")).first()
    hasta = D.as_date(f.hasta) or days["b"]
    desde = D.as_date(f.desde) or (M.minus_months(hasta, 12) if hasta else None)
    return M.Window_(desde, hasta), days["a"], days["b"]


def _between(a, b):
    return F.lit(False) if a is None or b is None else F.col("dia").between(F.lit(a), F.lit(b))


def kpi_frame(rollup: Rollup, f: D.Filters, win: M.Window_) -> DataFrame:
    """What :func:`ordergate.operators.metrics.kpi_frame` takes from the order lines."""
    known = win.desde is not None and win.hasta is not None
    inside = _between(win.desde, win.hasta)
    before = (F.col("dia") >= F.lit(win.prev_start)) & (F.col("dia") < F.lit(win.desde)) if known else F.lit(False)
    rows = _filtered(rollup.days, f).where(_between(min(win.prev_start, win.desde), win.hasta) if known else F.lit(False))
    sale = ~F.col("es_devolucion")

    def total(where, column, zero="0L"):
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.expr(zero))
    sums = rows.agg(
        total(inside, "importe", ZERO).alias("facturacion"), total(inside, "filas").alias("pedidos"),
        total(inside & sale, "importe", ZERO).alias("bruta"), total(inside & sale, "importes").alias("n_ventas"),
        total(inside & sale, "filas").alias("filas_ventas"),
        F.coalesce(-F.sum(F.when(inside & ~sale, F.col("importe"))), F.expr(ZERO)).alias("devoluciones"),
        total(before, "filas").alias("pedidos_anterior"), total(before, "importe", ZERO).alias("facturacion_anterior"))
    people = (_filtered(rollup.people, f).where(inside).groupBy("tramo").agg(F.bit_or("clientes").alias("c"))
              .agg(F.coalesce(F.sum(F.bit_count("c")), F.lit(0)).cast("bigint").alias("clientes")))
    return sums.crossJoin(people).withColumn("desde", F.lit(win.desde).cast("date")).withColumn("hasta", F.lit(win.hasta).cast("date"))


def dash_kpis(rollup: Rollup, f: D.Filters) -> DataFrame:
    """D4."""
    return D.kpi_row(kpi_frame(rollup, f, bounds(rollup, f)[0]))


def kpis(rollup: Rollup, desde=None, hasta=None) -> DataFrame:
    """M5."""
    f = D.Filters(desde=desde, hasta=hasta)
    return M.kpi_row(kpi_frame(rollup, f, bounds(rollup, f)[0]))


def monthly_series(rollup: Rollup) -> DataFrame:
    """M3."""
    return (rollup.days.groupBy(F.date_format("dia", "yyyy-MM").alias("mes"))
            .agg(whole_even(F.coalesce(F.sum("importe"), F.expr(ZERO))).alias("importe"), F.sum("pedidos").alias("pedidos")))


def dash_monthly(rollup: Rollup, f: D.Filters) -> DataFrame:
    """D5."""
    win, *_ = bounds(rollup, f)
    rows = _filtered(rollup.days, f).where(_between(win.desde, win.hasta))
    return (rows.groupBy(F.date_format("dia", "yyyy-MM").alias("mes"))
            .agg(whole_up(F.coalesce(F.sum("importe"), F.expr(ZERO))).alias("facturacion"), F.sum("filas").alias("pedidos")))


def dash_top(rollup: Rollup, f: D.Filters, dimension: str) -> DataFrame:
    """D6 for one dimension: categories from ``days``, products and customers from ``names``."""
    win, *_ = bounds(rollup, f)
    column, size = S.RANKING_COLUMN[dimension], S.RANKING_SIZE[dimension]
    if dimension in NAMES:
        rows, name = rollup.names.where(F.col("dimension") == dimension), F.col("nombre")
    else:
        rows, name = rollup.days, F.coalesce(F.col(column), F.lit(S.BLANK_LABEL)) if column == "zona" else F.col(column)
    sums = (_filtered(rows, f).where(_between(win.desde, win.hasta)).groupBy(name.alias("nombre"))
            .agg(F.coalesce(F.sum("importe"), F.expr(ZERO)).alias("_s")))
    order = [F.desc("_s"), F.asc_nulls_last("nombre")]
    return (sums.orderBy(*order).limit(size).withColumn("posicion", F.row_number().over(Window.orderBy(*order)))
            .select("nombre", whole_up(F.col("_s")).alias("importe"), "posicion"))
