"""Incident report and diagnosis.

Counts come from one aggregate over the verdict table, turned into report
lines with ``stack``: the report is a Spark result like any other, not a
Python list assembled from many small jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import beyond_money, money_sum, whole_even
from ordergate.operators.gate import VERDICT, GateResult, spelling_counts, spellings


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The counts of rows that leave the sheet; each row that leaves is in one of them.
DISCARDS = ("duplicados", "fecha_ilegible", "fecha_futura", "no_cuadra", "importe_cero", "registro_ilegible")


def count_row(res: GateResult) -> DataFrame:
    """One row with every count of the report, computed by Spark."""
    return res.verdicts.agg(*_count_aggs(res)).crossJoin(spelling_counts(spellings_of(res)))


def figures(res: GateResult) -> DataFrame:
    """:func:`count_row` and :func:`run_summary` side by side, from one pass over the verdicts."""
    row = res.verdicts.agg(*_count_aggs(res), *_summary_aggs(res)).crossJoin(spelling_counts(spellings_of(res)))
    counts = [c for c in row.columns if not c.startswith(("filas_", "_"))]
    return row.select(*counts, *_summary_columns())


def _count_aggs(res: GateResult) -> list:
    passing = F.col(VERDICT) == S.VERDICT_PASS
    ret = F.coalesce(F.col("cantidad") < 0, F.lit(False))
    limit = None if res.threshold is None else res.threshold * S.OUTLIER_FACTOR
    flagged = (passing & ~ret & F.coalesce(F.col("importe") > F.lit(limit), F.lit(False))
               if limit is not None else F.lit(False))
    return [
        F.count(F.lit(1)).alias("crudas"),
        F.count_if(F.col(VERDICT) == S.VERDICT_DUPLICATE).alias("duplicados"),
        F.count_if(F.col(VERDICT) == S.VERDICT_BAD_DATE).alias("fecha_ilegible"),
        F.count_if(F.col(VERDICT).startswith("DESCARTADA · fecha posterior")).alias("fecha_futura"),
        F.count_if(F.col(VERDICT) == S.VERDICT_MISMATCH).alias("no_cuadra"),
        F.count_if(F.col(VERDICT) == S.VERDICT_ZERO).alias("importe_cero"),
        F.count_if(passing).alias("limpias"),
        F.count_if(passing & ret).alias("devoluciones"),
        F.count_if(flagged).alias("senalados"),
        F.count_if(F.col(VERDICT) == S.VERDICT_BAD_RECORD).alias("registro_ilegible"),
        F.count_if(F.col("_bad_number")).alias("numero_ilegible"),
        F.count_if(beyond_money(F.col("importe"))).alias("fuera_de_rango"),
        *[F.count_if(passing & F.col(c).isNull()).alias(f"huecos_{c}")
          for c in S.BLANK_LABEL_COLUMNS],
    ]


def spellings_of(res: GateResult) -> DataFrame:
    return res.spell if res.spell is not None else spellings(res.verdicts.select("cliente"))


def incidents(res: GateResult, counted: DataFrame | None = None) -> DataFrame:
    """``(orden, regla, filas, accion)`` in fixed order, counts > 0 only; from a row of
    :func:`count_row`'s columns, if there already is one."""
    hoy = res.hoy.isoformat()
    lines = [
        (1, S.RULE_SPELLINGS, "grafias - clientes",
         f"concat('unificados: ', grafias, ' grafías → ', clientes, ' clientes reales')"),
        (2, S.RULE_DUPLICATES, "duplicados", _sql_text(S.ACTION_DUPLICATES)),
        (3, S.RULE_BAD_DATE, "fecha_ilegible", _sql_text(S.ACTION_BAD_DATE)),
        (4, S.RULE_FUTURE, "fecha_futura", _sql_text(S.ACTION_FUTURE.format(hoy=hoy))),
        (5, S.RULE_MISMATCH, "no_cuadra", _sql_text(S.ACTION_MISMATCH)),
        (6, S.RULE_ZERO, "importe_cero", _sql_text(S.ACTION_ZERO)),
        (7, S.RULE_RETURNS, "devoluciones", _sql_text(S.ACTION_RETURNS)),
        (8, S.RULE_FLAGGED, "senalados", _sql_text(S.ACTION_FLAGGED)),
    ]
    for i, col in enumerate(S.BLANK_LABEL_COLUMNS):
        if col in res.labelled:
            lines.append((9 + i, S.RULE_BLANKS.format(columna=col), f"huecos_{col}",
                          _sql_text(S.ACTION_BLANKS)))
    lines.append((12, S.RULE_BAD_NUMBER, "numero_ilegible", _sql_text(S.ACTION_BAD_NUMBER)))
    lines.append((13, S.RULE_BEYOND, "fuera_de_rango", _sql_text(S.ACTION_BEYOND)))
    lines.append((14, S.RULE_BAD_RECORD, "registro_ilegible", _sql_text(S.ACTION_BAD_RECORD)))
    body = ", ".join(f"{o}, {_sql_text(r)}, cast({n} as bigint), {a}" for o, r, n, a in lines)
    return ((count_row(res) if counted is None else counted)
            .select(F.expr(f"stack({len(lines)}, {body}) as (orden, regla, filas, accion)"))
            .where(F.col("filas") > 0))


def conservation(res: GateResult) -> DataFrame:
    """Rows in - rows out == sum of the discard counts (always checked)."""
    c = count_row(res)
    discarded = sum((F.col(c) for c in DISCARDS), F.lit(0))
    return c.select("crudas", "limpias", discarded.alias("descartadas"),
                    (F.col("crudas") - F.col("limpias") == discarded).alias("cuadra"))


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Rows per verdict (display order: count descending)."""
    return verdicts.groupBy(VERDICT).agg(F.count(F.lit(1)).alias("filas"))


def verdict_lookup(verdicts: DataFrame, pedido: str) -> DataFrame:
    """I4: case-insensitive id lookup (empty result = not in the sheet)."""
    return verdicts.where(F.lower(F.col("pedido_id")) == F.lit(pedido.lower()))


def verdict_newest(verdicts: DataFrame, n: int = 15, discarded_only: bool = False) -> DataFrame:
    """Newest rows by date, unreadable dates first; ties by entry order.
    A top-n (TakeOrderedAndProject), never a full sort."""
    d = verdicts.where(F.col(VERDICT) != S.VERDICT_PASS) if discarded_only else verdicts
    order = [F.col("fecha").desc_nulls_first(), F.col(S.ROW_POSITION).desc()]
    top = d.orderBy(*order).limit(n)
    return top.withColumn("posicion", F.row_number().over(Window.orderBy(*order)))


def mismatch_explained(verdicts: DataFrame) -> DataFrame:
    """Expected amount and difference for rows failing the amount rule."""
    expected = F.bround(F.col("cantidad") * F.col("precio_unitario"), 2)
    return (verdicts.where(F.col(VERDICT) == S.VERDICT_MISMATCH)
            .select(S.ROW_POSITION, "pedido_id", "cantidad", "precio_unitario", "importe",
                    expected.alias("esperado"),
                    F.bround(F.col("importe") - expected, 2).alias("diferencia")))


def run_summary(res: GateResult) -> DataFrame:
    """Raw vs clean rows and turnover (v1 whole units, v2 cents; the
    clean figures exclude flagged rows, ``filas_publicadas`` includes them)."""
    return res.verdicts.agg(*_summary_aggs(res)).select(*_summary_columns())


def _summary_aggs(res: GateResult) -> list:
    passing = F.col(VERDICT) == S.VERDICT_PASS
    limit = None if res.threshold is None else res.threshold * S.OUTLIER_FACTOR
    ret = F.coalesce(F.col("cantidad") < 0, F.lit(False))
    flagged = (~ret & F.coalesce(F.col("importe") > F.lit(limit), F.lit(False))
               if limit is not None else F.lit(False))
    counted = passing & ~flagged
    return [
        F.count(F.lit(1)).alias("filas_crudas"),
        F.count_if(counted).alias("filas_limpias"),
        F.count_if(passing).alias("filas_publicadas"),
        money_sum(F.col("importe")).alias("_cruda"),
        money_sum(F.when(counted, F.col("importe"))).alias("_limpia")]


def _summary_columns() -> list:
    return ["filas_crudas", "filas_limpias", "filas_publicadas",
            F.col("_cruda").cast("double").alias("facturacion_cruda"),
            F.col("_limpia").cast("double").alias("facturacion_limpia"),
            whole_even(F.col("_cruda")).alias("fact_crudo"),
            whole_even(F.col("_limpia")).alias("fact_limpio")]


def quality_header(summary: DataFrame) -> DataFrame:
    """I8: the header figures: difference raw - clean and its % of raw; rows
    discarded at the gate, flagged rows, and their sum as shown (Q20)."""
    dif = F.col("fact_crudo") - F.col("fact_limpio")
    return summary.select(
        "filas_crudas", "filas_limpias", "fact_crudo", "fact_limpio",
        dif.alias("diferencia"),
        F.round(F.try_divide(dif.cast("double"), F.col("fact_crudo").cast("double")) * 100, 1)
         .alias("diferencia_pct"),
        (F.col("filas_crudas") - F.col("filas_publicadas")).alias("descartadas_puerta"),
        (F.col("filas_publicadas") - F.col("filas_limpias")).alias("senaladas"),
        (F.col("filas_crudas") - F.col("filas_limpias")).alias("descartadas_mostradas"))
