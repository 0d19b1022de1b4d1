"""The explorer (E1-E10) and its SQL-dashboard twin (D9): filtered, sorted,
paged order lines plus totals of the whole filtered set.

A page starts at the key of the row at its offset, found by counting ranges of the
sort keys, and is a top-n from there (no full sort, no rows skipped one by one).
Keyset paging (:func:`page_after`) starts at the last key of the page before.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import as_date, contains_ci, money_sum, whole_even, whole_up
from ordergate.operators.metrics import day_at_least, day_at_most, ntz


@dataclass(frozen=True)
class Query:
    limite: int = S.PAGE_DEFAULT
    offset: int = 0
    q: str | None = None
    comercial: str | None = None
    zona: str | None = None
    familia: str | None = None
    tipo_cliente: str | None = None
    desde: object = None
    hasta: object = None
    marca: str | None = None
    orden: str = "fecha"

    def clamped(self) -> "Query":
        """Limit into 1..200, offset >= 0, order normalised (Q18, Q19)."""
        lim = max(1, min(int(self.limite if self.limite is not None else S.PAGE_DEFAULT),
                         S.PAGE_MAX))
        off = max(0, int(self.offset or 0))
        orden = "registro" if self.orden == "registro" else "fecha"
        if self.marca not in (None, "", *S.MARKS):
            raise ValueError(f"unknown mark {self.marca!r}; expected one of {S.MARKS}")
        return Query(lim, off, self.q, self.comercial, self.zona, self.familia,
                     self.tipo_cliente, self.desde, self.hasta, self.marca, orden)


def _mark_filter(df: DataFrame, marca: str | None) -> DataFrame:
    """Flagged only / returns only / all but flagged / everything."""
    if not marca:
        return df
    if marca == "senalados":
        return df.where(F.col("sospechoso")) if "sospechoso" in df.columns else df.where(F.lit(False))
    if marca == "devoluciones":
        return (df.where(F.col("es_devolucion")) if "es_devolucion" in df.columns
                else df.where(F.lit(False)))
    if marca == "sin_senalados":
        return df.where(~F.col("sospechoso")) if "sospechoso" in df.columns else df
    raise ValueError(f"unknown mark {marca!r}")


def search_condition(q: str) -> Column:
    """Trimmed, case-insensitive literal substring in any search column."""
    needle = q.strip().lower()
    cond = F.lit(False)
    for c in S.SEARCH_COLUMNS:
        cond = cond | contains_ci(F.col(c), needle)
    return cond


def filtered(clean: DataFrame, query: Query) -> DataFrame:
    """E1-E4 (+ D9's zone/family/type): only the filters that were asked for
    enter the plan, so each one is a plain predicate Catalyst can push."""
    q = query.clamped()
    d = _mark_filter(clean, q.marca)
    desde, hasta = as_date(q.desde), as_date(q.hasta)
    if desde is not None:
        d = d.where(day_at_least(desde))
    if hasta is not None:
        d = d.where(day_at_most(hasta))
    for col, val in (("comercial", q.comercial), ("zona", q.zona),
                     ("familia", q.familia), ("tipo_cliente", q.tipo_cliente)):
        if val:
            d = d.where(F.col(col) == F.lit(val))
    if q.q and q.q.strip():
        d = d.where(search_condition(q.q))
    return d


def order_columns(df: DataFrame, orden: str, by_day: bool = False) -> list[Column]:
    """Newest first by date, or by entry order; ``pedido_id`` last."""
    fecha = F.to_date("fecha") if by_day else F.col("fecha")
    if S.ROW_POSITION not in df.columns:
        return [fecha.desc_nulls_last(), F.col("pedido_id").desc()]
    if orden == "registro":
        return [F.col(S.ROW_POSITION).desc(), F.col("pedido_id").desc()]
    return [fecha.desc_nulls_last(), F.col(S.ROW_POSITION).desc(), F.col("pedido_id").desc()]


def totals(filt: DataFrame, half_even: bool = True) -> DataFrame:
    """E5: row count and whole-unit sum of the filtered set (not the page)."""
    rnd = whole_even if half_even else whole_up
    return filt.agg(F.count(F.lit(1)).alias("total"),
                    rnd(money_sum(F.col("importe"))).alias("importe"))


def project_rows(df: DataFrame) -> DataFrame:
    """The row fields shown (amounts to cents, dates as days)."""
    position = (F.col(S.ROW_POSITION) if S.ROW_POSITION in df.columns
                else F.lit(None).cast("long").alias(S.ROW_POSITION))
    return df.select(
        "pedido_id", F.to_date("fecha").alias("fecha"), "comercial", "zona", "cliente",
        "tipo_cliente", "producto", "familia", "cantidad",
        F.round("precio_unitario", 2).alias("precio"), F.round("importe", 2).alias("importe"),
        F.coalesce(F.col("es_devolucion"), F.lit(False)).alias("devolucion"),
        F.coalesce(F.col("sospechoso"), F.lit(False)).alias("senalado"),
        position, "posicion")


NARROW = 4096        # parts that a range of keys is cut into per round


def _sort_keys(df: DataFrame, orden: str, by_day: bool) -> list[Column]:
    """The numeric keys of an order, all descending; the last is unique."""
    moment = F.unix_date(F.to_date("fecha")).cast("long") if by_day else F.unix_micros(F.col("fecha").cast("timestamp"))
    if S.ROW_POSITION not in df.columns:
        return [moment]
    return [F.col(S.ROW_POSITION)] if orden == "registro" else [moment, F.col(S.ROW_POSITION)]


def _from_rank(df: DataFrame, keys: list[Column], rank: int, parts_of: Column | None) -> tuple[Column, int]:
    """(condition that keeps the row at the 0-based ``rank`` and all after it, how many
    rows it keeps before that one): at most a page, or rows equal in every key.

    Key by key, the range that holds the rank is cut into parts, counted in one
    aggregate and narrowed to one part, so nothing is sorted or skipped row by row.
    """
    equal, after = F.lit(True), F.lit(False)
    for k, key in enumerate(keys):
        inside, part = equal, parts_of if k == 0 and parts_of is not None else None
        while True:
            rows = df.where(inside)
            if part is None:
                lo, hi = rows.agg(F.min(key), F.max(key)).first()
                width = max(1, -(-(hi - lo + 1) // NARROW)) if lo is not None else 1
                part = F.floor((key - F.lit(lo)) / F.lit(width)) if lo is not None else F.lit(None).cast("long")
            counts = (rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
                      .orderBy(F.col("p").desc_nulls_last()).collect())
            i = 0
            while i < len(counts) - 1 and rank >= counts[i]["n"]:
                rank -= counts[i]["n"]
                i += 1
            if not counts:
                return F.lit(False), 0
            lo, hi, n = counts[i]["lo"], counts[i]["hi"], counts[i]["n"]
            if lo is None:
                after, equal = F.lit(False), equal & key.isNull()
                break
            inside = equal & key.between(F.lit(lo), F.lit(hi))
            if n <= S.PAGE_MAX:
                return after | (equal & ((key <= F.lit(hi)) | key.isNull())), rank
            if lo == hi:
                after, equal = after | (equal & ((key < F.lit(lo)) | key.isNull())), equal & (key == F.lit(lo))
                break
            part = None
    return after | equal, rank


def page(clean: DataFrame, query: Query, by_day: bool = False) -> DataFrame:
    """One page of rows with its 1-based position in the ordering.

    The row at the offset is found by counting ranges of the sort keys; from
    there a page is a top-``limite``, so a task never holds more than a page, however
    deep it is. The page's last key is found first, from the sort keys alone."""
    q = query.clamped()
    filt = filtered(clean, q)
    order = order_columns(filt, q.orden, by_day)
    skip, rows = 0, filt
    if q.offset:
        keys = _sort_keys(filt, q.orden, by_day)
        day = None if len(keys) == 1 and S.ROW_POSITION in filt.columns else F.unix_date(F.to_date("fecha")).cast("long")
        start, skip = _from_rank(filt, keys, q.offset, day)
        rows = filt.where(start)
    rows = rows.where(_until_last(rows, q, by_day, skip)).orderBy(*order).offset(skip).limit(q.limite)
    w = Window.orderBy(*order)        # over at most 200 rows
    return project_rows(rows.withColumn("posicion", F.row_number().over(w) + F.lit(q.offset)))


def _until_last(rows: DataFrame, q: Query, by_day: bool, skip: int) -> Column:
    """Condition that keeps a page's last row and all before it, from the sort keys of the page (at most 200 rows).

    With it only a page's rows, and those equal in the keys, are carried through what the clean table
    still has to join; without it all rows would be."""
    moment = F.to_date("fecha") if by_day else F.col("fecha")
    position = [F.col(S.ROW_POSITION)] if S.ROW_POSITION in rows.columns else []
    keys = position if q.orden == "registro" and position else [moment, *position]
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    order = order_columns(rows, q.orden, by_day)
    page_keys = rows.orderBy(*order).offset(skip).limit(q.limite).select(*named).collect()
    if not page_keys:
        return F.lit(False)
    keep, equal = F.lit(False), F.lit(True)
    for key, last in zip(keys, page_keys[-1]):
        if last is None:          # nulls come last: every value lies before them
            keep, equal = keep | (equal & key.isNotNull()), equal & key.isNull()
        else:
            end = ntz(last) if isinstance(last, dt.datetime) else F.lit(last)
            keep, equal = keep | (equal & (key > end)), equal & (key == end)
    return keep | equal


def page_after(clean: DataFrame, query: Query, last_fecha, last_fila: int) -> DataFrame:
    """Keyset paging for deep pages of the date order: rows strictly after
    ``(last_fecha, last_fila)`` in ``fecha desc, fila_origen desc`` order.
    The key is a range predicate, so no rows before it are sorted or skipped."""
    q = query.clamped()
    filt = filtered(clean, q)
    last = ntz(last_fecha)
    key = ((F.col("fecha") < last)
           | ((F.col("fecha") == last) & (F.col(S.ROW_POSITION) < F.lit(last_fila))))
    order = order_columns(filt, "fecha")
    rows = filt.where(key).orderBy(*order).limit(q.limite)
    w = Window.orderBy(*order)
    return project_rows(rows.withColumn("posicion", F.row_number().over(w)))


def caption(tot: DataFrame, query: Query) -> DataFrame:
    """``a–b de total · importe`` under the table."""
    q = query.clamped()
    a = F.when(F.col("total") > 0, F.lit(q.offset + 1)).otherwise(F.lit(0))
    b = F.least(F.lit(q.offset + q.limite).cast("bigint"), F.col("total"))
    return tot.select(
        "total", "importe", a.cast("bigint").alias("desde_fila"), b.alias("hasta_fila"),
        F.concat(a.cast("string"), F.lit("–"), b.cast("string"), F.lit(" de "),
                 F.col("total").cast("string"), F.lit(" · "),
                 F.col("importe").cast("string"), F.lit(" €")).alias("texto"))


def explore(clean: DataFrame, query: Query) -> dict:
    """The explorer answer: header values + page rows (DataFrames)."""
    q = query.clamped()
    filt = filtered(clean, q)
    return {"offset": q.offset, "limite": q.limite, "orden": q.orden,
            "totales": totals(filt), "filas": page(clean, q)}
