"""An index of what each file of a saved clean table holds, written next to it.

* ``archivos``: a row per file: rows, exact amount, first and last day of the rows that
  count, and, for each order of the explorer, the least and greatest rank its rows can have;
* ``terminos``: per search column the trigrams of its values, and per category its values,
  each with the set of files that hold it as bitmaps of 32,768 file numbers.

A search, a category filter or a page first asks the index which files can matter, then
asks the same question of those files alone. The index only leaves files out: whatever it lets
through is checked again, so answers are those of the whole table. A needle of fewer
than three letters, or a choice of more than LISTED files, reads the whole table.

The index is made by Spark jobs over the saved files. Looking up a term reads the row groups of that
term (sorted by column and term), a page reads ``archivos`` (a row per file of the table).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import money, whole_even, whole_up
from ordergate.operators import dashboard as D, explorer as E, metrics as M
from ordergate.plans import storage
from ordergate.sources.tables import load_clean

CATEGORIES = ("comercial", "zona", "familia", "tipo_cliente")
LETTERS = 3                      # every three letters in a row of a value are a term
LISTED = 10_000                  # names of chosen files that are listed one by one
BUCKETS = 4096                   # ranges of an order that rows are first counted by
LAYOUTS = ("fecha", "filtros")


@dataclass
class Indexed:
    path: str
    rows: DataFrame
    files: DataFrame
    terms: DataFrame


# ---------------------------------------------------------------- writing

def save(clean: DataFrame, path: str, layout: str = "fecha", at_least: int = 0) -> None:
    """Write the clean table and its index to a new folder.

    ``fecha`` lays rows out in the explorer's order, so a page lies in one or two files;
    ``filtros`` along a curve through day and categories, so that a filter on any of them leaves files
    out. ``at_least`` asks for that many files where the table is small.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; expected one of {LAYOUTS}")
    spark = clean.sparkSession
    keys = ["fecha", S.ROW_POSITION]
    if layout == "filtros":
        clean = clean.withColumn("_curva", storage.curve_key(clean, "fecha", CATEGORIES))
        keys = ["_curva", *keys]
    placed = storage.sorted_for_storage(clean, keys, at_least=at_least).drop("_curva")
    placed.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/tabla")
    rows = load_clean(spark, f"{path}/tabla").withColumn("archivo", F.col("_metadata.file_name"))
    stats = storage.materialize(_figures(rows), "file-figures")
    numbered = storage.ordered_position(stats, [F.col("archivo")])
    _files(stats, numbered).write.parquet(f"{path}/archivos")
    storage.release(numbered)
    storage.release(stats)
    numbers = spark.read.parquet(f"{path}/archivos").select("archivo", "numero")
    (_terms(rows, numbers).repartitionByRange("columna", "termino").sortWithinPartitions("columna", "termino", "tramo")
     .write.option("compression", "zstd").parquet(f"{path}/terminos"))


def load(spark: SparkSession, path: str) -> Indexed:
    return Indexed(path, load_clean(spark, f"{path}/tabla"), spark.read.parquet(f"{path}/archivos"),
                   spark.read.parquet(f"{path}/terminos"))


def _orders() -> dict[str, tuple[Column, Column]]:
    """Per order of the explorer: its key, and the number that its ranges are cut by. Nulls are
    least, that is last in a descending order, as in the explorer's."""
    day, position = F.to_date("fecha"), F.col(S.ROW_POSITION)
    return {"fecha": (F.struct("fecha", S.ROW_POSITION), F.unix_date(day).cast("long")),
            "dia": (F.struct(day.alias("dia"), position), F.unix_date(day).cast("long")),
            "registro": (F.struct(position), position)}


def _figures(rows: DataFrame) -> DataFrame:
    """One row per file: its figures, and the ends of its rows in each order."""
    counts = ~F.coalesce(F.col("sospechoso"), F.lit(False))
    figures = [F.count(F.lit(1)).alias("filas"), F.sum(money(F.col("importe"))).alias("importe"),
               F.min(F.when(counts, F.to_date("fecha"))).alias("desde"), F.max(F.when(counts, F.to_date("fecha"))).alias("hasta"),
               F.min(F.to_date("fecha")).alias("primer_dia"), F.max(F.to_date("fecha")).alias("ultimo_dia")]
    for name, (key, cut) in _orders().items():
        figures += [F.min(key).alias(f"{name}_min"), F.max(key).alias(f"{name}_max"),
                    F.min(F.struct(cut.alias("c"))).alias(f"{name}_corte_min"), F.max(F.struct(cut.alias("c"))).alias(f"{name}_corte_max")]
    return rows.groupBy("archivo").agg(*figures)


def _files(stats: DataFrame, numbered: DataFrame) -> DataFrame:
    """``archivos``: files numbered from 1 by name, with the ranks their rows can have."""
    out = numbered.withColumn("numero", F.col("posicion") + 1)
    total = F.lit(stats.agg(F.sum("filas")).first()[0] or 0)
    for name in _orders():
        newer = _rows_beyond(stats, name, "max", "min", descending=True).withColumnRenamed("n", f"{name}_antes")
        older = _rows_beyond(stats, name, "min", "max", descending=False).withColumnRenamed("n", "_n")
        out = (out.join(newer, "archivo").join(older, "archivo")
               .withColumn(f"{name}_hasta", total - F.col("_n")).drop("_n"))
    keep = ["archivo", "numero", "filas", "importe", "desde", "hasta", "primer_dia", "ultimo_dia",
            *[f"{name}_{end}" for name in _orders() for end in ("antes", "hasta")]]
    return out.select(*keep)


def _rows_beyond(stats: DataFrame, order: str, own: str, other: str, descending: bool) -> DataFrame:
    """Per file, the rows of files that lie wholly beyond it: whose ``other`` end is strictly
    before the file's ``own`` end in the direction given.

    Ends are counted by ranges of the order first, then inside each range, so no one task sorts all files.
    """
    ends = [stats.select("archivo", F.col(f"{order}_{own}").alias("k"), F.col(f"{order}_corte_{own}.c").alias("c"),
                         F.lit(0).alias("counts"), F.lit(0).cast("long").alias("filas")),
            stats.select(F.lit(None).cast("string").alias("archivo"), F.col(f"{order}_{other}").alias("k"),
                         F.col(f"{order}_corte_{other}.c").alias("c"), F.lit(1).alias("counts"), "filas")]
    ends = ends[0].unionByName(ends[1])
    lo, hi = ends.agg(F.min("c"), F.max("c")).first()
    width = max(1, -(-(hi - lo + 1) // BUCKETS)) if lo is not None else 1
    # Files of nulls come before all others when the order ascends, after them when it descends.
    ends = ends.withColumn("b", F.coalesce(F.floor((F.col("c") - F.lit(lo)) / F.lit(width)), F.lit(-1)) if lo is not None else F.lit(-1))
    ahead = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = (ends.groupBy("b").agg(F.sum("filas").alias("_f"))           # at most BUCKETS + 1 rows
              .withColumn("_before", F.coalesce(F.sum("_f").over(Window.orderBy(ahead("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    inside = Window.partitionBy("b").orderBy(ahead("k"), "counts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ends.withColumn("_in", F.sum("filas").over(inside)).join(before.select("b", "_before"), "b")
            .where("counts = 0").select("archivo", (F.col("_in") + F.col("_before")).alias("n")))


KEPT_TERMS = 1 << 20             # distinct trigrams of a file's column that a task holds before it hands them on


def _packed(values: pa.Array) -> np.ndarray:
    """The distinct trigrams of texts without nulls, each as three code points of 21 bits."""
    values = values.unique()
    letters = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(letters) < LETTERS:
        return np.empty(0, np.int64)
    cell = np.repeat(np.arange(len(values)), pc.utf8_length(values).to_numpy(zero_copy_only=False))
    grams = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
    return np.unique(grams[cell[:-2] == cell[2:]])       # the three letters of one value


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(archivo, columna, termino)`` of batches of ``archivo`` and lower-case search columns: the trigrams of the values,
    each about once per task."""
    seen: dict[tuple[str, str], np.ndarray] = {}

    def out(key):
        grams = seen.pop(key)
        letters = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype(np.uint32)
        text = letters.tobytes().decode("utf-32-le")
        terms = [text[i:i + LETTERS] for i in range(0, len(text), LETTERS)]
        return pa.RecordBatch.from_arrays([pa.array([k] * len(terms), pa.string()) for k in key] + [pa.array(terms, pa.string())],
                                          names=["archivo", "columna", "termino"])
    for batch in batches:
        files = batch.column("archivo")
        for name in files.unique().to_pylist():
            rows = batch.filter(pc.equal(files, name))
            for c in S.SEARCH_COLUMNS:
                grams = _packed(rows.column(c).drop_null())
                seen[name, c] = np.union1d(seen[name, c], grams) if (name, c) in seen else grams
        while sum(map(len, seen.values())) > KEPT_TERMS:
            yield out(max(seen, key=lambda k: len(seen[k])))
    for key in list(seen):
        yield out(key)


def _terms(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(columna, termino, tramo, archivos)``: the files of each trigram and each category value."""
    lower = rows.select("archivo", *[F.lower(c).alias(c) for c in S.SEARCH_COLUMNS])
    terms = lower.mapInArrow(_trigrams, "archivo string, columna string, termino string")
    pairs = ", ".join(f"'={c}', {c}" for c in CATEGORIES)
    values = rows.select("archivo", F.expr(f"stack({len(CATEGORIES)}, {pairs}) as (columna, termino)")).where("termino is not null")
    return (terms.unionByName(values).distinct().join(numbers, "archivo")
            .groupBy("columna", "termino", F.expr("bitmap_bucket_number(numero)").alias("tramo"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(numero))").alias("archivos")))


# ---------------------------------------------------------------- choosing files

def _holding(t: Indexed, column: str, terms: set[str]) -> DataFrame:
    """``(tramo, archivos)``: the files that hold all of the terms in the column."""
    return (t.terms.where((F.col("columna") == column) & F.col("termino").isin(sorted(terms)))
            .groupBy("tramo").agg(F.count(F.lit(1)).alias("_n"), F.expr("bitmap_and_agg(archivos)").alias("archivos"))
            .where(F.col("_n") == len(terms)).drop("_n"))


def _numbers(bitmaps: DataFrame) -> DataFrame:
    """The file numbers set in ``(tramo, archivos)``."""
    byte = F.conv(F.hex(F.expr("substring(archivos, octeto, 1)")), 16, 10).cast("int")
    bits = (bitmaps.select("tramo", "archivos", F.explode(F.expr("sequence(1, octet_length(archivos))")).alias("octeto"))
            .select("tramo", "octeto", byte.alias("valor")).where("valor <> 0")
            .select("tramo", "octeto", "valor", F.explode(F.expr("sequence(0, 7)")).alias("bit")).where("getbit(valor, bit) = 1"))
    return bits.select(F.expr("(tramo - 1) * 32768 + (octeto - 1) * 8 + bit + 1").alias("numero"))


def chosen(t: Indexed, query: E.Query) -> DataFrame:
    """The rows of ``files`` that can hold a row the query's filters let through."""
    q = query.clamped()
    files = t.files
    desde, hasta = E.as_date(q.desde), E.as_date(q.hasta)
    if desde is not None:
        files = files.where(F.col("ultimo_dia") >= F.lit(desde))
    if hasta is not None:
        files = files.where(F.col("primer_dia") <= F.lit(hasta))
    needed = [_holding(t, f"={c}", {getattr(q, c)}) for c in CATEGORIES if getattr(q, c)]
    needle = (q.q or "").strip().lower()
    if len(needle) >= LETTERS:
        grams = {needle[i:i + LETTERS] for i in range(len(needle) - LETTERS + 1)}
        found = _holding(t, S.SEARCH_COLUMNS[0], grams)
        for c in S.SEARCH_COLUMNS[1:]:
            found = found.unionByName(_holding(t, c, grams))
        needed.append(found.groupBy("tramo").agg(F.expr("bitmap_or_agg(archivos)").alias("archivos")))
    if needed:
        both = needed[0]
        for other in needed[1:]:
            both = both.unionByName(other)
        both = (both.groupBy("tramo").agg(F.count(F.lit(1)).alias("_n"), F.expr("bitmap_and_agg(archivos)").alias("archivos"))
                .where(F.col("_n") == len(needed)).drop("_n"))
        files = files.join(_numbers(both), "numero", "left_semi")
    return files


def rows_of(t: Indexed, files: DataFrame) -> DataFrame:
    """The table's rows in the chosen files; the whole table where they are too many to be listed."""
    names = [r[0] for r in files.select("archivo").limit(LISTED + 1).collect()]
    if len(names) > LISTED:
        return t.rows
    if not names:
        return t.rows.where(F.lit(False))
    return t.rows.sparkSession.read.schema(S.CLEAN_SCHEMA).parquet(*[f"{t.path}/tabla/{n}" for n in sorted(names)])


def _unfiltered(q: E.Query) -> bool:
    return not any((q.q and q.q.strip(), q.marca, q.desde, q.hasta, *[getattr(q, c) for c in CATEGORIES]))


# ---------------------------------------------------------------- answers

def search(t: Indexed, query: E.Query) -> DataFrame:
    """The filtered rows, from the files that can hold any."""
    return E.filtered(rows_of(t, chosen(t, query)), query)


def totals(t: Indexed, query: E.Query, half_even: bool = True) -> DataFrame:
    """E5: of the whole table from ``files`` alone, of a filtered set from the files chosen."""
    q = query.clamped()
    if not _unfiltered(q):
        return E.totals(search(t, q), half_even)
    rnd = whole_even if half_even else whole_up
    return t.files.agg(F.coalesce(F.sum("filas"), F.lit(0)).alias("total"),
                       F.coalesce(rnd(F.sum("importe")), F.lit(0).cast("long")).alias("importe"))


def page_files(t: Indexed, query: E.Query, by_day: bool = False) -> tuple[DataFrame, int]:
    """The files that can hold a row of an unfiltered page, and the rows of files that lie
    wholly before it. A file not chosen lies wholly before the page or wholly after."""
    q = query.clamped()
    order = "registro" if q.orden == "registro" else "dia" if by_day else "fecha"
    first, last = F.col(f"{order}_antes"), F.col(f"{order}_hasta")
    skipped = t.files.where(last <= q.offset).agg(F.coalesce(F.sum("filas"), F.lit(0))).first()[0]
    return t.files.where((first < q.offset + q.limite) & (last > q.offset)), skipped


def page(t: Indexed, query: E.Query, by_day: bool = False) -> DataFrame:
    """An unfiltered page from the files that hold its ranks, a filtered one from the
    files that can hold rows it lets through."""
    q = query.clamped()
    if not _unfiltered(q):
        return E.page(rows_of(t, chosen(t, q)), q, by_day)
    files, skipped = page_files(t, q, by_day)
    rows = E.page(rows_of(t, files), replace(q, offset=q.offset - skipped), by_day)
    return rows.withColumn("posicion", F.col("posicion") + F.lit(skipped).cast("int"))


def date_range(t: Indexed) -> DataFrame:
    """M8 range of the rows that count (M4 and D2 without filters), from ``files`` alone."""
    return t.files.agg(F.min("desde").alias("desde"), F.max("hasta").alias("hasta"))


def dash_filtered(t: Indexed, f: D.Filters) -> DataFrame:
    """D1 from the files that can hold rows of the category filters."""
    query = E.Query(**{c: getattr(f, c) for c in CATEGORIES})
    return D.dash_filtered(rows_of(t, chosen(t, query)), f)


def dash_summary(t: Indexed, f: D.Filters) -> dict[str, DataFrame]:
    """D2-D6 over the files that can hold rows of the category filters."""
    query = E.Query(**{c: getattr(f, c) for c in CATEGORIES})
    return D.dash_summary(rows_of(t, chosen(t, query)), f)
