"""The quality gate: G1-G16 as one verdict chain.

``verdicts`` assigns each raw row the first rule it breaks (nothing is
dropped); ``run_gate`` derives the clean table, the marks and every count of
the incident report from that same chain, so "verdict == gate" holds by
construction.

Plan shape (per refresh):
  * spellings: ``groupBy(cliente)`` -> key UDF on *distinct* spellings ->
    canonical name per key, written, then joined back by its known size;
  * duplicates: first row per repeated ``pedido_id`` by position and cells (map-side
    partial aggregation, so a hot id costs one row per task) joined back on
    ``pedido_id`` with null-safe equality; AQE splits a hot id's partition;
  * marks: the outlier threshold is an exact quantile found by narrowing
    (see :mod:`ordergate.operators.quantile`) and enters the plan as a literal.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.functions import (as_date, customer_key, parse_fecha, to_number,
                                 unreadable_number, utrim)
from ordergate.operators.quantile import exact_quantile
from ordergate.sources.sheet import _has_row_index, _is_file_scan, check_columns, conform, with_row_position

VERDICT = "veredicto"


# --------------------------------------------------------------------------
# typing
# --------------------------------------------------------------------------

def prepare(raw: DataFrame, date_formats: tuple[str, ...] = ()) -> DataFrame:
    """Typed gate input: position, parsed ``fecha``, text as text, numbers as
    double (unreadable text and NaN -> NULL), plus ``_bad_number`` and
    ``_bad_record`` (the source line did not parse)."""
    check_columns(raw)
    d = conform(with_row_position(raw))
    unparsed = F.col(S.BAD_RECORD).isNotNull() if S.BAD_RECORD in raw.columns else F.lit(False)
    types = {f.name: f.dataType for f in d.schema.fields}
    bad = F.lit(False)
    for c in S.NUMBER_COLUMNS:
        bad = bad | unreadable_number(F.col(c), types[c])
    cols = [F.col(S.ROW_POSITION).cast("long").alias(S.ROW_POSITION)]
    for c in S.TEXT_COLUMNS:
        if c == "fecha":
            cols.append(parse_fecha(F.col(c), types[c], date_formats).alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    cols += [to_number(F.col(c), types[c]).alias(c) for c in S.NUMBER_COLUMNS]
    return d.select(*cols, (bad & ~unparsed).alias("_bad_number"), unparsed.alias("_bad_record"))


# --------------------------------------------------------------------------
# G1-G4 customer spellings
# --------------------------------------------------------------------------

def spellings(typed: DataFrame) -> DataFrame:
    """Distinct non-null spellings with their row count and customer key."""
    return (typed.where(F.col("cliente").isNotNull())
                 .groupBy("cliente").agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("clave", customer_key(F.col("cliente"))))


def canonical_names(spell: DataFrame) -> DataFrame:
    """Per key, the most frequent trimmed spelling; ties -> smallest."""
    pairs = (spell.withColumn("recortado", utrim(F.col("cliente")))
                  .groupBy("clave", "recortado").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("clave").orderBy(F.desc("n"), F.asc("recortado"))
    return (pairs.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1)
                 .select("clave", F.col("recortado").alias("canonico")))


def name_map(spell: DataFrame) -> DataFrame:
    """G3 lookup table: spelling -> canonical name."""
    return (spell.select("cliente", "clave")
                 .join(canonical_names(spell), "clave")
                 .select("cliente", "clave", "canonico"))


def spelling_counts(spell: DataFrame) -> DataFrame:
    """Distinct spellings and distinct keys (one row)."""
    return spell.agg(F.count(F.lit(1)).alias("grafias"),
                     F.count_distinct("clave").alias("clientes"))


# --------------------------------------------------------------------------
# G5-G10 verdict chain
# --------------------------------------------------------------------------

def flag_duplicates(typed: DataFrame, unique_positions: bool | None = None, first: DataFrame | None = None) -> DataFrame:
    """``_dup`` = another row with the same id comes first. NULL ids are one
    group, as in the reference. Records that do not parse take no part.

    The order depends on the data alone, never on where a row is read: by position
    (NULL last), then by a 128-bit digest of all cells; rows equal in every cell (in position,
    id and digest) are interchangeable, so they are counted and all but one of them are duplicates. Where
    every position occurs once (positions made from the files, or found so by one
    aggregate), it decides alone, and the aggregate reads two columns.

    Only repeated ids have a partner in the join (``first``, see :func:`first_rows`; written here if not given): a small
    side when ids are mostly unique, whose size Spark knows before it plans, so it is broadcast and no row is
    shuffled; else a sort-merge join, both of whose sides are plain shuffles, so that AQE splits a hot id (or the
    NULL-id group).
    """
    if unique_positions is None:
        unique_positions = _positions_unique(typed)
    if first is None:
        from ordergate.plans.storage import materialize
        first = materialize(first_rows(typed, unique_positions), "first-rows")
    cells = typed.columns
    ranked = _ranked(typed, unique_positions)
    later = F.coalesce(F.col("_rank") > F.col("_first"), F.lit(False))
    if unique_positions:
        same_id = ranked["pedido_id"].eqNullSafe(first["_id"]) & ~ranked["_bad_record"]
        return ranked.join(first, same_id, "left").select(*cells, later.alias("_dup"))
    # Rows equal in every cell are one row and their number, before anything is joined: cells that the
    # caller does not need then leave the plan after the digest.
    keys = ["pedido_id", "_bad_record", "_rank"]
    copies = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), *[F.any_value(c).alias(c) for c in cells if c not in keys])
    same_id = copies["pedido_id"].eqNullSafe(first["_id"]) & ~copies["_bad_record"]
    joined = copies.join(first, same_id, "left").withColumns({"_later": later, "_repeated": F.col("_first").isNotNull()})
    return _unfold(joined).select(*cells, (F.col("_later") | (F.col("_repeated") & (F.col("_copy") > 0))).alias("_dup"))


def _ranked(typed: DataFrame, unique_positions: bool) -> DataFrame:
    """The rows with what orders those of one id, ``_rank``."""
    position = F.coalesce(F.col(S.ROW_POSITION), F.lit(_LAST))
    return typed.withColumn("_rank", position if unique_positions else F.struct(position.alias("at"), *_digest(typed)))


def first_rows(typed: DataFrame, unique_positions: bool) -> DataFrame:
    """``(_id, _first)``: the rank of the first row of each id that occurs more than once."""
    return (_ranked(typed, unique_positions).where(~F.col("_bad_record")).groupBy("pedido_id")
            .agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 1).select(F.col("pedido_id").alias("_id"), "_first"))


BLOCK_ROWS = 32_768             # rows of a file in one bitmap
BITMAP_BYTES = 64 << 20         # bitmaps that are sent to every task: those of half a billion rows


def later_rows(typed: DataFrame, first: DataFrame) -> DataFrame:
    """``(_f, _b, _bits)``: which rows of each block of a file come after the first row of their id. For rows read from
    Parquet files whose positions are unique; only ids, positions and places in the files are shuffled."""
    rows = _placed(typed).withColumn("_rank", F.coalesce(F.col(S.ROW_POSITION), F.lit(_LAST)))
    rows = rows.where(~F.col("_bad_record")).select("pedido_id", "_rank", "_f", "_b", "_at")
    later = rows.join(first, rows["pedido_id"].eqNullSafe(first["_id"])).where("_rank > _first")
    # Dealt by block first: one bitmap a block, not one a block and task.
    return later.select("_f", "_b", "_at").repartition("_f", "_b").groupBy("_f", "_b").agg(F.expr("bitmap_construct_agg(_at)").alias("_bits"))


def flag_later(typed: DataFrame, later: DataFrame) -> DataFrame:
    """G5 from the bitmaps of :func:`later_rows`, which go to every task while they are small: no row is shuffled then."""
    from ordergate.plans.storage import by_size
    rows = _placed(typed)
    # Numbers of 64 bits, made once a block: a row then looks up a number instead of making one from a byte's text.
    words = later.select("_f", "_b", F.expr("transform(sequence(0, cast(length(_bits) div 8 as int) - 1), "
                                            "i -> cast(conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10) as bigint))").alias("_words"))
    word = F.expr("get(_words, cast(_at div 64 as int))")
    bit = F.getbit(word, F.expr("cast((7 - _at % 64 div 8) * 8 + _at % 8 as int)")) == 1     # a word's first byte is its highest
    return rows.join(by_size(words, BITMAP_BYTES), ["_f", "_b"], "left").select(*typed.columns, F.coalesce(bit, F.lit(False)).alias("_dup"))


def _placed(typed: DataFrame) -> DataFrame:
    """The rows with their file, the block of it they lie in, and their place in the block."""
    row = F.col("_metadata.row_index")
    return typed.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.floor(row / BLOCK_ROWS), "_at": row % BLOCK_ROWS})


def _positions_unique(typed: DataFrame) -> bool:
    """Whether every row has a position and no two share one."""
    at = F.col(S.ROW_POSITION)
    return typed.groupBy(at.alias("_at")).agg(F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1 OR _at IS NULL").isEmpty()


def _digest(typed: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all cells; nulls count (the hash itself skips them)."""
    cells = [x for c in typed.columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*cells).alias("d1"), F.xxhash64(F.lit("second"), *cells).alias("d2")]


COPIES_AT_ONCE = 1 << 16


def _unfold(copies: DataFrame) -> DataFrame:
    """``_m`` rows for each row, numbered 0, 1, ... in ``_copy``. Where there are more than COPIES_AT_ONCE they are
    dealt out in blocks, so that one row with very many copies does not fill a task."""
    block = F.lit(COPIES_AT_ONCE)
    few = copies.where(F.col("_m") <= block).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    many = copies.where(F.col("_m") > block)
    blocks = many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / block))))
    start = F.col("_block") * block
    return few.unionByName(blocks.repartition("_block", "pedido_id").withColumn(
        "_copy", F.explode(F.sequence(start, F.least(start + block, F.col("_m")) - 1))).drop("_block"))


_LAST = (1 << 63) - 1


def _mismatch() -> Column:
    gap = F.abs(F.col("importe") - F.col("cantidad") * F.col("precio_unitario"))
    return F.coalesce(gap > F.lit(S.AMOUNT_TOLERANCE), F.lit(False))


def verdict_column(hoy: dt.date) -> Column:
    """First matching rule wins, in the fixed order of the gate."""
    return (F.when(F.col("_bad_record"), F.lit(S.VERDICT_BAD_RECORD))
             .when(F.col("_dup"), F.lit(S.VERDICT_DUPLICATE))
             .when(F.col("fecha").isNull(), F.lit(S.VERDICT_BAD_DATE))
             .when(F.to_date("fecha") > F.lit(hoy),
                   F.lit(S.VERDICT_FUTURE.format(hoy=hoy.isoformat())))
             .when(_mismatch(), F.lit(S.VERDICT_MISMATCH))
             .when(F.coalesce(F.col("importe") == 0, F.lit(False)), F.lit(S.VERDICT_ZERO))
             .otherwise(F.lit(S.VERDICT_PASS)))


def verdict_table(typed: DataFrame, hoy, unique_positions: bool | None = None, first: DataFrame | None = None) -> DataFrame:
    """Raw rows (raw ``cliente``) + ``veredicto`` + internal flags."""
    return flag_duplicates(typed, unique_positions, first).withColumn(VERDICT, verdict_column(as_date(hoy)))


def _made_here(raw: DataFrame) -> bool | None:
    """True if the gate numbers the rows itself; supplied positions must be looked at."""
    return None if S.ROW_POSITION in raw.columns else True


def verdicts(raw: DataFrame, hoy, date_formats: tuple[str, ...] = ()) -> DataFrame:
    """Every raw row with its verdict; nothing dropped, nothing renamed."""
    hoy = as_date(hoy)
    v = verdict_table(prepare(raw, date_formats), hoy, _made_here(raw))
    keep = [S.ROW_POSITION, *S.TEXT_COLUMNS, *S.NUMBER_COLUMNS, VERDICT]
    return v.select(*keep)


# --------------------------------------------------------------------------
# G11-G16 full gate
# --------------------------------------------------------------------------

@dataclass
class GateResult:
    hoy: dt.date
    verdicts: DataFrame          # typed raw rows + veredicto + flags
    clean: DataFrame             # the clean table (CLEAN_SCHEMA)
    counts: dict                 # every count of the incident report
    threshold: float | None      # p99.9 of passing non-return amounts
    labelled: tuple = field(default_factory=tuple)   # blank-labelled columns
    spell: DataFrame | None = None                   # distinct spellings + key
    names: DataFrame | None = None                   # spelling -> canonical name
    unique_positions: bool | None = None             # whether no two rows share a position, if it was looked at

    def release(self) -> None:
        """Delete the materialised tables (refresh done)."""
        from ordergate.plans.storage import release
        for df in (self.verdicts, self.spell, self.names):
            if df is not None:
                release(df)

    def incident_rows(self) -> list[tuple[int, str, int, str]]:
        """The report lines, fixed order, only counts > 0."""
        from ordergate.operators.report import incidents
        return sorted(tuple(r) for r in incidents(self).collect())


def run_gate(raw: DataFrame, hoy, eager_counts: bool = True, materialize: bool = False,
             date_formats: tuple[str, ...] = ()) -> GateResult:
    """Clean table + counts. Pure: the input is not touched.

    The outlier threshold is the only value needed before the clean plan can
    be built. ``eager_counts`` also reads the report counts (one aggregate
    over the verdict table plus the spelling aggregate).

    ``materialize=True`` (refresh jobs, the query catalog) writes the verdict
    table and the small spelling table once as Parquet in the shared
    checkpoint folder; the threshold, the counts and the clean write then
    scan those files instead of recomputing the joins and the customer-key
    UDF, and a lost executor does not replay the lineage.
    """
    hoy = as_date(hoy)
    if materialize:
        from ordergate.plans.storage import at_once, hashed, materialize as write_back, release
    typed = prepare(raw, date_formats)
    source = None
    if materialize and not _is_file_scan(raw):
        # Positions, first rows per id and the rows themselves are read one after the other: what made them runs once.
        typed = source = write_back(typed, "typed")
    labelled = tuple(c for c in S.BLANK_LABEL_COLUMNS if c in raw.columns)
    unique = _made_here(raw)
    if materialize:
        unique = _positions_unique(typed) if unique is None else unique
        first = write_back(first_rows(typed, unique), "first-rows")
        if unique and _has_row_index(typed):
            later = write_back(later_rows(typed, first), "later-rows")
            v = write_back(flag_later(typed, later).withColumn(VERDICT, verdict_column(hoy)), "verdicts")
            release(later)
        else:
            v = write_back(verdict_table(typed, hoy, unique, first), "verdicts")
        release(first)
        if source is not None:
            release(source)
    else:
        v = verdict_table(typed, hoy, unique)

    passing = v.where(F.col(VERDICT) == S.VERDICT_PASS)
    ret = F.coalesce(F.col("cantidad") < 0, F.lit(False))
    sales = passing.where(~ret)

    def threshold_of() -> float | None:
        found = exact_quantile(sales, "importe", S.OUTLIER_QUANTILE)
        return 0.0 if found is None and sales.isEmpty() else found

    def names_of() -> tuple[DataFrame, DataFrame]:
        # Written, so its size is known: Spark broadcasts it below the session's threshold, and shuffles
        # (splitting a hot customer) beyond, hashing the names while a partition of them fits a task's memory.
        spell = write_back(spellings(v.select("cliente")), "spellings")
        return spell, write_back(name_map(spell).select("cliente", "canonico"), "names")

    if materialize:
        threshold, (spell, names) = at_once(raw.sparkSession, threshold_of, names_of)
    else:
        threshold, spell = threshold_of(), spellings(typed)
        names = name_map(spell).select("cliente", "canonico")
    limit = None if threshold is None else threshold * S.OUTLIER_FACTOR
    flagged = (~ret & F.coalesce(F.col("importe") > F.lit(limit), F.lit(False))
               if limit is not None else F.lit(False))

    if materialize:
        # One row per spelling, and Spark knows it: a question that does not ask for customers does not join.
        # Dealt anew, so that both sides of the join are plain shuffles, whose hot partitions AQE splits.
        lookup = names.groupBy("cliente").agg(F.any_value("canonico").alias("canonico"))
        lookup = hashed(lookup.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    else:
        lookup = names
    marked = (passing.withColumn("es_devolucion", ret)
                     .withColumn("sospechoso", flagged)
                     .join(lookup, "cliente", "left")
                     .withColumn("cliente", F.col("canonico")))
    fill = {c: S.BLANK_LABEL for c in labelled}
    clean = marked.na.fill(fill) if fill else marked
    clean = clean.select(*[f.name for f in S.CLEAN_SCHEMA.fields])
    res = GateResult(hoy=hoy, verdicts=v, clean=clean, counts={},
                     threshold=threshold, labelled=labelled, spell=spell, names=names, unique_positions=unique)
    if eager_counts:
        from ordergate.operators.report import count_row
        res.counts = count_row(res).first().asDict()
    return res
