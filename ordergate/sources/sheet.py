"""Reading the dirty order sheet: S1 read, S2 column contract, S3 row position,
S6 source fallback, S7 cache of the last good source.

The sheet is an export (Parquet, CSV or JSON) of one tab. Text columns are
read as text; numbers and dates are typed later by the gate with ``try_cast``
so one bad cell never stops a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordergate import schema as S

PREFERRED_TAB = "Pedidos"


class MissingColumns(ValueError):
    """The sheet is not the order sheet we expect."""


class NoSource(RuntimeError):
    """No candidate source could be read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path`` (any Hadoop file system), sorted."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath) or not fs.getFileStatus(jpath).isDirectory():
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(jpath))


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    if fs.exists(jpath):
        fs.delete(jpath, True)


CURRENT_COPY = "_CURRENT"    # names the live version of a cached sheet


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if it is not there."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool) -> None:
    """A small file, whole or not at all: written under another name, then
    renamed; without ``replace`` the rename fails if the name is taken."""
    import uuid
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, path)
    folder = target.getParent()
    fs.mkdirs(folder)
    temporary = jvm.org.apache.hadoop.fs.Path(folder, f"_tmp-{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1 if replace else 0)
    if replace:
        options[0] = rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf) \
            .rename(fs.makeQualified(temporary), fs.makeQualified(target), options)
    except Exception:
        fs.delete(temporary, False)
        raise


def resolve_tab(spark: SparkSession, path: str) -> str:
    """A folder of tabs resolves to ``Pedidos``, or to its only tab.

    A folder that holds data files or partition folders (``name=value``) is
    one tab itself; a cached sheet resolves to its current copy. Several tabs
    without ``Pedidos`` are an error: reading one of them would lose the others.
    """
    base = path.rstrip("/")
    copy = read_text(spark, f"{base}/{CURRENT_COPY}")
    if copy:
        return f"{base}/{copy.strip()}"
    names = [n for n in list_dir(spark, path) if not n.startswith(("_", "."))]
    if not names and not path_exists(spark, path):
        raise NoSource(f"The sheet has no tab: {path}")
    if not names:
        return path
    preferred = [n for n in names if _tab_name(n) == PREFERRED_TAB]
    if len(preferred) == 1:
        return f"{base}/{preferred[0]}"
    tabs = [n for n in names if "=" not in n and is_folder(spark, f"{base}/{n}")]
    if len(tabs) < len(names) and not preferred:
        return path
    if len(names) > 1:
        raise NoSource(f"No single tab {PREFERRED_TAB!r} in {path}: {names}")
    return f"{base}/{tabs[0]}"


def _tab_name(name: str) -> str:
    return name.split(".")[0]


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath) and bool(fs.getFileStatus(jpath).isDirectory())


CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "false"}


def read_orders(spark: SparkSession, path: str | list[str], fmt: str = "parquet", multiline: bool = False) -> DataFrame:
    """Read the sheet. CSV/JSON cells are read as text; Parquet keeps its
    types (the gate types columns itself).

    Every CSV file's header must name the same columns in the same order, else
    reading fails instead of putting cells under other names. JSON names its
    cells row by row, so finding all names takes a pass over the data.
    A list of paths is one sheet in several files.

    Text sheets get one more column, :data:`ordergate.schema.BAD_RECORD`: the line of a
    record that does not parse (too few or too many cells, cut JSON), which the gate
    counts under its own reason. ``multiline`` lets a record go over several lines, for sheets
    whose quoted cells hold line breaks; each file is then read by one task. Without it files
    are split, and the lines of such a record count as unreadable.
    """
    if isinstance(path, str):
        path = resolve_tab(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.options(columnNameOfCorruptRecord=S.BAD_RECORD, multiLine=str(multiline).lower())
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
        names = reader.csv(path).columns
    else:
        names = reader.option("primitivesAsString", "true").json(path).columns
    names = [c for c in names if c != S.BAD_RECORD]
    return reader.schema(_all_text([*names, S.BAD_RECORD])).format(fmt).load(path)


def _all_text(names) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def check_columns(df: DataFrame) -> None:
    """The 7 required columns must be present (driver-side, no job)."""
    missing = sorted(set(S.REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise MissingColumns(
            f"The sheet lacks columns: {missing}. It has: {sorted(df.columns)}")


def missing_columns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """S2 as data: one row per required column with its presence."""
    present = set(df.columns)
    rows = [(c, c in present) for c in S.REQUIRED_COLUMNS]
    return spark.createDataFrame(rows, "columna string, presente boolean")


def with_row_position(df: DataFrame, from_files: bool | None = None,
                      name: str = S.ROW_POSITION) -> DataFrame:
    """S3: ``fila_origen``, the 0-based input position, if not supplied.

    Position = rows of earlier files + row index within the file
    (``_metadata.row_index`` of Parquet). Files follow each other by name, digits by
    value (part 100000 comes after part 99999). The offsets table, one row per file,
    is written to the shared folder, so the join knows its size and broadcasts
    it only within the session's threshold.

    How text files are cut into splits depends on the cores at planning, so text rows
    are written once, with the split and the place they were read at, and
    everything else follows from that table. A frame that is not a file scan is
    written once too. A row of a file without an offset is an error, never left out.
    """
    if name in df.columns:
        return df
    cols = df.columns
    if from_files is None:
        from_files = _is_file_scan(df)
    from ordergate.plans.storage import materialize
    if not from_files:
        # Fixes the rows' order: a retried task after a shuffle may see its rows
        # in another one, which would move positions.
        df = materialize(df, "unpositioned")
    if _has_row_index(df):
        d = df.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.lit(0).cast("long"), "_i": F.col("_metadata.row_index")})
        splits = d.groupBy("_f", "_b").agg((F.max("_i") + 1).alias("_n"), F.lit(0).cast("long").alias("_i0"))
    else:
        d = materialize(df.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"),
                                        "_i": F.monotonically_increasing_id()}), "text-rows")
        splits = d.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"))
    w = Window.orderBy(natural_order(F.col("_f")), "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(F.col("_f").alias("_of"), F.col("_b").alias("_ob"),
                            (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_i0")).alias("_off"))
    offsets = materialize(offsets, "offsets")
    found = d.join(offsets, (d["_f"] == offsets["_of"]) & (d["_b"] == offsets["_ob"]), "left")
    missing = F.raise_error(F.concat(F.lit("no position for rows of "), F.col("_f"))).cast("long")
    return found.select(F.coalesce(F.col("_off"), missing).alias("_off"), "_i", *cols) \
        .select((F.col("_off") + F.col("_i")).alias(name), *cols)


def natural_order(c):
    """Text whose order compares runs of digits by value."""
    pieces = F.split(c, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike(r"^\d+$"), F.lpad(p, F.greatest(F.lit(20), F.length(p)), F.lit("0"))).otherwise(p)), "")


def _has_row_index(df: DataFrame) -> bool:
    try:
        df.select("_metadata.row_index").schema
        return True
    except AnalysisException:
        return False


def _is_file_scan(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_block_start").schema
        return True
    except AnalysisException:
        return False


def conform(df: DataFrame) -> DataFrame:
    """Add the expected optional columns as NULL text when absent (Q17)."""
    for c in S.OPTIONAL_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


@dataclass
class Source:
    origen: str          # 'source', 'cache' or 'reference'
    path: str | list[str]
    fmt: str = "parquet"
    date_formats: tuple[str, ...] = ()   # how its text dates look, besides ISO ('dd/MM/yyyy', ...)
    multiline: bool = False              # records over several lines; see read_orders


@dataclass
class Fetched:
    df: DataFrame
    origen: str
    aviso: str | None
    path: str | list[str]
    fmt: str = "parquet"


def first_available(spark: SparkSession, candidates: list[Source]) -> Fetched:
    """The first candidate that reads and meets the column contract.

    A fallback result carries a warning naming why the primary failed.
    """
    reasons = []
    for i, cand in enumerate(candidates):
        try:
            df = read_orders(spark, cand.path, cand.fmt, cand.multiline)
            check_columns(df)
        except (NoSource, MissingColumns, AnalysisException, Py4JJavaError) as exc:  # missing, wrong columns, unreadable
            reasons.append(f"{cand.origen}: {type(exc).__name__}: {exc}")
            continue
        aviso = None
        if i > 0:
            aviso = (f"Primary source unavailable ({'; '.join(reasons)}). "
                     f"Serving the {cand.origen} copy; newer orders may be missing.")
        return Fetched(df, cand.origen, aviso, cand.path, cand.fmt)
    raise NoSource("No source could be read: " + "; ".join(reasons))


def with_origin(fetched: Fetched) -> DataFrame:
    return fetched.df.withColumn("origen", F.lit(fetched.origen))


def cache_snapshot(df: DataFrame, cache_path: str, version: str, write=None) -> DataFrame:
    """Write ``df``, positions included, as a new copy of the cached sheet
    and read it back. Readers see it once :func:`switch_cache` names it. ``write(rows, path)``
    may do the writing."""
    spark, path = df.sparkSession, f"{cache_path.rstrip('/')}/{version}"
    if write is None:
        with_row_position(df).write.mode("errorifexists").parquet(path)
    else:
        write(with_row_position(df), path)
    return spark.read.parquet(path)


def switch_cache(spark: SparkSession, cache_path: str, version: str) -> None:
    """Make a written copy the cached sheet, in one rename; the copies before
    the last one go."""
    base = cache_path.rstrip("/")
    before = (read_text(spark, f"{base}/{CURRENT_COPY}") or "").strip()
    write_text(spark, f"{base}/{CURRENT_COPY}", version, replace=True)
    for name in list_dir(spark, base):
        if not name.startswith(("_", ".")) and name not in (version, before):
            fs, jpath = _fs(spark, f"{base}/{name}")
            fs.delete(jpath, True)
