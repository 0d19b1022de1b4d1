"""Registry of queries: name -> ``f(spark, sf_dir) -> DataFrame``.

Every query reads the testdata tables, derives the dirty order sheet with
Spark, runs the gate and answers one operator of the inventory. Only the
outlier threshold is computed eagerly (and memoised per session and input);
the rest is one lazy plan per query.

Output convention (shared with :mod:`ordergate.plans.oracle`): dates and
timestamps as ISO text, decimals as double, integers as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordergate import schema as S
from ordergate.operators import checks, dashboard as D, explorer as E, metrics as M, report as R
from ordergate.operators.gate import (GateResult, VERDICT, canonical_names, name_map, run_gate,
                                      spelling_counts, spellings)
from ordergate.plans import params as P
from ordergate.sources.sheet import with_row_position
from ordergate.sources.testdata import dirty_orders

_GATES: dict[tuple, GateResult] = {}


def gate_of(spark: SparkSession, sf_dir: str, hoy: str = P.HOY) -> GateResult:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), hoy)
    if key not in _GATES:
        _GATES[key] = run_gate(orders_of(spark, sf_dir), hoy, eager_counts=False,
                               materialize=True)
    return _GATES[key]


def present(df: DataFrame) -> DataFrame:
    """Registry output types: ISO text dates, double money, BIGINT integers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = lambda spark, sf_dir, _fn=fn: present(_fn(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        return fn
    return deco


def _clean(spark, sf):
    return gate_of(spark, sf).clean


def _verdicts(spark, sf):
    return gate_of(spark, sf).verdicts


VERDICT_COLS = [S.ROW_POSITION, "pedido_id", VERDICT]

# ------------------------------------------------------------------ sources


_SHEETS: dict[tuple, str] = {}


def sheet_of(spark: SparkSession, sf: str) -> str:
    """The dirty sheet written once per session and input, as an export of one tab."""
    import uuid
    from ordergate.session import work_dir
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _SHEETS:
        path = work_dir(spark, "registro", uuid.uuid4().hex, "hoja")
        dirty_orders(spark, sf).write.option("compression", "zstd").parquet(f"{path}/Pedidos")
        _SHEETS[key] = path
    return _SHEETS[key]


def orders_of(spark: SparkSession, sf: str) -> DataFrame:
    """The dirty sheet's rows, from its export: the joins behind it run once, however often it is read."""
    return spark.read.parquet(f"{sheet_of(spark, sf)}/Pedidos")


@register("src_orders")
def _src_orders(spark, sf):
    """The order sheet, read back from its export."""
    from ordergate.sources.sheet import read_orders
    return read_orders(spark, sheet_of(spark, sf))


@register("src_row_position")
def _src_row_position(spark, sf):
    """S3: input position of each line of a Parquet source without one."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return with_row_position(li, from_files=True)


def text_sheet(spark: SparkSession, sf: str, name: str, write) -> str:
    """A text export written once per session and input; ``write`` gets its path."""
    import uuid
    from ordergate.session import work_dir
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _SHEETS:
        path = work_dir(spark, "registro", uuid.uuid4().hex, name)
        write(path)
        _SHEETS[key] = path
    return _SHEETS[key]


@register("src_row_position_csv")
def _src_row_position_csv(spark, sf):
    """S3: input position of each line of a CSV export without one, cut into
    splits by the engine."""
    from ordergate.sources.sheet import read_orders
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    path = text_sheet(spark, sf, "lineas", lambda p: li.write.option("header", "true").csv(p))
    placed = with_row_position(read_orders(spark, path, "csv"))
    return placed.select(*[F.col(f.name).cast(f.dataType) for f in li.schema.fields], S.ROW_POSITION)


CUT_EVERY = 97     # every such position of the JSON export is a line that was cut off


@register("src_unparsed")
def _src_unparsed(spark, sf):
    """Rows per verdict of a JSON export with cut lines, which get a reason of their own."""
    from ordergate.operators.gate import verdicts
    from ordergate.sources.sheet import read_orders
    rows = orders_of(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    cut = F.when(F.col(S.ROW_POSITION) % CUT_EVERY == 0, F.substring(line, 1, 40)).otherwise(line)
    path = text_sheet(spark, sf, "cortado", lambda p: rows.select(cut.alias("value")).write.option("compression", "gzip").text(p))
    return R.verdict_summary(verdicts(read_orders(spark, path, "json"), P.HOY))


# ------------------------------------------------------------------ gate


@register("customer_key")
def _customer_key(spark, sf):
    """G1: customer key of every distinct spelling."""
    return spellings(gate_of(spark, sf).verdicts.select("cliente")).select("cliente", "clave")


@register("customer_canonical")
def _customer_canonical(spark, sf):
    """Canonical name per key."""
    return canonical_names(spellings(gate_of(spark, sf).verdicts.select("cliente")))


@register("orders_canonical")
def _orders_canonical(spark, sf):
    """Every raw row with its canonical customer name."""
    v = _verdicts(spark, sf)
    names = name_map(spellings(v.select("cliente"))).select("cliente", "canonico")
    return (v.select(S.ROW_POSITION, "cliente").join(names, "cliente", "left")
             .select(S.ROW_POSITION, F.col("cliente").alias("cliente_original"),
                     F.col("canonico").alias("cliente")))


@register("customer_spellings")
def _customer_spellings(spark, sf):
    """Spellings, real customers, and spellings unified."""
    c = spelling_counts(spellings(_verdicts(spark, sf).select("cliente")))
    return c.withColumn("unificadas", F.col("grafias") - F.col("clientes"))


@register("verdicts")
def _verdicts_q(spark, sf):
    """Every raw row with its verdict."""
    return _verdicts(spark, sf).select(*VERDICT_COLS)


def _rule(text):
    def q(spark, sf):
        v = _verdicts(spark, sf)
        return v.where(F.col(VERDICT) == F.lit(text)).select(*VERDICT_COLS)
    return q


@register("gate_duplicates_anywhere")
def _gate_duplicates_anywhere(spark, sf):
    """Duplicates of the sheet dealt anew over many partitions, every line twice: rows equal in every cell
    are told apart by number alone."""
    from ordergate.operators.gate import verdicts
    sheet = orders_of(spark, sf)
    v = verdicts(sheet.unionByName(sheet).repartition(64), P.HOY)
    return v.groupBy(S.ROW_POSITION, "pedido_id", VERDICT).agg(F.count(F.lit(1)).alias("filas"))


for _name, _text in (("gate_duplicates", S.VERDICT_DUPLICATE),
                     ("gate_bad_date", S.VERDICT_BAD_DATE),
                     ("gate_future", S.VERDICT_FUTURE.format(hoy=P.HOY)),
                     ("gate_mismatch", S.VERDICT_MISMATCH),
                     ("gate_zero", S.VERDICT_ZERO)):
    register(_name)(_rule(_text))


@register("gate_clean")
def _gate_clean(spark, sf):
    """The clean table (flagship)."""
    return _clean(spark, sf)


@register("gate_returns")
def _gate_returns(spark, sf):
    """Lines marked as returns."""
    return (_clean(spark, sf).where(F.col("es_devolucion"))
            .select(S.ROW_POSITION, "pedido_id", "cantidad", "importe"))


@register("outlier_threshold")
def _outlier_threshold(spark, sf):
    """p99.9 of passing non-return amounts and the flag limit."""
    g = gate_of(spark, sf)
    thr = F.lit(g.threshold).cast("double")
    return (g.verdicts.agg(F.count(F.lit(1)).alias("_n"))
             .select(F.round(thr, 4).alias("umbral"),
                     F.round(thr * S.OUTLIER_FACTOR, 4).alias("limite")))


@register("gate_flagged")
def _gate_flagged(spark, sf):
    """Lines flagged as outliers (kept in the table)."""
    return _clean(spark, sf).where(F.col("sospechoso")).select(S.ROW_POSITION, "pedido_id", "importe")


@register("gate_blanks")
def _gate_blanks(spark, sf):
    """Blanks per labelled column among passing rows."""
    passing = F.col(VERDICT) == S.VERDICT_PASS
    row = _verdicts(spark, sf).agg(*[F.count_if(passing & F.col(c).isNull()).alias(c)
                                     for c in S.BLANK_LABEL_COLUMNS])
    spec = ", ".join(f"'{c}', {c}" for c in S.BLANK_LABEL_COLUMNS)
    return row.select(F.expr(f"stack({len(S.BLANK_LABEL_COLUMNS)}, {spec}) as (columna, huecos)"))


@register("gate_ordered")
def _gate_ordered(spark, sf):
    """Position of each clean line in (fecha, pedido_id) order."""
    from ordergate.plans.storage import ordered_position
    keys = [F.col("fecha").asc_nulls_last(), F.col("pedido_id").asc_nulls_last()]
    return ordered_position(_clean(spark, sf), keys).select(
        S.ROW_POSITION, "pedido_id", "posicion")


# ------------------------------------------------------------------ report


@register("incidents")
def _incidents(spark, sf):
    """The incident report."""
    return R.incidents(gate_of(spark, sf))


@register("conservation")
def _conservation(spark, sf):
    """Every row that left is counted."""
    return R.conservation(gate_of(spark, sf))


@register("verdict_summary")
def _verdict_summary(spark, sf):
    """Rows per verdict."""
    return R.verdict_summary(_verdicts(spark, sf))


@register("verdict_lookup")
def _verdict_lookup(spark, sf):
    """I4: verdict of one order id (case-insensitive)."""
    return R.verdict_lookup(_verdicts(spark, sf), P.LOOKUP_ID).select(*VERDICT_COLS, "fecha")


@register("verdict_newest")
def _verdict_newest(spark, sf):
    """Newest 15 lines (unreadable dates first)."""
    return R.verdict_newest(_verdicts(spark, sf)).select(*VERDICT_COLS, "fecha", "posicion")


@register("verdict_newest_discarded")
def _verdict_newest_discarded(spark, sf):
    """Newest 15 discarded lines."""
    return R.verdict_newest(_verdicts(spark, sf), discarded_only=True).select(
        *VERDICT_COLS, "fecha", "posicion")


@register("mismatch_explained")
def _mismatch_explained(spark, sf):
    """Expected amount and difference of mismatching lines."""
    return R.mismatch_explained(_verdicts(spark, sf))


@register("run_summary")
def _run_summary(spark, sf):
    """Raw vs clean summary."""
    return R.run_summary(gate_of(spark, sf))


@register("quality_header")
def _quality_header(spark, sf):
    """I8: header of the quality panel."""
    return R.quality_header(R.run_summary(gate_of(spark, sf)))


# ------------------------------------------------------------------ metrics


@register("metric_base")
def _metric_base(spark, sf):
    """M1: lines counted by the metrics."""
    return M.metric_base(_clean(spark, sf)).select(S.ROW_POSITION, "importe")


for _name, _dim in (("top_family", "familia"), ("top_product", "producto"), ("top_rep", "comercial"),
                    ("top_zone", "zona"), ("top_customer_type", "tipo"), ("top_customer", "clientes")):
    register(_name)(lambda spark, sf, _d=_dim: M.top(_clean(spark, sf), _d))


@register("top_all")
def _top_all(spark, sf):
    """M2: the six rankings in one pass."""
    return M.top_all(_clean(spark, sf))


@register("top_share")
def _top_share(spark, sf):
    """M9: share and bar width of the product ranking."""
    return M.top_share(M.top(_clean(spark, sf), "producto"))


@register("monthly_series")
def _monthly_series(spark, sf):
    """M3: monthly amount and orders."""
    return M.monthly_series(_clean(spark, sf))


@register("date_range")
def _date_range(spark, sf):
    """M8: first and last day of the metric base."""
    return M.date_range(M.metric_base(_clean(spark, sf)))


@register("kpi_bounds")
def _kpi_bounds(spark, sf):
    """M4: default KPI window."""
    base = M.metric_base(_clean(spark, sf))
    hasta = F.to_date(F.max("fecha"))
    return base.agg(F.add_months(hasta, -12).alias("desde"), hasta.alias("hasta"))


@register("kpi_default")
def _kpi_default(spark, sf):
    """M5: KPIs of the last 12 months."""
    return M.kpis(_clean(spark, sf))


@register("kpi_window")
def _kpi_window(spark, sf):
    """M5: KPIs of a given window."""
    return M.kpis(_clean(spark, sf), P.KPI_DESDE, P.KPI_HASTA)


@register("kpi_variation")
def _kpi_variation(spark, sf):
    """M6: current vs previous window."""
    base = M.metric_base(_clean(spark, sf))
    k = M.kpi_frame(base, M.kpi_bounds(base))
    fact, prev = F.col("facturacion").cast("double"), F.col("facturacion_anterior").cast("double")
    return k.select(fact.alias("facturacion_actual"), prev.alias("facturacion_anterior"),
                    "pedidos", F.col("pedidos_anterior"),
                    F.when((F.col("pedidos_anterior") > 0) & (prev != 0),
                           F.bround((fact / prev - 1) * 100, 1)).alias("var_pct"))


@register("kpi_empty")
def _kpi_empty(spark, sf):
    """M7: KPIs of an empty base (no line is after the cut-off)."""
    clean = _clean(spark, sf)
    empty = clean.where(F.to_date("fecha") > F.lit(P.HOY).cast("date"))
    return M.kpis(empty)


@register("kpi_alert")
def _kpi_alert(spark, sf):
    """Returns alert on the default KPIs."""
    return M.kpi_alert(M.kpis(_clean(spark, sf)))


# ------------------------------------------------------------------ explorer

def _page(**kw):
    return lambda spark, sf: E.page(_clean(spark, sf), E.Query(**kw))


for _name, _kw in (
        ("explore_flagged", dict(marca="senalados", limite=200)),
        ("explore_returns", dict(marca="devoluciones")),
        ("explore_unflagged", dict(marca="sin_senalados")),
        ("explore_dates", dict(desde=P.EXPLORE_DESDE, hasta=P.EXPLORE_HASTA, limite=200)),
        ("explore_rep", dict(comercial=P.EXPLORE_REP)),
        ("explore_search", dict(q=P.EXPLORE_SEARCH)),
        ("explore_by_date", dict(orden="fecha")),
        ("explore_by_entry", dict(orden="registro")),
        ("explore_page1", dict(comercial=P.EXPLORE_REP, limite=50, offset=0)),
        ("explore_page2", dict(comercial=P.EXPLORE_REP, limite=50, offset=50)),
        ("explore_rows", dict(limite=200))):
    register(_name)(_page(**_kw))


@register("explore_totals")
def _explore_totals(spark, sf):
    """E5: totals of the filtered set."""
    q = E.Query(q=P.EXPLORE_TOTALS_SEARCH, marca="sin_senalados")
    return E.totals(E.filtered(_clean(spark, sf), q))


@register("explore_caption")
def _explore_caption(spark, sf):
    """The caption under the explorer table."""
    q = E.Query(comercial=P.EXPLORE_REP)
    return E.caption(E.totals(E.filtered(_clean(spark, sf), q)), q)


# ------------------------------------------------------------------ dashboard


@register("dash_filtered")
def _dash_filtered(spark, sf):
    """Filtered base."""
    return D.dash_filtered(_clean(spark, sf), P.DASH_FILTERS).select(S.ROW_POSITION, "importe")


@register("dash_bounds")
def _dash_bounds(spark, sf):
    """Bounds of the filtered base."""
    return D.dash_bounds(_clean(spark, sf), P.DASH_FILTERS)


@register("dash_windows")
def _dash_windows(spark, sf):
    """D3: current and previous sets."""
    return D.dash_windows(_clean(spark, sf), P.DASH_FILTERS)


@register("dash_kpis")
def _dash_kpis(spark, sf):
    """KPI row with a customer-type filter."""
    return D.dash_kpis(_clean(spark, sf), P.DASH_FILTERS)


@register("dash_kpis_all")
def _dash_kpis_all(spark, sf):
    """KPI row without filters."""
    return D.dash_kpis(_clean(spark, sf), P.NO_FILTERS)


@register("dash_monthly")
def _dash_monthly(spark, sf):
    """Monthly series in the window."""
    return D.dash_monthly(_clean(spark, sf), P.DASH_FILTERS)


for _name, _dim in (("dash_top_family", "familia"), ("dash_top_product", "producto"),
                    ("dash_top_rep", "comercial"), ("dash_top_zone", "zona"),
                    ("dash_top_type", "tipo"), ("dash_top_customer", "clientes")):
    register(_name)(lambda spark, sf, _d=_dim: D.dash_top(_clean(spark, sf), P.DASH_FILTERS, _d))


@register("dash_json")
def _dash_json(spark, sf):
    """The summary as one JSON document."""
    return D.dash_json(_clean(spark, sf), P.DASH_FILTERS)


_ROLLUPS: dict[tuple, str] = {}


def rollup_of(spark: SparkSession, sf: str):
    """The rollup of the clean table, written once per session and input."""
    import uuid
    from ordergate.operators import rollup
    from ordergate.session import work_dir
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _ROLLUPS:
        path = work_dir(spark, "registro", uuid.uuid4().hex, "rollup")
        rollup.save(rollup.build(_clean(spark, sf)), path)
        _ROLLUPS[key] = path
    return rollup.load(spark, _ROLLUPS[key])


def _rolled(name, *args, **kwargs):
    def query(spark, sf):
        from ordergate.operators import rollup
        return getattr(rollup, name)(rollup_of(spark, sf), *args, **kwargs)
    query.__doc__ = f"The rollup's answer to {name}, equal to that of the order lines."
    return query


for _name, _query in (("rollup_kpis", _rolled("kpis")), ("rollup_kpis_window", _rolled("kpis", P.KPI_DESDE, P.KPI_HASTA)),
                      ("rollup_monthly", _rolled("monthly_series")), ("rollup_dash_kpis", _rolled("dash_kpis", P.DASH_FILTERS)),
                      ("rollup_dash_kpis_all", _rolled("dash_kpis", P.NO_FILTERS)),
                      ("rollup_dash_kpis_filtered", _rolled("dash_kpis", P.DASH_ALL_FILTERS)),
                      ("rollup_dash_monthly", _rolled("dash_monthly", P.DASH_FILTERS)),
                      ("rollup_dash_top_product", _rolled("dash_top", P.DASH_FILTERS, "producto")),
                      ("rollup_dash_top_customer", _rolled("dash_top", P.DASH_FILTERS, "clientes")),
                      ("rollup_dash_top_zone", _rolled("dash_top", P.DASH_FILTERS, "zona"))):
    register(_name)(_query)


_INDEXED: dict[tuple, str] = {}


def indexed_of(spark: SparkSession, sf: str, layout: str = "fecha"):
    """The clean table with its file index, written once per session, input and layout."""
    import uuid
    from ordergate.plans import fileindex
    from ordergate.session import work_dir
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), layout)
    if key not in _INDEXED:
        path = work_dir(spark, "registro", uuid.uuid4().hex, f"indexado-{layout}")
        fileindex.save(_clean(spark, sf), path, layout, at_least=P.INDEX_FILES)
        _INDEXED[key] = path
    return fileindex.load(spark, _INDEXED[key])


def _indexed(name, *args, layout="fecha", **kwargs):
    def query(spark, sf):
        from ordergate.plans import fileindex
        return getattr(fileindex, name)(indexed_of(spark, sf, layout), *args, **kwargs)
    query.__doc__ = f"{name} from the files that the index does not rule out, equal to that of the whole table."
    return query


for _name, _query in (("indexed_search", _indexed("page", E.Query(q=P.EXPLORE_SEARCH))),
                      ("indexed_search_id", _indexed("page", E.Query(q=P.LOOKUP_ID))),
                      ("indexed_totals", _indexed("totals", E.Query(q=P.EXPLORE_TOTALS_SEARCH, marca="sin_senalados"))),
                      ("indexed_totals_all", _indexed("totals", E.Query())),
                      ("indexed_deep", _indexed("page", E.Query(limite=P.DEEP_LIMIT, offset=P.DEEP_OFFSET))),
                      ("indexed_deep_entry", _indexed("page", E.Query(limite=P.DEEP_LIMIT, offset=P.DEEP_OFFSET, orden="registro"))),
                      ("indexed_dash_orders", _indexed("page", P.DASH_ORDERS_ALL, layout="filtros", by_day=True)),
                      ("indexed_date_range", _indexed("date_range"))):
    register(_name)(_query)


@register("indexed_dash_filtered")
def _indexed_dash_filtered(spark, sf):
    """D1 with all four category filters, from the files of the several-filter layout that can hold such rows."""
    from ordergate.plans import fileindex
    return fileindex.dash_filtered(indexed_of(spark, sf, "filtros"), P.DASH_ALL_FILTERS).select(S.ROW_POSITION, "importe")


@register("dash_filter_values")
def _dash_filter_values(spark, sf):
    """Values for the four filter lists and the date range."""
    return D.dash_filter_values(_clean(spark, sf))


@register("dash_orders")
def _dash_orders(spark, sf):
    """Paged orders with rep and family filters."""
    return D.dash_orders(_clean(spark, sf),
                         E.Query(comercial=P.DASH_ORDERS_REP, familia=P.DASH_ORDERS_FAMILY))


@register("dash_orders_totals")
def _dash_orders_totals(spark, sf):
    """The page's head with all four category filters and dates."""
    return D.dash_orders_totals(_clean(spark, sf), P.DASH_ORDERS_ALL)


@register("dash_orders_filtered")
def _dash_orders_filtered(spark, sf):
    """A later page with zone and type filters, dates, and newest entries first."""
    return D.dash_orders(_clean(spark, sf), P.DASH_ORDERS_ALL)


@register("dash_kpis_filtered")
def _dash_kpis_filtered(spark, sf):
    """All four category filters and explicit dates."""
    return D.dash_kpis(_clean(spark, sf), P.DASH_ALL_FILTERS)


@register("dash_kpis_none")
def _dash_kpis_none(spark, sf):
    """A filter that nothing passes."""
    return D.dash_kpis(_clean(spark, sf), P.DASH_NO_MATCH)


@register("explore_deep")
def _explore_deep(spark, sf):
    """A page deep in the list."""
    return E.page(_clean(spark, sf), E.Query(limite=P.DEEP_LIMIT, offset=P.DEEP_OFFSET))


@register("explore_deep_entry")
def _explore_deep_entry(spark, sf):
    """A deep page in entry order."""
    return E.page(_clean(spark, sf), E.Query(limite=P.DEEP_LIMIT, offset=P.DEEP_OFFSET, orden="registro"))


# ------------------------------------------------------------------ checks


@register("constraint_violations")
def _constraint_violations(spark, sf):
    """Constraint checks on the typed projection."""
    from ordergate.plans.publish import clean_typed
    return checks.constraint_violations(clean_typed(_clean(spark, sf), P.SYNC_ID))


@register("invariants")
def _invariants(spark, sf):
    """Invariants of the clean table."""
    return checks.invariants(_clean(spark, sf), P.HOY)


@register("clean_typed")
def _clean_typed(spark, sf):
    """The typed projection that is published."""
    from ordergate.plans.publish import clean_typed
    return clean_typed(_clean(spark, sf), P.SYNC_ID)


# ------------------------------------------------------------------ refresh / publish

@register("quality_report")
def _quality_report(spark, sf):
    """The run row as stored (summary + incident list)."""
    g = gate_of(spark, sf)
    inc = R.incidents(g).agg(F.sort_array(F.collect_list(F.struct("orden", "regla", "filas", "accion")))
                             .alias("l"))
    inc = inc.select(F.to_json(F.transform("l", lambda x: F.struct(
        x["regla"].alias("regla"), x["filas"].alias("filas"), x["accion"].alias("accion"))))
        .alias("incidencias"))
    return R.run_summary(g).crossJoin(inc).select(
        "filas_crudas", "filas_limpias", "facturacion_cruda", "facturacion_limpia", "incidencias",
        F.lit(S.RULE_VERSION).cast("bigint").alias("version_puerta"))


@register("raw_landing")
def _raw_landing(spark, sf):
    """Raw landing rows (text columns + JSON payload)."""
    from ordergate.plans.publish import raw_landing
    return raw_landing(orders_of(spark, sf), P.SYNC_ID)


@register("fingerprint")
def _fingerprint(spark, sf):
    """The content fingerprint is the same for the same rows in other
    partitions, and another one if a cell, a position or a null changes."""
    from ordergate.plans.refresh import fingerprint
    from ordergate.plans.storage import partitions_for
    raw = orders_of(spark, sf)
    least = raw.agg(F.min(S.ROW_POSITION)).first()[0]
    first = F.col(S.ROW_POSITION) == F.lit(least)
    variants = {"igual": raw.repartition(max(7, partitions_for(raw)), "pedido_id"),
                "celda": raw.withColumn("importe", F.when(first, F.coalesce(F.col("importe"), F.lit(0.0)) + 1).otherwise(F.col("importe"))),
                "posicion": raw.withColumn(S.ROW_POSITION, F.when(first, F.col(S.ROW_POSITION) - 1).otherwise(F.col(S.ROW_POSITION))),
                "vacio": raw.withColumn("zona", F.coalesce(F.col("zona"), F.lit("")))}
    out = fingerprint(raw).select(F.col("huella").alias("h"), "filas")
    for name, df in variants.items():
        out = out.crossJoin(fingerprint(df).select(F.col("huella").alias(name)))   # one row each
    return out.select("filas", *[(F.col(n) == F.col("h")).alias(n) for n in variants])


@register("refresh_delta")
def _refresh_delta(spark, sf):
    """C4: what changed since the run with the previous cut-off."""
    from ordergate.plans.refresh import delta
    now = R.run_summary(gate_of(spark, sf, P.HOY))
    before = R.run_summary(gate_of(spark, sf, P.HOY_ANTERIOR))
    return delta(now, before)


_HISTORIES: dict[tuple, str] = {}
_STAGED: dict[tuple, dict] = {}
_SAVED: dict[tuple, str] = {}


def history_of(spark: SparkSession, sf: str) -> str:
    """The root of a refresh history on the shared folder, run once per session/input: refused
    by the strict checks, quarantined first load, unchanged re-run, primary source
    lost (cache), forced re-run."""
    import uuid
    from ordergate.plans import publish as PB
    from ordergate.plans.refresh import refresh
    from ordergate.session import work_dir
    from ordergate.sources.sheet import Source
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key in _HISTORIES:
        return _HISTORIES[key]
    root = work_dir(spark, "registro", uuid.uuid4().hex)
    pub = f"{root}/pub"
    primary, cache = Source("source", sheet_of(spark, sf)), Source("cache", f"{pub}/cache")
    lost = Source("source", f"{root}/no-such-sheet")
    try:
        refresh(spark, [primary, cache], pub, P.HOY)
    except PB.PublishError:
        pass                                  # its run is in the log
    for sources, forced in (([primary, cache], False), ([primary, cache], False), ([lost, cache], False),
                            ([primary, cache], True)):
        refresh(spark, sources, pub, P.HOY, forzar=forced, quarantine=True)
    _HISTORIES[key] = pub
    return pub


def staged_of(spark: SparkSession, sf: str) -> dict:
    """The paths of a raw landing and a clean table staged once per session/input, not published."""
    import uuid
    from ordergate.plans import publish as PB
    from ordergate.session import work_dir
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _STAGED:
        root = work_dir(spark, "registro", uuid.uuid4().hex, "staged")
        _STAGED[key] = PB.stage(PB.raw_landing(orders_of(spark, sf), P.SYNC_ID), _clean(spark, sf), root, P.SYNC_ID,
                                shape=lambda df: PB.clean_typed(df, P.SYNC_ID))
    return _STAGED[key]


def saved_of(spark: SparkSession, sf: str) -> str:
    """The clean table saved once per session/input."""
    import uuid
    from ordergate.session import work_dir
    from ordergate.sources.tables import save_clean
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _SAVED:
        path = work_dir(spark, "registro", uuid.uuid4().hex, "limpio")
        save_clean(_clean(spark, sf), path)
        _SAVED[key] = path
    return _SAVED[key]


def _history(spark, sf) -> DataFrame:
    """The run log in order, without generated ids and times."""
    from ordergate.plans.publish import read_runs
    runs = read_runs(spark, history_of(spark, sf))
    # A handful of runs.
    w = Window.orderBy("started_at")
    return runs.withColumn("orden", F.row_number().over(w))


@register("run_log")
def _run_log(spark, sf):
    """The run log of the refresh history."""
    return _history(spark, sf).select("orden", "origen", "estado", "filas_crudas", "filas_limpias",
                                      "facturacion_cruda", "facturacion_limpia", "version_puerta",
                                      F.coalesce(F.size("incidencias"), F.lit(0)).alias("lineas"))


@register("state_read")
def _state_read(spark, sf):
    """The state row after the refresh history, without generated ids and times."""
    from ordergate.plans.publish import read_state_frame
    return read_state_frame(spark, history_of(spark, sf)).select(
        "dataset_key", "ultimo_estado", "ultimo_error", "version_puerta", "filas_crudas", "filas_limpias", "fact_limpio",
        "hoy", "fechas_futuras", "origen_dato", "aviso")


@register("refresh_unchanged")
def _refresh_unchanged(spark, sf):
    """Runs that were skipped because nothing changed: same fingerprint as the load before."""
    h = _history(spark, sf)
    loaded = h.where("estado = 'ok'").select(F.col("huella").alias("_h")).distinct()
    return h.where("estado = 'unchanged'").join(loaded, h["huella"] == loaded["_h"], "left").select(
        "orden", "estado", F.col("_h").isNotNull().alias("misma_huella"))


@register("refresh_outcome")
def _refresh_outcome(spark, sf):
    """Outcome class of each run of the history."""
    return _history(spark, sf).select("orden", "estado", F.split("mensaje", ":")[0].alias("resultado"))


@register("publish_conservation")
def _publish_conservation(spark, sf):
    """Every raw row of the published version is published, discarded or quarantined."""
    from ordergate.plans.publish import current_pointer
    from ordergate.plans.storage import at_once
    sheet_of(spark, sf)          # both read it
    # The gate fills the cores that the small jobs of the history leave idle.
    pub, rows = at_once(spark, lambda: history_of(spark, sf), lambda: _verdicts(spark, sf))
    ptr = current_pointer(spark, pub)
    one = [spark.read.parquet(ptr["raw"]).agg(F.count("*").alias("crudas")),
           spark.read.parquet(ptr["clean"]).agg(F.count("*").alias("publicadas")),
           spark.read.parquet(f"{pub}/quarantine/sync_id={ptr['sync_id']}").agg(F.count("*").alias("cuarentena")),
           rows.agg(F.count_if(F.col(VERDICT) != S.VERDICT_PASS).alias("descartadas"))]
    row = one[0].crossJoin(one[1]).crossJoin(one[2]).crossJoin(one[3])
    return row.withColumn("cuadra", F.col("crudas") == F.col("publicadas") + F.col("cuarentena") + F.col("descartadas"))


@register("publish_staged")
def _publish_staged(spark, sf):
    """The staged clean table, read back."""
    return spark.read.parquet(staged_of(spark, sf)["clean"]).drop("created_at", "updated_at")


@register("publish_current")
def _publish_current(spark, sf):
    """The clean table the current pointer names (rows breaking a
    constraint were quarantined; the generated sync id is left out)."""
    from ordergate.plans.publish import load_current
    return load_current(spark, history_of(spark, sf)).drop("sync_id", "created_at", "updated_at")


@register("dash_quality")
def _dash_quality(spark, sf):
    """The two documents the dashboard reads, without generated ids and times."""
    from ordergate.plans.publish import read_runs, read_state_frame
    pub = history_of(spark, sf)
    docs = D.dash_quality(read_runs(spark, pub), read_state_frame(spark, pub))
    def of(doc, name):
        return F.get_json_object(doc, f"$.{name}")
    return docs.select(
        F.array_join(F.json_object_keys("sync"), ",").alias("sync_claves"),
        F.array_join(F.json_object_keys("calidad"), ",").alias("calidad_claves"),
        of("sync", "estado").alias("sync_estado"), of("sync", "filas_limpias").cast("bigint").alias("sync_limpias"),
        of("calidad", "estado").alias("calidad_estado"), of("calidad", "filas_crudas").cast("bigint").alias("calidad_crudas"),
        of("calidad", "facturacion_limpia").cast("double").alias("calidad_facturacion"))


@register("load_clean")
def _load_clean(spark, sf):
    """The saved clean table, read back with its schema."""
    from ordergate.sources.tables import load_clean
    return load_clean(spark, saved_of(spark, sf))


@register("save_clean_roundtrip")
def _save_clean_roundtrip(spark, sf):
    """Save then load gives the same table, in the layout for several filters too."""
    return indexed_of(spark, sf, "filtros").rows


@register("src_fallback")
def _src_fallback(spark, sf):
    """First readable source meeting the contract (primary missing,
    a table without the columns, then the sheet)."""
    from ordergate.sources.sheet import Source, first_available, with_origin
    sheet = sheet_of(spark, sf)
    fetched = first_available(spark, [Source("source", f"{sheet}/no-such-sheet"),
                                      Source("cache", f"{sf}/orders.parquet"),
                                      Source("reference", f"{sheet}/Pedidos")])
    return with_origin(fetched)
