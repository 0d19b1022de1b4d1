"""Reference SQL (DuckDB dialect) for every registered query.

Each string recomputes the whole gate from the testdata tables with plain
SQL -- window ``row_number`` for duplicates, ``quantile_cont`` for the
threshold, ``strip_accents`` for the customer key -- an independent route to
the same answers the Spark jobs give.

Presentation convention shared with the Spark side: dates and timestamps
are ISO text, money is double, counts and positions are BIGINT.
"""

from __future__ import annotations

from ordergate import schema as S
from ordergate.plans import params as P
from ordergate.sources.testdata import dirty_sql_duckdb


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


HOY = P.HOY
PASS = q(S.VERDICT_PASS)

# The gate in SQL, as CTEs: dirty -> typed -> verdicts -> names -> clean.
GATE = rf"""
with dirty as ({dirty_sql_duckdb()}),
typed as (
  select fila_origen, pedido_id,
    case when regexp_full_match(trim(fecha),
           '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,6}})?)?)?')
         then try_cast(trim(fecha) as timestamp) end as fecha,
    comercial, zona, cliente, tipo_cliente, producto, familia,
    case when isnan(cantidad) then null else cantidad end as cantidad,
    case when isnan(precio_unitario) then null else precio_unitario end as precio_unitario,
    case when isnan(importe) then null else importe end as importe
  from dirty),
ranked as (
  select *, row_number() over (partition by pedido_id order by fila_origen) > 1 as dup from typed),
verdicts as (
  select *, case
    when dup then {q(S.VERDICT_DUPLICATE)}
    when fecha is null then {q(S.VERDICT_BAD_DATE)}
    when cast(fecha as date) > date '{HOY}' then {q(S.VERDICT_FUTURE.format(hoy=HOY))}
    when coalesce(abs(importe - cantidad * precio_unitario) > 0.02, false) then {q(S.VERDICT_MISMATCH)}
    when coalesce(importe = 0, false) then {q(S.VERDICT_ZERO)}
    else {PASS} end as veredicto
  from ranked),
spell as (
  select cliente, count(*) as n,
    upper(trim(regexp_replace(regexp_replace(strip_accents(trim(cliente)),
      '[^\x00-\x7F]|\.', '', 'g'), '\s+', ' ', 'g'))) as clave
  from typed where cliente is not null group by cliente),
pairs as (select clave, trim(cliente) as recortado, sum(n) as n from spell group by clave, trim(cliente)),
canon as (
  select clave, recortado as canonico from (
    select *, row_number() over (partition by clave order by n desc, recortado) as rk from pairs)
  where rk = 1),
names as (select s.cliente, s.clave, c.canonico from spell s join canon c using (clave)),
passing as (select * from verdicts where veredicto = {PASS}),
thr as (
  select case when count(*) = 0 then 0.0 else quantile_cont(importe, 0.999) end as p
  from passing where not coalesce(cantidad < 0, false)),
clean as (
  select v.fila_origen, v.pedido_id, v.fecha,
    coalesce(v.comercial, '(sin informar)') as comercial, v.zona, n.canonico as cliente,
    coalesce(v.tipo_cliente, '(sin informar)') as tipo_cliente, v.producto,
    coalesce(v.familia, '(sin informar)') as familia,
    v.cantidad, v.precio_unitario, v.importe,
    coalesce(v.cantidad < 0, false) as es_devolucion,
    (not coalesce(v.cantidad < 0, false)) and coalesce(v.importe > thr.p * 5, false) as sospechoso
  from passing v left join names n on v.cliente = n.cliente cross join thr),
base as (select * from clean where not sospechoso)"""


def gate(select: str, *extra: str) -> str:
    """Gate CTEs + optional extra CTEs + final select."""
    ctes = "".join(f",\n{e}" for e in extra)
    return f"{GATE}{ctes}\n{select}"


TS = "strftime(fecha, '%Y-%m-%d %H:%M:%S')"
DAY = "strftime(fecha, '%Y-%m-%d')"
MONEY = "cast(importe as decimal(18,2))"
CLEAN_COLS = (f"fila_origen, pedido_id, {TS} as fecha, comercial, zona, cliente, tipo_cliente, "
              "producto, familia, cantidad, precio_unitario, importe, es_devolucion, sospechoso")
VERDICT_COLS = "fila_origen, pedido_id, veredicto"


def _top(col: str, n: int, where: str = "true") -> str:
    return gate(f"""select nombre, cast(round_even(s, 0) as bigint) as importe, posicion from (
  select {col} as nombre, sum({MONEY}) as s,
         row_number() over (order by sum({MONEY}) desc, {col}) as posicion
  from base where {col} is not null and {where} group by {col}) where posicion <= {n}""")


def _top_all() -> str:
    unions = " union all ".join(
        f"select '{name}' as dimension, {col} as nombre, importe from base"
        for name, col, _ in S.RANKINGS)
    sizes = " ".join(f"when '{name}' then {n}" for name, _, n in S.RANKINGS)
    return gate(f"""select dimension, nombre, cast(round_even(s, 0) as bigint) as importe, posicion from (
  select dimension, nombre, sum({MONEY}) as s,
         row_number() over (partition by dimension order by sum({MONEY}) desc, nombre) as posicion
  from long where nombre is not null group by dimension, nombre)
where posicion <= case dimension {sizes} end""", f"long as ({unions})")


# KPI window CTEs over ``base`` (v1) given optional fixed bounds.
def _kpi_ctes(desde: str | None, hasta: str | None, source: str = "base") -> list[str]:
    h = f"date '{hasta}'" if hasta else f"(select max(fecha)::date from {source})"
    d = f"date '{desde}'" if desde else "cast(hasta - interval '12 months' as date)"
    return [
        f"b1 as (select {h} as hasta)",
        f"b2 as (select {d} as desde, hasta from b1)",
        "bounds as (select desde, hasta, desde - cast(hasta - desde as integer) as prev_start from b2)",
        f"""k as (select
    coalesce(sum({MONEY}) filter (where cast(fecha as date) between desde and hasta), 0) as fact,
    count(*) filter (where cast(fecha as date) between desde and hasta) as pedidos,
    coalesce(sum({MONEY}) filter (where cast(fecha as date) between desde and hasta and not es_devolucion), 0) as bruta,
    count(importe) filter (where cast(fecha as date) between desde and hasta and not es_devolucion) as n_ventas,
    count(*) filter (where cast(fecha as date) between desde and hasta and not es_devolucion) as filas_ventas,
    count(distinct cliente) filter (where cast(fecha as date) between desde and hasta) as clientes,
    coalesce(-sum({MONEY}) filter (where cast(fecha as date) between desde and hasta and es_devolucion), 0) as dev,
    count(*) filter (where cast(fecha as date) >= prev_start and cast(fecha as date) < desde) as pedidos_ant,
    coalesce(sum({MONEY}) filter (where cast(fecha as date) >= prev_start and cast(fecha as date) < desde), 0) as fact_ant,
    (select desde from bounds) as desde, (select hasta from bounds) as hasta
  from {source} cross join bounds)""",
    ]


KPI_V1 = """select cast(round_even(fact, 0) as bigint) as facturacion,
  case when pedidos_ant > 0 and fact_ant <> 0
       then round_even((cast(fact as double) / cast(fact_ant as double) - 1) * 100, 1) end as var_pct,
  pedidos,
  case when n_ventas > 0 then cast(round_even(bruta / n_ventas, 0) as bigint)
       when filas_ventas > 0 then null else 0 end as ticket,
  clientes, cast(round_even(dev, 0) as bigint) as devoluciones,
  case when bruta <> 0 then round_even(cast(dev as double) / cast(bruta as double) * 100, 1) else 0.0 end as dev_pct,
  cast(desde as varchar) as desde, cast(hasta as varchar) as hasta"""

KPI_V2 = """select cast(round(fact, 0) as bigint) as facturacion,
  case when fact_ant = 0 then null
       else round((cast(fact as double) / cast(fact_ant as double) - 1) * 100, 1) end as var_pct,
  pedidos,
  coalesce(cast(round(bruta / nullif(n_ventas, 0), 0) as bigint), 0) as ticket,
  clientes, cast(round(dev, 0) as bigint) as devoluciones,
  case when bruta = 0 then 0.0 else round(cast(dev as double) / cast(bruta as double) * 100, 1) end as dev_pct,
  cast(desde as varchar) as desde, cast(hasta as varchar) as hasta"""


def _explore(where: str, order: str, limit: int, offset: int, source: str = "clean",
             day: bool = False) -> str:
    return gate(f"""select pedido_id, {DAY} as fecha, comercial, zona, cliente, tipo_cliente,
  producto, familia, cantidad, round(precio_unitario, 2) as precio, round(importe, 2) as importe,
  es_devolucion as devolucion, sospechoso as senalado, fila_origen, posicion from (
  select *, row_number() over (order by {order}) as posicion from {source} where {where})
where posicion > {offset} and posicion <= {offset + limit}""")


ORDER_FECHA = "fecha desc nulls last, fila_origen desc, pedido_id desc"
ORDER_REGISTRO = "fila_origen desc, pedido_id desc"
ORDER_DIA = "cast(fecha as date) desc nulls last, fila_origen desc, pedido_id desc"


def _search(needle: str) -> str:
    n = q(needle.strip().lower())
    return "(" + " or ".join(
        f"coalesce(contains(lower({c}), {n}), false)" for c in S.SEARCH_COLUMNS) + ")"


def _dash_base(f) -> str:
    conds = ["true"]
    for col in ("comercial", "zona", "familia", "tipo_cliente"):
        val = getattr(f, col)
        if val:
            conds.append(f"{col} = {q(val)}")
    return f"dbase as (select * from base where {' and '.join(conds)})"


def _dash_ctes(f) -> list[str]:
    return [_dash_base(f), *_kpi_ctes(P.as_text(f.desde), P.as_text(f.hasta), source="dbase")]


def _dash_rankings(f) -> str:
    unions = " union all ".join(
        f"select '{name}' as dimension, {col if col != 'zona' else 'coalesce(zona, ' + q(S.BLANK_LABEL) + ')'}"
        f" as nombre, importe from cur" for name, col, _ in S.RANKINGS)
    sizes = " ".join(f"when '{name}' then {n}" for name, _, n in S.RANKINGS)
    return (f"""ranks as (select dimension, nombre, cast(round(s, 0) as bigint) as importe, posicion from (
  select dimension, nombre, sum({MONEY}) as s,
         row_number() over (partition by dimension order by sum({MONEY}) desc, nombre nulls last) as posicion
  from long group by dimension, nombre)
where posicion <= case dimension {sizes} end)""",
            f"long as ({unions})",
            "cur as (select dbase.* from dbase cross join bounds "
            "where cast(fecha as date) between desde and hasta)")


def build() -> dict[str, str]:
    """Oracle SQL per query name."""
    o: dict[str, str] = {}
    # ---- sources
    o["src_orders"] = gate("select * from dirty")
    o["src_row_position"] = ("select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, "
                             "row_number() over () - 1 as fila_origen from lineitem")
    o["src_row_position_csv"] = o["src_row_position"]
    # Cut lines hold no id and no position: they leave before ids are compared.
    o["src_unparsed"] = gate("select veredicto, count(*) as filas from v2 group by veredicto",
                             f"""r2 as (select *, fila_origen % 97 = 0 as cortada,
    row_number() over (partition by pedido_id, fila_origen % 97 = 0 order by fila_origen) > 1 as dup2 from typed),
v2 as (select case when cortada then {q(S.VERDICT_BAD_RECORD)} when dup2 then {q(S.VERDICT_DUPLICATE)}
    when fecha is null then {q(S.VERDICT_BAD_DATE)}
    when cast(fecha as date) > date '{HOY}' then {q(S.VERDICT_FUTURE.format(hoy=HOY))}
    when coalesce(abs(importe - cantidad * precio_unitario) > 0.02, false) then {q(S.VERDICT_MISMATCH)}
    when coalesce(importe = 0, false) then {q(S.VERDICT_ZERO)} else {PASS} end as veredicto from r2)""")
    o["gate_duplicates_anywhere"] = gate(f"""select fila_origen, pedido_id, veredicto, count(*) as filas from (
  select fila_origen, pedido_id, veredicto from verdicts
  union all select fila_origen, pedido_id, {q(S.VERDICT_DUPLICATE)} from verdicts) group by all""")
    o["load_clean"] = gate(f"select {CLEAN_COLS} from clean")
    o["save_clean_roundtrip"] = o["load_clean"]
    o["clean_typed"] = gate(f"""select pedido_id, {DAY} as fecha, comercial, zona, cliente,
  tipo_cliente, producto, familia,
  cast(cast(cantidad as decimal(14,3)) as double) as cantidad,
  cast(cast(precio_unitario as decimal(14,2)) as double) as precio_unitario,
  cast(cast(importe as decimal(18,2)) as double) as importe,
  fila_origen, es_devolucion, sospechoso, {q(P.SYNC_ID)} as sync_id from clean""")
    # ---- gate: customers
    o["customer_key"] = gate("select cliente, clave from spell")
    o["customer_canonical"] = gate("select clave, canonico from canon")
    o["orders_canonical"] = gate(
        "select t.fila_origen, t.cliente as cliente_original, n.canonico as cliente "
        "from typed t left join names n on t.cliente = n.cliente")
    o["customer_spellings"] = gate(
        "select count(*) as grafias, count(distinct clave) as clientes, "
        "count(*) - count(distinct clave) as unificadas from spell")
    # ---- gate: verdict chain
    o["verdicts"] = gate(f"select {VERDICT_COLS} from verdicts")
    for name, text in (("gate_duplicates", S.VERDICT_DUPLICATE),
                       ("gate_bad_date", S.VERDICT_BAD_DATE),
                       ("gate_future", S.VERDICT_FUTURE.format(hoy=HOY)),
                       ("gate_mismatch", S.VERDICT_MISMATCH),
                       ("gate_zero", S.VERDICT_ZERO)):
        o[name] = gate(f"select {VERDICT_COLS} from verdicts where veredicto = {q(text)}")
    o["gate_clean"] = gate(f"select {CLEAN_COLS} from clean")
    o["gate_returns"] = gate(
        "select fila_origen, pedido_id, cantidad, importe from clean where es_devolucion")
    o["outlier_threshold"] = gate(
        "select round(p, 4) as umbral, round(p * 5, 4) as limite from thr")
    o["gate_flagged"] = gate("select fila_origen, pedido_id, importe from clean where sospechoso")
    o["gate_blanks"] = gate(
        "select * from (select 'comercial' as columna, count(*) filter (where comercial is null) as huecos from passing "
        "union all select 'tipo_cliente', count(*) filter (where tipo_cliente is null) from passing "
        "union all select 'familia', count(*) filter (where familia is null) from passing)")
    o["gate_ordered"] = gate(
        "select fila_origen, pedido_id, row_number() over (order by fecha, pedido_id) - 1 as posicion from clean")
    # ---- report
    o["verdict_summary"] = gate("select veredicto, count(*) as filas from verdicts group by veredicto")
    o["verdict_lookup"] = gate(f"select {VERDICT_COLS}, {TS} as fecha from verdicts "
                               f"where lower(pedido_id) = {q(P.LOOKUP_ID.lower())}")
    newest = ("select {cols}, row_number() over (order by fecha desc nulls first, fila_origen desc) as posicion "
              "from verdicts {where} order by fecha desc nulls first, fila_origen desc limit 15")
    o["verdict_newest"] = gate(newest.format(cols=VERDICT_COLS + f", {TS} as fecha", where=""))
    o["verdict_newest_discarded"] = gate(newest.format(
        cols=VERDICT_COLS + f", {TS} as fecha", where=f"where veredicto <> {PASS}"))
    o["mismatch_explained"] = gate(f"""select fila_origen, pedido_id, cantidad, precio_unitario, importe,
  round_even(cantidad * precio_unitario, 2) as esperado,
  round_even(importe - round_even(cantidad * precio_unitario, 2), 2) as diferencia
  from verdicts where veredicto = {q(S.VERDICT_MISMATCH)}""")
    summary = f"""summary as (select
  (select count(*) from verdicts) as filas_crudas,
  (select count(*) from base) as filas_limpias,
  (select count(*) from clean) as filas_publicadas,
  (select coalesce(sum({MONEY}), 0) from verdicts) as cruda,
  (select coalesce(sum({MONEY}), 0) from base) as limpia)"""
    o["run_summary"] = gate("""select filas_crudas, filas_limpias, filas_publicadas,
  cast(cruda as double) as facturacion_cruda, cast(limpia as double) as facturacion_limpia,
  cast(round_even(cruda, 0) as bigint) as fact_crudo, cast(round_even(limpia, 0) as bigint) as fact_limpio
  from summary""", summary)
    o["quality_header"] = gate("""select filas_crudas, filas_limpias, fact_crudo, fact_limpio,
  fact_crudo - fact_limpio as diferencia,
  round(cast(fact_crudo - fact_limpio as double) / nullif(cast(fact_crudo as double), 0) * 100, 1) as diferencia_pct,
  filas_crudas - filas_publicadas as descartadas_puerta, filas_publicadas - filas_limpias as senaladas,
  filas_crudas - filas_limpias as descartadas_mostradas
  from (select *, cast(round_even(cruda, 0) as bigint) as fact_crudo,
               cast(round_even(limpia, 0) as bigint) as fact_limpio from summary)""", summary)
    # ---- incidents / conservation
    o["incidents"] = gate(_incidents_select(), *_incident_ctes())
    o["conservation"] = gate("""select crudas, limpias, descartadas, crudas - limpias = descartadas as cuadra from (
  select count(*) as crudas, count(*) filter (where veredicto = 'PASA la puerta') as limpias,
         count(*) filter (where veredicto <> 'PASA la puerta') as descartadas from verdicts)""")
    # ---- metrics
    o["metric_base"] = gate("select fila_origen, importe from base")
    for key, dim in (("top_family", "familia"), ("top_product", "producto"), ("top_rep", "comercial"),
                     ("top_zone", "zona"), ("top_customer_type", "tipo"), ("top_customer", "clientes")):
        o[key] = _top(S.RANKING_COLUMN[dim], S.RANKING_SIZE[dim])
    o["top_all"] = _top_all()
    o["top_share"] = _top_share()
    o["monthly_series"] = gate(f"""select strftime(fecha, '%Y-%m') as mes,
  cast(round_even(sum({MONEY}), 0) as bigint) as importe, count(pedido_id) as pedidos
  from base group by strftime(fecha, '%Y-%m')""")
    o["date_range"] = gate("select strftime(min(fecha), '%Y-%m-%d') as desde, "
                           "strftime(max(fecha), '%Y-%m-%d') as hasta from base")
    o["kpi_bounds"] = gate("select cast(desde as varchar) as desde, cast(hasta as varchar) as hasta from b2",
                           *_kpi_ctes(None, None)[:2])
    o["kpi_default"] = gate(f"{KPI_V1} from k", *_kpi_ctes(None, None))
    o["kpi_window"] = gate(f"{KPI_V1} from k", *_kpi_ctes(P.KPI_DESDE, P.KPI_HASTA))
    o["kpi_variation"] = gate("""select cast(fact as double) as facturacion_actual,
  cast(fact_ant as double) as facturacion_anterior, pedidos, pedidos_ant as pedidos_anterior,
  case when pedidos_ant > 0 and fact_ant <> 0
       then round_even((cast(fact as double) / cast(fact_ant as double) - 1) * 100, 1) end as var_pct
  from k""", *_kpi_ctes(None, None))
    o["kpi_empty"] = gate(f"{KPI_V1} from k",
                          f"empty as (select * from base where cast(fecha as date) > date '{HOY}')",
                          *_kpi_ctes(None, None, source="empty"))
    o["kpi_alert"] = gate(f"select *, dev_pct > {S.RETURNS_ALERT_PCT} as alerta_devoluciones from ({KPI_V1} from k)",
                          *_kpi_ctes(None, None))
    # ---- explorer
    o["explore_flagged"] = _explore("sospechoso", ORDER_FECHA, 200, 0)
    o["explore_returns"] = _explore("es_devolucion", ORDER_FECHA, 25, 0)
    o["explore_unflagged"] = _explore("not sospechoso", ORDER_FECHA, 25, 0)
    o["explore_dates"] = _explore(
        f"cast(fecha as date) between date '{P.EXPLORE_DESDE}' and date '{P.EXPLORE_HASTA}'",
        ORDER_FECHA, 200, 0)
    o["explore_rep"] = _explore(f"comercial = {q(P.EXPLORE_REP)}", ORDER_FECHA, 25, 0)
    o["explore_search"] = _explore(_search(P.EXPLORE_SEARCH), ORDER_FECHA, 25, 0)
    o["explore_totals"] = gate(f"""select count(*) as total,
  cast(round_even(coalesce(sum({MONEY}), 0), 0) as bigint) as importe
  from clean where not sospechoso and {_search(P.EXPLORE_TOTALS_SEARCH)}""")
    o["explore_by_date"] = _explore("true", ORDER_FECHA, 25, 0)
    o["explore_by_entry"] = _explore("true", ORDER_REGISTRO, 25, 0)
    o["explore_page1"] = _explore(f"comercial = {q(P.EXPLORE_REP)}", ORDER_FECHA, 50, 0)
    o["explore_page2"] = _explore(f"comercial = {q(P.EXPLORE_REP)}", ORDER_FECHA, 50, 50)
    o["explore_rows"] = _explore("true", ORDER_FECHA, 200, 0)
    o["explore_caption"] = gate(f"""select total, importe,
  case when total > 0 then 1 else 0 end::bigint as desde_fila, least(25, total)::bigint as hasta_fila,
  concat(case when total > 0 then 1 else 0 end, '–', least(25, total), ' de ', total, ' · ', importe, ' €') as texto
  from (select count(*) as total, cast(round_even(coalesce(sum({MONEY}), 0), 0) as bigint) as importe
        from clean where comercial = {q(P.EXPLORE_REP)})""")
    # ---- dashboard
    f = P.DASH_FILTERS
    o["dash_filtered"] = gate("select fila_origen, importe from dbase", _dash_base(f))
    o["dash_bounds"] = gate("""select strftime(min(fecha), '%Y-%m-%d') as fecha_minima,
  strftime(max(fecha), '%Y-%m-%d') as fecha_maxima,
  (select cast(desde as varchar) from b2) as desde, (select cast(hasta as varchar) from b2) as hasta
  from dbase""", *_dash_ctes(f)[:3])
    o["dash_windows"] = gate("""select pedidos as filas_actual, cast(fact as double) as importe_actual,
  pedidos_ant as filas_anterior, cast(fact_ant as double) as importe_anterior,
  cast(desde as varchar) as desde, cast(hasta as varchar) as hasta from k""", *_dash_ctes(f))
    o["dash_kpis"] = gate(f"{KPI_V2} from k", *_dash_ctes(f))
    o["dash_kpis_all"] = gate(f"{KPI_V2} from k", *_dash_ctes(P.NO_FILTERS))
    o["dash_monthly"] = gate(f"""select strftime(fecha, '%Y-%m') as mes,
  cast(round(sum({MONEY}), 0) as bigint) as facturacion, count(*) as pedidos
  from dbase cross join bounds where cast(fecha as date) between desde and hasta
  group by strftime(fecha, '%Y-%m')""", *_dash_ctes(f))
    for key, dim in (("dash_top_family", "familia"), ("dash_top_product", "producto"),
                     ("dash_top_rep", "comercial"), ("dash_top_zone", "zona"),
                     ("dash_top_type", "tipo"), ("dash_top_customer", "clientes")):
        o[key] = gate(f"select nombre, importe, posicion from ranks where dimension = '{dim}'",
                      *_dash_ctes(f), *reversed(_dash_rankings(f)))
    tops = ", ".join(
        f"'{name}': coalesce((select list({{'nombre': nombre, 'importe': importe}} order by posicion) "
        f"from ranks where dimension = '{name}'), [])" for name, _, _ in S.RANKINGS)
    o["dash_json"] = gate(f"""select cast(to_json({{
  'kpis': (select {{'facturacion': facturacion, 'var_pct': var_pct, 'pedidos': pedidos, 'ticket': ticket,
                   'clientes': clientes, 'devoluciones': devoluciones, 'dev_pct': dev_pct,
                   'desde': desde, 'hasta': hasta}} from kv),
  'rango_total': (select [cast(min(fecha) as date), cast(max(fecha) as date)] from dbase),
  'mes': coalesce((select list({{'mes': mes, 'facturacion': facturacion, 'pedidos': pedidos}} order by mes)
                   from mensual), []),
  {tops}}}) as varchar) as resumen""", *_dash_ctes(f), *reversed(_dash_rankings(f)),
        KPI_V2.replace("cast(desde as varchar) as desde, cast(hasta as varchar) as hasta",
                       "desde, hasta").replace("select ", "kv as (select ", 1) + " from k)",
        f"""mensual as (select strftime(fecha, '%Y-%m') as mes,
  cast(round(sum({MONEY}), 0) as bigint) as facturacion, count(*) as pedidos
  from dbase cross join bounds where cast(fecha as date) between desde and hasta
  group by strftime(fecha, '%Y-%m'))""")
    o["dash_filter_values"] = gate("""select distinct lista, valor from (
    select 'comerciales' as lista, comercial as valor from base
    union all select 'zonas', zona from base
    union all select 'familias', familia from base
    union all select 'tipos_cliente', tipo_cliente from base
    union all select 'rango_desde', strftime(min(fecha), '%Y-%m-%d') from base
    union all select 'rango_hasta', strftime(max(fecha), '%Y-%m-%d') from base) where valor is not null""")
    o["dash_orders"] = _explore(
        f"comercial = {q(P.DASH_ORDERS_REP)} and familia = {q(P.DASH_ORDERS_FAMILY)}",
        ORDER_DIA, 25, 0)
    dq = P.DASH_ORDERS_ALL
    dwhere = (f"comercial = {q(dq.comercial)} and zona = {q(dq.zona)} and familia = {q(dq.familia)} "
              f"and tipo_cliente = {q(dq.tipo_cliente)} "
              f"and cast(fecha as date) between date '{dq.desde}' and date '{dq.hasta}'")
    o["dash_orders_filtered"] = _explore(dwhere, ORDER_REGISTRO, dq.limite, dq.offset)
    o["dash_orders_totals"] = gate(f"""select count(*) as total, cast({dq.offset} as bigint) as "offset",
  cast({dq.limite} as bigint) as limite, 'registro' as orden,
  cast(round(coalesce(sum({MONEY}), 0), 0) as bigint) as importe from clean where {dwhere}""")
    o["dash_kpis_filtered"] = gate(f"{KPI_V2} from k", *_dash_ctes(P.DASH_ALL_FILTERS))
    o["dash_kpis_none"] = gate(f"{KPI_V2} from k", *_dash_ctes(P.DASH_NO_MATCH))
    o["explore_deep"] = _explore("true", ORDER_FECHA, P.DEEP_LIMIT, P.DEEP_OFFSET)
    o["explore_deep_entry"] = _explore("true", ORDER_REGISTRO, P.DEEP_LIMIT, P.DEEP_OFFSET)
    # ---- checks
    o["constraint_violations"] = _constraints_select()
    o["invariants"] = gate(_invariants_select())
    # ---- refresh / publish
    o["refresh_delta"] = _refresh_delta()
    o["publish_staged"] = o["clean_typed"]
    o["src_fallback"] = gate("select *, 'reference' as origen from dirty")
    payload = ", ".join(f"{c} := {c}" for c in S.SOURCE_COLUMNS)
    texts = ", ".join(f"cast({c} as varchar) as {c}" for c in S.SOURCE_COLUMNS)
    o["raw_landing"] = gate(f"""select {q(P.SYNC_ID)} as sync_id, fila_origen, {texts},
  cast(to_json(struct_pack({payload})) as varchar) as raw_payload from dirty""")
    o["fingerprint"] = gate("select count(*) as filas, true as igual, false as celda, false as posicion, false as vacio from dirty")
    o["publish_current"] = gate(f"""select pedido_id, strftime(fecha, '%Y-%m-%d') as fecha, comercial, zona,
  cliente, tipo_cliente, producto, familia, cast(cantidad as double) as cantidad,
  cast(precio_unitario as double) as precio_unitario, cast(importe as double) as importe,
  fila_origen, es_devolucion, sospechoso from pub where {PUBLISHABLE}""", PUB)
    o["publish_conservation"] = gate(f"""select crudas, publicadas, cuarentena, descartadas,
  crudas = publicadas + cuarentena + descartadas as cuadra from (select
  (select count(*) from dirty) as crudas, (select count(*) from pub where {PUBLISHABLE}) as publicadas,
  (select count(*) from pub where not {PUBLISHABLE}) as cuarentena,
  (select count(*) from verdicts where veredicto <> {PASS}) as descartadas)""", PUB)
    # The history: refused, first load, unchanged, unchanged from the cache, forced.
    history = f"""hist as (select * from (values (1, 'error', false), (2, 'ok', true), (3, 'unchanged', true),
  (4, 'unchanged', true), (5, 'ok', true)) as t(orden, estado, contado)),
totals as (select (select count(*) from dirty) as crudas, (select count(*) from base) as limpias,
  (select cast(coalesce(sum({MONEY}), 0) as decimal(18,2)) from verdicts) as cruda,
  (select cast(coalesce(sum({MONEY}), 0) as decimal(18,2)) from base) as limpia),
broken as (select count(distinct razon) as n from (select case {_reasons()} end as razon from pub) where razon is not null)"""
    o["run_log"] = gate(f"""select cast(orden as bigint) as orden, 'manual' as origen, estado,
  case when contado then crudas else 0 end as filas_crudas, case when contado then limpias else 0 end as filas_limpias,
  case when estado = 'ok' then cast(cruda as double) end as facturacion_cruda,
  case when estado = 'ok' then cast(limpia as double) end as facturacion_limpia,
  cast({S.RULE_VERSION} as bigint) as version_puerta,
  case when estado = 'ok' then (select count(*) from inc) + (select n from broken) else 0 end as lineas
  from hist cross join totals""", PUB, history, *_incident_ctes(), f"inc as ({_incidents_select()})")
    o["state_read"] = gate(f"""select 'ventas' as dataset_key, 'ok' as ultimo_estado, cast(null as varchar) as ultimo_error,
  cast({S.RULE_VERSION} as bigint) as version_puerta, crudas as filas_crudas, limpias as filas_limpias,
  cast(round_even(limpia, 0) as bigint) as fact_limpio, '{HOY}' as hoy,
  (select count(*) from verdicts where veredicto = {q(S.VERDICT_FUTURE.format(hoy=HOY))}) as fechas_futuras,
  'source' as origen_dato, cast(null as varchar) as aviso from totals""", PUB, history)
    o["refresh_unchanged"] = gate("select cast(orden as bigint) as orden, estado, true as misma_huella from hist "
                                  "where estado = 'unchanged'", PUB, history)
    o["refresh_outcome"] = gate("""select cast(orden as bigint) as orden, estado,
  case orden when 1 then 'PublishError' when 2 then 'primera_carga' when 5 then 'dato_nuevo' else 'unchanged' end as resultado
  from hist""", PUB, history)
    o["dash_quality"] = gate("""select
  'estado,ultima_sincronizacion,ultima_comprobacion,version_puerta,filas_crudas,filas_limpias,ultimo_error' as sync_claves,
  'id,estado,origen,started_at,finished_at,filas_crudas,filas_limpias,facturacion_cruda,facturacion_limpia,incidencias,mensaje,version_puerta'
  as calidad_claves, 'ok' as sync_estado, limpias as sync_limpias, 'ok' as calidad_estado, crudas as calidad_crudas,
  cast(limpia as double) as calidad_facturacion from totals""", PUB, history)
    o["quality_report"] = gate(f"""select
  (select count(*) from verdicts) as filas_crudas, (select count(*) from base) as filas_limpias,
  (select cast(coalesce(sum({MONEY}), 0) as double) from verdicts) as facturacion_cruda,
  (select cast(coalesce(sum({MONEY}), 0) as double) from base) as facturacion_limpia,
  (select cast(to_json(list({{'regla': regla, 'filas': filas, 'accion': accion}} order by orden)) as varchar)
   from inc) as incidencias,
  cast({S.RULE_VERSION} as bigint) as version_puerta""", *_incident_ctes(), f"inc as ({_incidents_select()})")
    for rolled, lines in (("rollup_kpis", "kpi_default"), ("rollup_kpis_window", "kpi_window"), ("rollup_monthly", "monthly_series"),
                          ("rollup_dash_kpis", "dash_kpis"), ("rollup_dash_kpis_all", "dash_kpis_all"),
                          ("rollup_dash_kpis_filtered", "dash_kpis_filtered"), ("rollup_dash_monthly", "dash_monthly"),
                          ("rollup_dash_top_product", "dash_top_product"), ("rollup_dash_top_customer", "dash_top_customer"),
                          ("rollup_dash_top_zone", "dash_top_zone")):
        o[rolled] = o[lines]
    # ---- file index
    for indexed, whole in (("indexed_search", "explore_search"), ("indexed_totals", "explore_totals"), ("indexed_deep", "explore_deep"),
                           ("indexed_deep_entry", "explore_deep_entry"), ("indexed_dash_orders", "dash_orders_filtered"),
                           ("indexed_date_range", "date_range")):
        o[indexed] = o[whole]
    o["indexed_search_id"] = _explore(_search(P.LOOKUP_ID), ORDER_FECHA, 25, 0)
    o["indexed_totals_all"] = gate(f"""select count(*) as total,
  cast(round_even(coalesce(sum({MONEY}), 0), 0) as bigint) as importe from clean""")
    o["indexed_dash_filtered"] = gate("select fila_origen, importe from dbase", _dash_base(P.DASH_ALL_FILTERS))
    return o


def _top_share() -> str:
    col = S.RANKING_COLUMN["producto"]
    return gate(f"""select nombre, importe, posicion,
  round(try_divide_(importe, sum(importe) over ()) * 100, 1) as cuota_pct,
  round(try_divide_(importe, max(importe) over ()) * 100, 1) as barra_pct from (
  select nombre, cast(round_even(s, 0) as bigint) as importe, posicion from (
    select {col} as nombre, sum({MONEY}) as s,
           row_number() over (order by sum({MONEY}) desc, {col}) as posicion
    from base where {col} is not null group by {col}) where posicion <= 10)""").replace(
        "try_divide_(importe, sum(importe) over ())", "importe / nullif(sum(importe) over (), 0)").replace(
        "try_divide_(importe, max(importe) over ())", "importe / nullif(max(importe) over (), 0)")


def _incident_ctes() -> list[str]:
    return [f"""c as (select
  count(*) filter (where veredicto = {q(S.VERDICT_DUPLICATE)}) as duplicados,
  count(*) filter (where veredicto = {q(S.VERDICT_BAD_DATE)}) as fecha_ilegible,
  count(*) filter (where veredicto = {q(S.VERDICT_FUTURE.format(hoy=HOY))}) as fecha_futura,
  count(*) filter (where veredicto = {q(S.VERDICT_MISMATCH)}) as no_cuadra,
  count(*) filter (where veredicto = {q(S.VERDICT_ZERO)}) as importe_cero,
  count(*) filter (where veredicto = {PASS} and coalesce(cantidad < 0, false)) as devoluciones,
  count(*) filter (where veredicto = {PASS} and comercial is null) as huecos_comercial,
  count(*) filter (where veredicto = {PASS} and tipo_cliente is null) as huecos_tipo_cliente,
  count(*) filter (where veredicto = {PASS} and familia is null) as huecos_familia
  from verdicts)""",
            "sp as (select count(*) as grafias, count(distinct clave) as clientes from spell)",
            "fl as (select count(*) as senalados from clean where sospechoso)"]


def _incidents_select() -> str:
    hoy = HOY
    rows = [
        (1, S.RULE_SPELLINGS, "sp.grafias - sp.clientes",
         "concat('unificados: ', sp.grafias, ' grafías → ', sp.clientes, ' clientes reales')"),
        (2, S.RULE_DUPLICATES, "c.duplicados", q(S.ACTION_DUPLICATES)),
        (3, S.RULE_BAD_DATE, "c.fecha_ilegible", q(S.ACTION_BAD_DATE)),
        (4, S.RULE_FUTURE, "c.fecha_futura", q(S.ACTION_FUTURE.format(hoy=hoy))),
        (5, S.RULE_MISMATCH, "c.no_cuadra", q(S.ACTION_MISMATCH)),
        (6, S.RULE_ZERO, "c.importe_cero", q(S.ACTION_ZERO)),
        (7, S.RULE_RETURNS, "c.devoluciones", q(S.ACTION_RETURNS)),
        (8, S.RULE_FLAGGED, "fl.senalados", q(S.ACTION_FLAGGED)),
        (9, S.RULE_BLANKS.format(columna="comercial"), "c.huecos_comercial", q(S.ACTION_BLANKS)),
        (10, S.RULE_BLANKS.format(columna="tipo_cliente"), "c.huecos_tipo_cliente", q(S.ACTION_BLANKS)),
        (11, S.RULE_BLANKS.format(columna="familia"), "c.huecos_familia", q(S.ACTION_BLANKS)),
    ]
    body = " union all ".join(
        f"select cast({o} as bigint) as orden, {q(r)} as regla, cast({n} as bigint) as filas, {a} as accion "
        "from c cross join sp cross join fl" for o, r, n, a in rows)
    return f"select * from ({body}) where filas > 0"


PUB = """pub as (select pedido_id, cast(fecha as date) as fecha,
  coalesce(comercial, '(sin informar)') as comercial, zona, cliente,
  coalesce(tipo_cliente, '(sin informar)') as tipo_cliente, producto,
  coalesce(familia, '(sin informar)') as familia,
  cast(cantidad as decimal(14,3)) as cantidad, cast(precio_unitario as decimal(14,2)) as precio_unitario,
  cast(importe as decimal(18,2)) as importe, fila_origen, es_devolucion, sospechoso from clean)"""


PUBLISHABLE = """coalesce(pedido_id is not null and length(trim(pedido_id)) > 0 and fecha is not null
    and cliente is not null and producto is not null and cantidad is not null
    and precio_unitario is not null and importe is not null and importe <> 0
    and es_devolucion = (cantidad < 0) and abs(importe - cantidad * precio_unitario) <= 0.02, false)"""


def _reasons() -> str:
    """First broken constraint of a published row."""
    return " ".join(f"when coalesce({cond}, false) then '{name}'" for name, cond in _row_checks().items())


def _constraints_select() -> str:
    parts = [f"select '{n}' as restriccion, count(*) filter (where coalesce({c}, false)) as filas from pub"
             for n, c in _row_checks().items()]
    parts.append("select 'pedido_id_repetido', count(pedido_id) - count(distinct pedido_id) from pub")
    return gate("select * from (" + " union all ".join(parts) + ")", PUB)


def _row_checks() -> dict[str, str]:
    return {
        "pedido_id_nulo": "pedido_id is null",
        "pedido_id_vacio": "length(trim(pedido_id)) = 0",
        "fecha_nula": "fecha is null",
        "cliente_nulo": "cliente is null",
        "producto_nulo": "producto is null",
        "cantidad_nula": "cantidad is null",
        "precio_nulo": "precio_unitario is null",
        "importe_nulo": "importe is null",
        "importe_cero": "importe = 0",
        "devolucion_inconsistente": "es_devolucion <> (cantidad < 0)",
        "importe_inconsistente": "abs(importe - cantidad * precio_unitario) > 0.02",
    }


def _invariants_select() -> str:
    hoy = HOY
    parts = [
        "select 'pedidos_duplicados' as invariante, count(*) - count(distinct pedido_id) - "
        "(case when count(*) filter (where pedido_id is null) > 0 then 1 else 0 end) as filas_que_lo_rompen from clean",
        f"select 'fechas_futuras', count(*) filter (where cast(fecha as date) > date '{hoy}') from clean",
        "select 'importes_no_cuadran', count(*) filter (where coalesce(abs(importe - cantidad * precio_unitario) > 0.02, false)) from clean",
        "select 'importes_cero', count(*) filter (where coalesce(importe = 0, false)) from clean",
        "select 'claves_con_varios_nombres', count(*) from (select clave from (select distinct cliente from clean where cliente is not null) d "
        "join spell s using (cliente) group by clave having count(*) > 1)",
        "select 'nombres_sin_recortar', count(*) filter (where cliente <> trim(cliente)) from clean",
        "select 'huecos_sin_etiqueta', count(*) filter (where comercial is null or tipo_cliente is null or familia is null) from clean",
        "select 'neta_no_menor_que_bruta', case when count(*) filter (where es_devolucion) > 0 and "
        f"not (sum({MONEY}) < sum({MONEY}) filter (where not es_devolucion)) then 1 else 0 end from clean",
    ]
    return "select * from (" + " union all ".join(parts) + ")"


def _refresh_delta() -> str:
    """Delta between the run with cut-off HOY and the previous one (HOY_ANTERIOR)."""
    prev = GATE.replace(f"date '{HOY}'", f"date '{P.HOY_ANTERIOR}'").replace(
        S.VERDICT_FUTURE.format(hoy=HOY), S.VERDICT_FUTURE.format(hoy=P.HOY_ANTERIOR))
    # rename every CTE of the previous run so both chains live in one query
    names = ["dirty", "typed", "ranked", "verdicts", "spell", "pairs", "canon", "names",
             "passing", "thr", "clean", "base"]
    import re
    for n in names:
        prev = re.sub(rf"\b{n}\b", f"{n}_ant", prev)
    prev = prev.replace("with ", "", 1)
    return f"""{GATE},
{prev},
now_s as (select (select count(*) from verdicts) as crudas, (select count(*) from base) as limpias,
   (select coalesce(sum({MONEY}), 0) from base) as fact),
ant_s as (select (select count(*) from verdicts_ant) as crudas, (select count(*) from base_ant) as limpias,
   (select coalesce(sum({MONEY}), 0) from base_ant) as fact)
select n.crudas - a.crudas as crudas, n.limpias - a.limpias as limpias,
  cast(round_even(n.fact, 0) as bigint) - cast(round_even(a.fact, 0) as bigint) as fact_limpio
from now_s n cross join ant_s a"""
