"""Column contracts, Spark types and the fixed texts of the data contract.

Everything here is a plain constant: the report and verdict texts are part of
the output (dashboards and tests compare them), so they must stay byte-equal.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Bump when a gate rule changes: a new version forces a full re-run even when
# the input fingerprint is unchanged.
RULE_VERSION = 5

# --- column contracts -------------------------------------------------------

# Text sheets: the source line of a record that does not parse, else null.
BAD_RECORD = "_registro_ilegible"
REQUIRED_COLUMNS = (
    "pedido_id", "fecha", "cliente", "producto",
    "cantidad", "precio_unitario", "importe",
)
OPTIONAL_COLUMNS = ("comercial", "zona", "tipo_cliente", "familia")
TEXT_COLUMNS = (
    "pedido_id", "fecha", "comercial", "zona", "cliente",
    "tipo_cliente", "producto", "familia",
)
NUMBER_COLUMNS = ("cantidad", "precio_unitario", "importe")
# The 11 source columns, in sheet order (raw landing table).
SOURCE_COLUMNS = (
    "pedido_id", "fecha", "comercial", "zona", "cliente", "tipo_cliente",
    "producto", "familia", "cantidad", "precio_unitario", "importe",
)
# Columns whose blanks are labelled by the gate (zona is deliberately not).
BLANK_LABEL_COLUMNS = ("comercial", "tipo_cliente", "familia")
# Columns the explorer's free-text search looks into.
SEARCH_COLUMNS = ("cliente", "producto", "pedido_id", "comercial")

ROW_POSITION = "fila_origen"

# Gate input, after typing.
DIRTY_SCHEMA = T.StructType([
    T.StructField("fila_origen", T.LongType()),
    T.StructField("pedido_id", T.StringType()),
    T.StructField("fecha", T.StringType()),
    T.StructField("comercial", T.StringType()),
    T.StructField("zona", T.StringType()),
    T.StructField("cliente", T.StringType()),
    T.StructField("tipo_cliente", T.StringType()),
    T.StructField("producto", T.StringType()),
    T.StructField("familia", T.StringType()),
    T.StructField("cantidad", T.DoubleType()),
    T.StructField("precio_unitario", T.DoubleType()),
    T.StructField("importe", T.DoubleType()),
])

# Gate output (clean table as stored by the refresh job).
CLEAN_SCHEMA = T.StructType([
    T.StructField("fila_origen", T.LongType()),
    T.StructField("pedido_id", T.StringType()),
    T.StructField("fecha", T.TimestampNTZType()),
    T.StructField("comercial", T.StringType()),
    T.StructField("zona", T.StringType()),
    T.StructField("cliente", T.StringType()),
    T.StructField("tipo_cliente", T.StringType()),
    T.StructField("producto", T.StringType()),
    T.StructField("familia", T.StringType()),
    T.StructField("cantidad", T.DoubleType()),
    T.StructField("precio_unitario", T.DoubleType()),
    T.StructField("importe", T.DoubleType()),
    T.StructField("es_devolucion", T.BooleanType()),
    T.StructField("sospechoso", T.BooleanType()),
])

# Published (typed, constrained) clean table.
PUBLISHED_SCHEMA = T.StructType([
    T.StructField("pedido_id", T.StringType()),
    T.StructField("fecha", T.DateType()),
    T.StructField("comercial", T.StringType()),
    T.StructField("zona", T.StringType()),
    T.StructField("cliente", T.StringType()),
    T.StructField("tipo_cliente", T.StringType()),
    T.StructField("producto", T.StringType()),
    T.StructField("familia", T.StringType()),
    T.StructField("cantidad", T.DecimalType(14, 3)),
    T.StructField("precio_unitario", T.DecimalType(14, 2)),
    T.StructField("importe", T.DecimalType(18, 2)),
    T.StructField("fila_origen", T.LongType()),
    T.StructField("es_devolucion", T.BooleanType()),
    T.StructField("sospechoso", T.BooleanType()),
    T.StructField("sync_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

INCIDENT_TYPE = T.StructType([
    T.StructField("regla", T.StringType()),
    T.StructField("filas", T.LongType()),
    T.StructField("accion", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("origen", T.StringType()),
    T.StructField("huella", T.StringType()),
    T.StructField("filas_crudas", T.LongType()),
    T.StructField("filas_limpias", T.LongType()),
    T.StructField("facturacion_cruda", T.DecimalType(18, 2)),
    T.StructField("facturacion_limpia", T.DecimalType(18, 2)),
    T.StructField("incidencias", T.ArrayType(INCIDENT_TYPE)),
    T.StructField("estado", T.StringType()),
    T.StructField("mensaje", T.StringType()),
    T.StructField("version_puerta", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("dataset_key", T.StringType()),
    T.StructField("ultima_huella", T.StringType()),
    T.StructField("ultima_ejecucion_id", T.StringType()),
    T.StructField("ultima_sincronizacion", T.TimestampType()),
    T.StructField("ultima_comprobacion", T.TimestampType()),
    T.StructField("ultimo_estado", T.StringType()),
    T.StructField("ultimo_error", T.StringType()),
    T.StructField("version_puerta", T.IntegerType()),
    T.StructField("filas_crudas", T.LongType()),
    T.StructField("filas_limpias", T.LongType()),
    T.StructField("hoy", T.DateType()),
    T.StructField("fechas_futuras", T.LongType()),
    T.StructField("origen_dato", T.StringType()),       # source, cache or reference
    T.StructField("dato_de", T.TimestampType()),        # when that copy of the data was read from its source
    T.StructField("aviso", T.StringType()),
    T.StructField("fact_limpio", T.LongType()),
    T.StructField("updated_at", T.TimestampType()),
])

DATASET_KEY = "ventas"
STATE_ERROR_CHARS = 2000      # fixed value: the state keeps this much of an error; the run log keeps all

# --- fixed values: texts of the data contract (must match byte for byte) ----

BLANK_LABEL = "(sin informar)"

VERDICT_PASS = "PASA la puerta"
VERDICT_DUPLICATE = "DESCARTADA · pedido_id repetido (ya existe una fila con ese número)"
VERDICT_BAD_DATE = "DESCARTADA · fecha vacía o ilegible"
VERDICT_FUTURE = "DESCARTADA · fecha posterior a hoy ({hoy})"
VERDICT_MISMATCH = "DESCARTADA · importe ≠ cantidad × precio"
VERDICT_BAD_RECORD = "DESCARTADA · registro ilegible"
VERDICT_ZERO = "DESCARTADA · importe a cero"

RULE_SPELLINGS = "Cliente escrito de N maneras"
ACTION_SPELLINGS = "unificados: {antes} grafías → {despues} clientes reales"
RULE_DUPLICATES = "Pedidos duplicados"
ACTION_DUPLICATES = "descartados (se queda el primero)"
RULE_BAD_DATE = "Fecha vacía o ilegible"
ACTION_BAD_DATE = "descartadas: sin fecha no se puede situar el pedido en el tiempo"
RULE_FUTURE = "Fechas posteriores a hoy"
ACTION_FUTURE = "descartadas: un pedido con fecha futura ({hoy}) no existe"
RULE_MISMATCH = "Importe ≠ cantidad × precio"
ACTION_MISMATCH = "descartadas: no sabemos cuál de los 3 campos miente"
RULE_ZERO = "Importe a cero"
ACTION_ZERO = "descartadas (¿muestras? ¿filas sin acabar?)"
RULE_RETURNS = "Cantidades negativas"
ACTION_RETURNS = "MARCADAS como devolución — restan de la facturación, no se borran"
RULE_FLAGGED = "Pedidos anómalos (>5× el percentil 99,9)"
ACTION_FLAGGED = "SEÑALADOS, no borrados — que lo mire un humano"
RULE_BLANKS = "Huecos en «{columna}»"
ACTION_BLANKS = "etiquetados «(sin informar)» — se ven en el gráfico"
# Ours (not in the original report): text that is not a number in a number
# column, so the null pass-through is visible.
RULE_BAD_NUMBER = "Número ilegible"
ACTION_BAD_NUMBER = "convertido a vacío: la fila sigue su curso y lo cuenta esta línea"
RULE_BAD_RECORD = "Registro ilegible"
ACTION_BAD_RECORD = "descartado: la línea del fichero no tiene la forma de la hoja"
RULE_BEYOND = "Importe fuera de rango"
ACTION_BEYOND = "no suma en ningún total: ningún importe real tiene tantas cifras"
RULE_QUARANTINE = "Cuarentena: {restriccion}"
ACTION_QUARANTINE = "apartadas: pasan la puerta pero no se pueden publicar"

# --- fixed values: thresholds of the rules ----------------------------------

AMOUNT_TOLERANCE = 0.02        # |importe - cantidad*precio| above this is a mismatch
OUTLIER_QUANTILE = 0.999       # quantile of non-return amounts
OUTLIER_FACTOR = 5.0           # flagged above factor * quantile
RETURNS_ALERT_PCT = 3.0        # dashboard alert when returns exceed this % of gross

# --- fixed values: rankings (dimension, column, size) -----------------------

RANKINGS = (
    ("familia", "familia", 8),
    ("producto", "producto", 10),
    ("comercial", "comercial", 8),
    ("zona", "zona", 8),
    ("tipo", "tipo_cliente", 8),
    ("clientes", "cliente", 10),
)
RANKING_COLUMN = {name: column for name, column, _ in RANKINGS}
RANKING_SIZE = {name: size for name, _, size in RANKINGS}

# Explorer paging.
PAGE_DEFAULT = 25
PAGE_MAX = 200
MARKS = ("senalados", "devoluciones", "sin_senalados")

# Staging retention for the publish step.
RETENTION_DAYS = 7
