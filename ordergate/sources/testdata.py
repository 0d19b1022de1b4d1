"""The dirty order sheet, derived deterministically from the testdata tables.

The original workbook is not available, so the order lines the gate works on
are built from ``lineitem`` and its dimensions with integer arithmetic: every
kind of dirt the gate must catch (repeated and missing ids, unreadable and
future dates, amounts that do not add up, zero amounts, returns, outliers,
blank labels, many spellings of one customer) appears at a fixed rate.

``dirty_orders`` is the Spark job; ``DIRTY_SQL`` is the same recipe as text
for the DuckDB oracle (``{fmt}`` is the date-to-text expression).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.plans.storage import by_size
from ordergate.sources.sheet import with_row_position

# Fixed value: the cut-off date used with the testdata (the newest ship date
# is 2001-11-04, so the future-date rule fires).
TESTDATA_TODAY = "2001-06-30"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BIGINT_MAX = (1 << 63) - 1
TRIED = 1000         # lines beyond BIGINT that are looked up in the dimensions before all of them are


def line_key(whole: str) -> Column:
    """The number ``k`` that decides which dirt a line gets, made of its four keys; ``whole`` is the type it is computed in."""
    return ((((F.col("l_orderkey").cast(whole) * 16 + F.col("l_linenumber")) * 100000
              + F.col("l_partkey")) * 10000) + F.col("l_suppkey"))


def _largest_key(li: DataFrame) -> tuple[int, int]:
    """Bounds of ``k`` and of the position ``k * 64 + quantity`` over all lines, from the largest of each of their parts."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ends = {c: F.col(c) for c in keys} | {"q": F.col("l_quantity").try_cast("bigint")}
    row = li.agg(*[end(x).alias(f"{c}_{end.__name__}") for c, x in ends.items() for end in (F.min, F.max)]).first()
    order, line, part, supplier, quantity = (max(abs(row[f"{c}_min"] or 0), abs(row[f"{c}_max"] or 0)) for c in ends)
    k = ((order * 16 + line) * 100000 + part) * 10000 + supplier
    return k, k * 64 + quantity


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the schema of :data:`ordergate.schema.DIRTY_SCHEMA`.

    ``fila_origen`` is ``k * 64 + quantity``. Where tables are so large that this leaves BIGINT for a line of the sheet (beyond
    9 million orders), it has no value there, and the lines' places in their files are the positions instead: as
    unique, and no sum of keys. ``k`` itself is computed as a decimal where BIGINT cannot hold it.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    part = _table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # Order lines are the large table. What can be joined without them is joined first (customers to their orders,
    # nations to suppliers), and lines meet the columns of parts last, so they are shuffled few times and while
    # narrow. lineitem x orders is a sort-merge join on the order key, as at any scale; a dimension goes to every
    # task only where its files are small, else by Spark's own choice.
    bought = orders.join(by_size(customer), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")
    made = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    largest_k, largest = _largest_key(li)
    quantity = F.col("l_quantity").cast("bigint")
    k = line_key("bigint" if largest_k <= BIGINT_MAX else "decimal(20,0)")
    position = (F.col("k") * 64 + quantity).cast("bigint")
    if largest > BIGINT_MAX:
        beyond = li.where(F.abs(line_key("decimal(20,0)") * 64 + F.col("l_quantity").try_cast("bigint")) > F.lit(BIGINT_MAX))

        def sold(lines: DataFrame) -> bool:
            """Whether any of the lines has its order, customer, part, supplier and nation."""
            found = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
            found = found.join(part, F.col("l_partkey") == F.col("p_partkey")).join(made, F.col("l_suppkey") == F.col("s_suppkey"))
            return not found.isEmpty()
        if sold(beyond.limit(TRIED)) or sold(beyond):
            li, position = with_row_position(li, from_files=True), F.col(S.ROW_POSITION)
        else:
            position = (F.col("k").cast("decimal(38,0)") * 64 + quantity).cast("bigint")
    b = (li.join(bought.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
           .join(by_size(made), F.col("l_suppkey") == F.col("s_suppkey"))
           .join(by_size(part), F.col("l_partkey") == F.col("p_partkey")))
    b = b.withColumn("k", k)

    def every(n: int) -> Column:
        return (F.col("k") % n) == 0

    cantidad = (F.when(every(131), F.lit(0.0))
                 .when(every(4001), F.col("l_quantity") * 1000)
                 .when((F.col("l_returnflag") == "R") & ((F.col("l_partkey") % 10) == 0),
                       -F.col("l_quantity"))
                 .otherwise(F.col("l_quantity")))
    b = b.withColumn("cantidad", cantidad)

    day_text = F.date_format("l_shipdate", "yyyy-MM-dd")
    r5 = F.col("k") % 5
    name = F.col("c_name")
    cliente = (F.when(every(409), F.lit(None).cast("string"))
                .when(r5 == 0, F.concat(F.lit("Instal·lació "), name, F.lit(" S.L.")))
                .when(r5 == 1, F.concat(F.lit("  INSTAL·LACIÓ "), F.upper(name), F.lit(" SL")))
                .when(r5 == 2, F.concat(F.lit("instal·lacio  "), F.lower(name), F.lit(" sl ")))
                .otherwise(F.concat(F.lit("Instal·lació "), name, F.lit(" SL"))))
    amount = F.col("cantidad") * F.col("p_retailprice")

    return b.select(
        position.alias("fila_origen"),
        F.when(~every(997), F.concat(F.lit("P"), F.col("l_orderkey"), F.lit("-"),
                                     F.col("l_linenumber"))).alias("pedido_id"),
        (F.when(every(211), F.lit(None).cast("string"))
          .when(every(223), F.lit("el martes que viene"))
          .when(every(7), F.concat(day_text, F.lit(" 10:30:00")))
          .otherwise(day_text)).alias("fecha"),
        F.when(~every(61), F.col("s_name")).alias("comercial"),
        F.when(~every(83), F.col("n_name")).alias("zona"),
        cliente.alias("cliente"),
        F.when(~every(53), F.col("c_mktsegment")).alias("tipo_cliente"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("producto"),
        F.when(~every(41), F.col("p_type")).alias("familia"),
        F.col("cantidad"),
        F.col("p_retailprice").alias("precio_unitario"),
        (F.when(every(401), F.lit(None).cast("double"))
          .when(every(101), amount + 0.5)
          .otherwise(amount)).alias("importe"),
    )


# The same recipe for the DuckDB oracle. ``{fmt}`` is replaced by the
# date-to-text expression of the engine running it.
DIRTY_SQL = """
with b as (
  select l.l_quantity, l.l_returnflag, l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey,
         c.c_name, c.c_mktsegment, s.s_name, n.n_name, p.p_name, p.p_brand, p.p_type, p.p_retailprice,
         ((l_orderkey*16 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey as k
  from lineitem l join orders o on l_orderkey=o_orderkey join customer c on o_custkey=c_custkey
  join part p on l_partkey=p_partkey join supplier s on l_suppkey=s_suppkey
  join nation n on s_nationkey=n_nationkey),
q as (
  select *, case when k%131=0 then 0.0e0 when k%4001=0 then l_quantity*1000
                 when l_returnflag='R' and l_partkey%10=0 then -l_quantity
                 else l_quantity end as cantidad from b)
select k*64 + cast(l_quantity as bigint) as fila_origen,
  case when k%997=0 then null else concat('P',l_orderkey,'-',l_linenumber) end as pedido_id,
  case when k%211=0 then null when k%223=0 then 'el martes que viene'
       when k%7=0 then concat({fmt},' 10:30:00') else {fmt} end as fecha,
  case when k%61=0 then null else s_name end as comercial,
  case when k%83=0 then null else n_name end as zona,
  case when k%409=0 then null
       when k%5=0 then concat('Instal·lació ',c_name,' S.L.')
       when k%5=1 then concat('  INSTAL·LACIÓ ',upper(c_name),' SL')
       when k%5=2 then concat('instal·lacio  ',lower(c_name),' sl ')
       else concat('Instal·lació ',c_name,' SL') end as cliente,
  case when k%53=0 then null else c_mktsegment end as tipo_cliente,
  concat(p_name,' ',p_brand) as producto,
  case when k%41=0 then null else p_type end as familia,
  cantidad, p_retailprice as precio_unitario,
  case when k%401=0 then null when k%101=0 then cantidad*p_retailprice+0.5e0
       else cantidad*p_retailprice end as importe
from q
"""

DUCKDB_DATE_TEXT = "strftime(l_shipdate,'%Y-%m-%d')"


def dirty_sql_duckdb() -> str:
    return DIRTY_SQL.replace("{fmt}", DUCKDB_DATE_TEXT)
