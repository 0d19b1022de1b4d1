"""Hand-made inputs for the gate and for the explorer."""

import datetime as dt

from pyspark.sql import types as T

DIRTY = T.StructType([
    T.StructField("pedido_id", T.StringType()), T.StructField("fecha", T.StringType()),
    T.StructField("comercial", T.StringType()), T.StructField("zona", T.StringType()),
    T.StructField("cliente", T.StringType()), T.StructField("tipo_cliente", T.StringType()),
    T.StructField("producto", T.StringType()), T.StructField("familia", T.StringType()),
    T.StructField("cantidad", T.DoubleType()), T.StructField("precio_unitario", T.DoubleType()),
    T.StructField("importe", T.DoubleType()),
])


def gate_rows():
    """Four order lines: one customer in three spellings, a return, and a
    corrected line typed again under the id it already had."""
    def line(pedido, fecha, cliente, producto, cantidad, precio, **more):
        return dict(pedido_id=pedido, fecha=fecha, comercial="Ona Vila", zona="Reus", cliente=cliente,
                    tipo_cliente="Obra", producto=producto, familia="Tableros", cantidad=cantidad,
                    precio_unitario=precio, importe=cantidad * precio) | more
    return [
        line("A-100", "2025-02-14", "Maderas Núñez", "Tablero pino", 8.0, 15.5),
        line("A-101", "2025-05-20", " maderas nunez.", "Listón haya", -3.0, 9.0, zona="Bilbao"),
        line("A-102", "2025-01-07", "MADERAS NUÑEZ", "Cola blanca 5 kg", 4.0, 21.25, familia="Químicos"),
        line("A-100", "2025-02-15", "Maderas Núñez", "Tablero pino", 1.0, 15.5),
    ]


def frame(spark, rows, with_position=True):
    """Rows as a DataFrame; ``fila_origen`` = list order unless disabled."""
    data = [tuple(r.get(f.name) for f in DIRTY.fields) for r in rows]
    if not with_position:
        return spark.createDataFrame(data, DIRTY)
    schema = T.StructType([T.StructField("fila_origen", T.LongType()), *DIRTY.fields])
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], schema)


CLEAN = T.StructType([
    T.StructField("pedido_id", T.StringType()), T.StructField("fecha", T.TimestampNTZType()),
    T.StructField("comercial", T.StringType()), T.StructField("zona", T.StringType()),
    T.StructField("cliente", T.StringType()), T.StructField("tipo_cliente", T.StringType()),
    T.StructField("producto", T.StringType()), T.StructField("familia", T.StringType()),
    T.StructField("cantidad", T.DoubleType()), T.StructField("precio_unitario", T.DoubleType()),
    T.StructField("importe", T.DoubleType()), T.StructField("es_devolucion", T.BooleanType()),
    T.StructField("sospechoso", T.BooleanType()),
])


def shop_rows(spark):
    """Seven already-gated rows of a carpentry shop; no ``fila_origen`` (old data)."""
    def row(pedido, day, comercial, zona, cliente, tipo, producto, familia, cantidad, precio, flagged=False):
        return (pedido, dt.datetime.fromisoformat(day), comercial, zona, cliente, tipo, producto, familia, cantidad,
                precio, round(cantidad * precio, 2), cantidad < 0, flagged)
    rows = [
        row("Q1", "2024-11-05", "Ona Vila", "Reus", "Talleres Prat", "Obra", "Tablero pino 244", "Tableros", 30.0, 18.5),
        row("Q2", "2025-02-18", "Iker Otxoa", "Bilbao", "Maderas Núñez", "Taller", "Listón haya 2 m", "Listones", 12.0, 7.25),
        row("Q3", "2025-02-20", "Ona Vila", "Reus", "Talleres Prat", "Obra", "Cola blanca 5 kg", "Químicos", -2.0, 21.25),
        row("Q4", "2025-03-01", "Lía Campo", "Reus", "Cocinas Sol", "Taller", "Bisagra 35 mm", "Herrajes", 400.0, 0.8),
        row("Q5", "2025-03-03", "Iker Otxoa", "Bilbao", "Puertas Norte", "Obra", "Puerta roble", "Puertas", 6.0, 149.9),
        row("Q6", "2024-12-24", "Pau Gil", "Vic", "Cocinas Sol", "Taller", "Puerta roble", "Puertas", 5000.0, 149.9, True),
        row("Q7", "2025-03-02", "Lía Campo", "Vic", "Prat i fills", "Obra", "Tablero haya", "Tableros", 10.0, 30.0),
    ]
    return spark.createDataFrame(rows, CLEAN)
