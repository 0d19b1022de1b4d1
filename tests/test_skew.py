"""Hot keys: a third of the rows share one id and another third have none.

With AQE's skew thresholds lowered to this data size, the duplicate join runs
as a skew-split sort-merge join, and the verdicts stay exact.
"""

from pyspark.sql import functions as F

from ordergate import schema as S
from ordergate.operators.gate import verdict_table, prepare


def test_hot_ids(spark):
    n = 30000
    raw = spark.range(n).select(
        F.col("id").alias("fila_origen"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT"))
         .when(F.col("id") % 3 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("P"), F.col("id").cast("string"))).alias("pedido_id"),
        F.lit("2025-01-02").alias("fecha"), F.lit("c").alias("cliente"), F.lit("p").alias("producto"),
        F.lit(1.0).alias("cantidad"), F.lit(2.0).alias("precio_unitario"), F.lit(2.0).alias("importe"),
        F.lit("x").alias("comercial"), F.lit("z").alias("zona"), F.lit("t").alias("tipo_cliente"),
        F.lit("f").alias("familia"))
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        v = verdict_table(prepare(raw.repartition(8)), "2025-06-30")
        counts = {r[0]: r[1] for r in v.groupBy("veredicto").count().collect()}
        assert counts[S.VERDICT_DUPLICATE] == (n // 3 - 1) * 2      # all but the first HOT and first NULL
        assert counts[S.VERDICT_PASS] == n - counts[S.VERDICT_DUPLICATE]
        assert len(v.collect()) == n                                   # run this very plan
        plan = v._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, val in old.items():
            if val is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, val)
