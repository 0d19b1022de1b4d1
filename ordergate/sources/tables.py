"""The clean table on storage: S4 load, S5 save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordergate import schema as S
from ordergate.plans.storage import sorted_for_storage


def save_clean(clean: DataFrame, path: str) -> None:
    """Write the clean table range-sorted by (fecha, pedido_id).

    Written to a new path; switching readers to it is the publish step's job,
    so a failed write never damages the table being read.
    """
    sorted_for_storage(clean, ["fecha", "pedido_id"]).write.mode("errorifexists").parquet(path)


def load_clean(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved clean table with its declared schema."""
    return spark.read.schema(S.CLEAN_SCHEMA).parquet(path)
