"""Loading of the test tables and the derived views the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views under the tables' own names, for queries written in SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
