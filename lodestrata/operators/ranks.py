"""Ranks within a group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import materialize


def spread_rank(rows: DataFrame, group: str, key: Column, name: str = "rank", salts: int = 64) -> DataFrame:
    """Adds a rank from 0 within each group, gapless and repeatable but in no stated order.

    Rows are spread by a hash of key over salts per group; a table of the salts'
    counts, of at most salts rows a group, gives each its first rank, so a group
    of any size is ranked in as many tasks. Rows with equal keys are ranked in an arbitrary order.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    counts = materialize(salted.groupBy(group, "_salt").agg(F.count("*").alias("_n")))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(F.xxhash64(key), key)) - 1
    return salted.withColumn("_within", within).join(first, [group, "_salt"]).withColumn(name, F.col("_first") + F.col("_within")).drop("_salt", "_first", "_within")
