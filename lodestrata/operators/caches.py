"""A result cache as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_version(docs: DataFrame) -> DataFrame:
    """(source_id, version) that changes with the documents of a source, their times, statuses and life cycles: a sum of hashes, whatever the order."""
    state = F.conv(F.substring(F.md5(F.concat_ws("|", "id", F.coalesce("status", F.lit("")), F.coalesce("lifecycle", F.lit("")))), 1, 8), 16, 10).cast("long")
    parts = docs.groupBy("source_id").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.sum(state).alias("state"))
    return parts.select("source_id", F.concat_ws(":", "source_id", F.col("n").cast("string"), F.coalesce(F.floor("at"), F.lit(0)).cast("string"), F.col("state").cast("string")).alias("version"))


def hits(cache: DataFrame, asked: DataFrame, as_of: float, ttl: float = 3600, most: int = 2000) -> DataFrame:
    """(id, key, hit) of asked(id, key, version): whether cache(key, version, created_at) has that key at that version, not older than ttl and among the most newest entries."""
    newest = cache.orderBy(F.desc("created_at"), "key").limit(most)
    live = newest.where((F.lit(as_of) - F.col("created_at") < ttl) & (F.col("created_at") <= as_of)).select("key", "version", F.lit(True).alias("hit")).distinct()
    return asked.join(live, ["key", "version"], "left").select("id", "key", F.coalesce("hit", F.lit(False)).alias("hit"))
