"""Reports over the query log and the results it returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.columns import clean_name, stored_seconds

#: Best score below which a query counts as failed.
FLOOR = 0.30
DAY = 86400


def clean_log(queries: DataFrame) -> DataFrame:
    """The log with rows delivered twice once, at as seconds (null if unknown), and actor and session cleaned, 'unknown' where empty.

    Rows are told apart by their id, not by all of their columns, so a report
    reads and shuffles only the columns it uses; rows of one id must be alike.
    """
    name = lambda c: F.coalesce(F.nullif(clean_name(F.col(c)), F.lit("")), F.lit("unknown"))
    return queries.dropDuplicates(["id"]).withColumns({"at": stored_seconds(F.col("ts")), "actor": name("user"), "session": name("session_id"), "q": F.lower("query")}).drop("ts", "user", "session_id")


def in_window(log: DataFrame, since: float, until: float) -> DataFrame:
    return log.where((F.col("at") >= since) & (F.col("at") < until))


def top_queries(log: DataFrame) -> DataFrame:
    return log.groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("users"), F.max("at").alias("last_at"), F.round(F.avg("n_results"), 6).alias("avg_results"))


def failed_queries(log: DataFrame, results: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Queries without a result or whose best score is below the floor."""
    best = results.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("score"))
    found = log.select("id", "at", "actor", "query", "n_results").join(best, "id", "left").withColumn("best_score", F.coalesce("score", F.lit(0.0)))
    return found.where((F.col("n_results") == 0) | (F.col("best_score") < floor)).drop("score")


def repeated_queries(log: DataFrame) -> DataFrame:
    return log.groupBy("actor", "q").agg(F.count("*").alias("times"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).where("times >= 2")


def most_returned(log: DataFrame, results: DataFrame) -> DataFrame:
    hits = results.join(log.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    # Summed as decimals, so that the mean does not depend on the order.
    return hits.groupBy("path").agg(F.count("*").alias("appearances"), F.count_if(F.col("rank") == 0).alias("top1"), F.round(F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("score"), 6).alias("avg_score"))


def dead_docs(docs: DataFrame, log: DataFrame, results: DataFrame) -> DataFrame:
    """Documents that no query of the log returned."""
    hits = results.join(log.select(F.col("id").alias("query_id")), "query_id", "left_semi").select("path").distinct()
    return docs.join(hits, "path", "left_anti").select("id", "path", "title", "status", "tokens_est")


def hour_heatmap(log: DataFrame) -> DataFrame:
    """(day, hour, n) of all 7 x 24 hours of the week in UTC, Monday as 0."""
    at = F.timestamp_seconds("at")
    seen = log.where("at is not null").groupBy(F.weekday(at).alias("day"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))
    spark = log.sparkSession
    grid = spark.range(7 * 24).select(F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(seen, ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def rerank_stats(log: DataFrame) -> DataFrame:
    """Per model: calls, tokens and mean time, with the share of all queries that were reranked."""
    total = log.agg(F.count("*").alias("total"), F.count_if(F.col("reranked") == 1).alias("reranked"))
    per = log.where("reranked = 1").groupBy(F.coalesce("llm_model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("calls"), F.sum("llm_tokens_in").alias("tokens_in"), F.sum("llm_tokens_out").alias("tokens_out"), F.round(F.avg("llm_elapsed_ms"), 6).alias("avg_ms"))
    # One row.
    return per.crossJoin(F.broadcast(total)).select("model", "calls", "tokens_in", "tokens_out", "avg_ms", F.round(F.try_divide(F.col("reranked") * 100.0, "total"), 6).alias("coverage_pct"))


def rerank_divergence(log: DataFrame) -> DataFrame:
    r = log.where("reranked = 1")
    changed = F.col("top1_changed") == 1
    out = r.agg(F.count("*").alias("total"), F.count_if(changed).alias("changed"), F.round(F.coalesce(F.avg(F.when(changed, F.col("top1_lift"))), F.lit(0.0)), 6).alias("avg_lift"), F.round(F.coalesce(F.avg(F.when(changed, F.col("top5_overlap"))), F.lit(5.0)), 6).alias("avg_top5_overlap"))
    pct = F.coalesce(F.try_divide(F.col("changed") * 100.0, "total"), F.lit(0.0))
    return out.withColumn("changed_pct", F.round(pct, 6)).withColumn("verdict", F.when(F.col("total") == 0, "no data").when(pct < 10, "confirms").when(pct > 40, "reorders").otherwise("marginal"))


def lift_histogram(log: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of all bins; lifts beyond either end are added to the bin there."""
    lift = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.coalesce("top1_lift", F.lit(0))))
    seen = log.where("reranked = 1").groupBy(lift.alias("lift")).agg(F.count("*").alias("n"))
    return log.sparkSession.range(bins).select(F.col("id").cast("int").alias("lift")).join(seen, "lift", "left").select("lift", F.coalesce("n", F.lit(0)).alias("n"))


def suggestions(log: DataFrame, prefix: str, limit: int = 6) -> DataFrame:
    """Past queries that begin with the prefix by count, or the latest for an empty one."""
    asked = log.where("query is not null and trim(query) <> ''").groupBy("q").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    if not prefix.strip():
        return asked.orderBy(F.desc_nulls_last("last_at"), "q").limit(limit)
    return asked.where(F.startswith("q", F.lit(prefix.lower()))).orderBy(F.desc("n"), F.desc_nulls_last("last_at"), "q").limit(limit)


def _saved() -> tuple[Column, Column, Column]:
    return tuple(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("would_have_read_tokens", "would_read"), ("response_tokens_est", "response"), ("top_result_tokens", "top")))


def savings(log: DataFrame, *keys: str) -> DataFrame:
    """Tokens saved per key, clamped at 0 after summing, and their ratio to those that would have been read."""
    sums = log.groupBy(*keys).agg(F.count("*").alias("n"), *_saved())
    saved = F.greatest(F.lit(0), F.col("would_read") - F.col("top") - F.col("response"))
    return sums.withColumn("saved", saved).withColumn("ratio", F.round(F.coalesce(F.try_divide(saved.cast("double"), "would_read"), F.lit(0.0)), 6))


def savings_cube(log: DataFrame) -> DataFrame:
    """All receipts in one pass: per actor and session, per actor, and in all."""
    sums = log.rollup("actor", "session").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *_saved())
    return sums.withColumn("saved", F.greatest(F.lit(0), F.col("would_read") - F.col("top") - F.col("response")))


def daily_savings(log: DataFrame, since: float, days: int) -> DataFrame:
    """(day, n, saved) of so many UTC days from the midnight of since, days without queries included."""
    first = int(since // DAY)
    seen = log.where("at is not null").groupBy((F.floor(F.col("at") / DAY)).alias("day")).agg(F.count("*").alias("n"), *_saved())
    grid = log.sparkSession.range(first, first + days).select(F.col("id").alias("day"))
    got = grid.join(seen, "day", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return got.select("day", zero("n").alias("n"), F.greatest(F.lit(0), zero("would_read") - zero("top") - zero("response")).alias("saved"))


def savings_trend(daily: DataFrame, week: int = 7) -> DataFrame:
    """The last so many days beside those before them. Days are few, one a day, so one window over all is bounded by the calendar."""
    order = Window.orderBy("day")
    summed = daily.withColumn("week_saved", F.sum("saved").over(order.rowsBetween(-(week - 1), 0)))
    return summed.select("day", "week_saved", (F.col("week_saved") - F.coalesce(F.lag("week_saved", week).over(order), F.lit(0))).alias("change"))


def top_savings(log: DataFrame, limit: int = 20) -> DataFrame:
    """The queries that saved most: ordered by the plain difference, clamped per row."""
    gain = F.coalesce("would_have_read_tokens", F.lit(0)) - F.coalesce("top_result_tokens", F.lit(0)) - F.coalesce("response_tokens_est", F.lit(0))
    return log.select("id", "actor", "query", gain.alias("gain")).orderBy(F.desc("gain"), "id").limit(limit).select("id", "actor", "query", F.greatest(F.lit(0), F.col("gain")).alias("saved"))


def sparkline(log: DataFrame, since: float, until: float, bins: int = 24) -> DataFrame:
    """(actor, bin, n) of equal bins over [since, until], the end in the last bin; every bin of every actor seen."""
    width = (until - since) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col("at") - since) / width)).cast("int")
    seen = log.where((F.col("at") >= since) & (F.col("at") <= until)).groupBy("actor", place.alias("bin")).agg(F.count("*").alias("n"))
    grid = seen.select("actor").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(seen, ["actor", "bin"], "left").select("actor", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def recency(log: DataFrame, as_of: float) -> DataFrame:
    """Queries by day before as_of: Today, Yesterday, Earlier; rows of unknown time as Unknown."""
    day = F.floor(F.lit(as_of) / DAY) - F.floor(F.col("at") / DAY)
    label = F.when(F.col("at").isNull(), "Unknown").when(day <= 0, "Today").when(day == 1, "Yesterday").otherwise("Earlier")
    return log.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("actor").alias("users"), F.sum("response_tokens_est").alias("response"))


def per_actor(log: DataFrame) -> DataFrame:
    return log.groupBy("actor").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"), F.sum("response_tokens_est").alias("response"), F.count_distinct("session").alias("sessions"))


def window_compare(results: DataFrame, log: DataFrame, split: float) -> DataFrame:
    """Reads and tokens by path before and from a moment on, and the change of tokens a read."""
    reads = results.join(log.select(F.col("id").alias("query_id"), "at"), "query_id").where("at is not null and tokens_est is not null")
    before = F.col("at") < split
    out = reads.groupBy("path").agg(F.count_if(before).alias("reads_before"), F.count_if(~before).alias("reads_after"), F.sum(F.when(before, F.col("tokens_est"))).alias("tokens_before"), F.sum(F.when(~before, F.col("tokens_est"))).alias("tokens_after"))
    each = lambda t, n: F.try_divide(F.col(t).cast("double"), F.col(n))
    return out.withColumn("change", F.round(each("tokens_after", "reads_after") - each("tokens_before", "reads_before"), 6))


def rate_limited(events: DataFrame, key: str, at_micros: Column, most: int = 5, window_us: int = 60_000_000) -> DataFrame:
    """Events with how many of their key fell into the window that ends with them, and whether those are over the limit.

    A key is cut into slices of one window's length, each a partition of its own
    that also holds the slice before, so a hot key is spread over time. Events
    of an unknown time have a null count.
    """
    rows = events.withColumn("at_us", at_micros).withColumn("_own", F.floor(F.col("at_us") / window_us))
    frame = Window.partitionBy(key, "_slice").orderBy("at_us").rangeBetween(-(window_us - 1), 0)
    near = rows.withColumn("_slice", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array("_own", F.col("_own") + 1))))
    counted = near.withColumn("recent", F.when(F.col("_own").isNotNull(), F.count("*").over(frame)))
    return counted.where("_slice <=> _own").drop("_slice", "_own").withColumn("limited", F.col("recent") > most)


def share_bucket(ratio: Column) -> Column:
    """Label of a share in per cent."""
    p = F.floor(ratio * 100)
    return F.when(p <= 0, "0").when(p < 25, "1-24").when(p < 50, "25-49").when(p < 65, "50-64").when(p < 80, "65-79").otherwise("80+")


def rerank_moves(before: Column, after: Column, top: int = 5) -> dict[str, Column]:
    """What reranking changed, from the order of paths before and after: another first, where it was (0 if nowhere), common among the first."""
    first = F.try_element_at(after, F.lit(1))
    place = F.array_position(before, first)
    return {"top1_changed": (~F.try_element_at(before, F.lit(1)).eqNullSafe(first)).cast("int"), "top1_lift": F.greatest(F.lit(0), place - 1).cast("int"), "top5_overlap": F.size(F.array_intersect(F.slice(before, 1, top), F.slice(after, 1, top)))}
