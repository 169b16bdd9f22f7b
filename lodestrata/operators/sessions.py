"""Sessions of activity: merging gap-length intervals per actor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_sessions(events: DataFrame, actor: str = "actor", at: str = "at", event_id: str = "event_id", item: str = "item", gap: float = 1800.0) -> DataFrame:
    """One row per actor and session: session_no, start, end, duration, n_events, n_items, first_id, last_id.

    Every event opens the interval [at, at + gap]; intervals of an actor that
    overlap or touch are merged, as merging interval state does, so a session
    ends where the next event is more than gap seconds later, however late it
    arrived. Times are compared by the microsecond. On a whole table no event is
    too late and no watermark is needed; streaming.log.log_sessions() is the same
    rule over a stream, with one.

    Events of one actor in one slice of time narrower than the gap always belong
    together. They are merged into one interval in a first aggregation, which
    combines before the shuffle and spreads a hot actor over its slices; what is
    left for an actor is at most one interval a slice, bounded by the span of
    time and not by the number of events. Counts are aggregated per item and
    then per session, so no set of events is ever held in a task.

    Rows that repeat an event id are one event, the least of them by time, actor
    and item. Rows with a null actor, time (or NaN) or event id take no part;
    null items count as no item. first_id is the smallest id at the earliest
    time, last_id the largest id at the latest. No rows give no rows.
    """
    rows = events.select(F.col(event_id).alias("event_id"), F.struct(F.col(at).cast("double").alias("at"), F.col(actor).alias("actor"), F.col(item).alias("item")).alias("e"))
    rows = rows.where("event_id is not null and e.actor is not null and e.at is not null and not isnan(e.at)")
    rows = rows.groupBy("event_id").agg(F.min("e").alias("e")).select("event_id", "e.*")
    # Slices of half the gap: rounding can never put events further apart than the gap into one.
    slice_of = lambda t: F.floor(t / F.lit(gap / 2))
    micros = lambda t: F.round(t * 1e6).cast("long")
    rows = rows.withColumn("slice", slice_of(F.col("at")))
    parts = rows.groupBy("actor", "slice", "item").agg(F.count("*").alias("n"), F.min(F.struct("at", "event_id")).alias("first"), F.max(F.struct("at", "event_id")).alias("last"))
    slices = parts.groupBy("actor", "slice").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    length = micros(F.col("last.at")) - micros(F.col("first.at")) + round(gap * 1e6)
    opened = slices.withColumn("ts", F.timestamp_micros(micros(F.col("first.at")))).withColumn("length", F.concat(length.cast("string"), F.lit(" microseconds")))
    merged = opened.groupBy("actor", F.session_window("ts", F.col("length"))).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    numbered = merged.withColumn("session_no", (F.row_number().over(Window.partitionBy("actor").orderBy("first.at")) - 1).cast("long"))
    intervals = numbered.select("actor", "session_no", "first", "last")
    spanned = intervals.select("actor", "session_no", F.explode(F.sequence(slice_of(F.col("first.at")), slice_of(F.col("last.at")))).alias("slice"))
    counted = parts.select("actor", "slice", "item", "n").join(spanned, ["actor", "slice"])
    counts = counted.groupBy("actor", "session_no", "item").agg(F.sum("n").alias("n")).groupBy("actor", "session_no").agg(F.sum("n").alias("n_events"), F.count("item").alias("n_items"))
    start, end = F.col("first.at"), F.col("last.at")
    return intervals.join(counts, ["actor", "session_no"]).select("actor", "session_no", start.alias("start"), end.alias("end"), (end - start).alias("duration"), "n_events", "n_items", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"))


def log_actors(queries: DataFrame) -> DataFrame:
    """The query log as events (event_id, actor, at, item) for merge_sessions().

    The actor is the clean user, or the clean session id where the user is empty
    or 'unknown'; rows where that is empty or 'unknown' too get a null actor.
    Times are read in whichever unit they fit.
    """
    from lodestrata.functions.columns import clean_name, stored_seconds

    known = lambda c: F.when(~clean_name(c).isin("", "unknown"), clean_name(c))
    return queries.select(F.col("id").alias("event_id"), F.coalesce(known(F.col("user")), known(F.col("session_id"))).alias("actor"), stored_seconds(F.col("ts")).alias("at"), F.col("query").alias("item"))
