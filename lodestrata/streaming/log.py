"""The query log and event stream as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: The time of the row that tells a stream's end.
END = "9000-01-01"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, ts: str | None = "ts") -> DataFrame:
    """A stream of the events in a file or folder, with the column ts as an event time that watermarks accept."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A stream reads folders; a single file is picked out of its own.
    rows = source.parquet(path) if not _is_file(spark, path) else source.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")) if ts else rows


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of windows that are closed when the watermark passes them; values are summed as decimals of 6 places, so that the sum does not depend on the order."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(24,6)")).cast("double").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def _known(rows: DataFrame, *names: str) -> DataFrame:
    """The rows without a null in the columns named, and that of the end: a filter on the time stays behind the watermark, which must see that row."""
    return rows.where(F.expr(" and ".join(f"{n} is not null" for n in names)) | (F.col("ts") >= F.lit(END).cast("timestamp")))


def sessions(events: DataFrame, key: str, gap: float = 1800.0, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions as merging interval state. Every event of events(key, ts) opens an interval of the gap, intervals of a key that overlap are merged, also by events that come late but within the watermark; a session ends where the next event is more than gap seconds later. Rows with a null key or time take no part."""
    rows = _known(events.withWatermark("ts", late), key)
    return rows.groupBy(F.session_window("ts", f"{round(gap * 1e6)} microseconds"), key).agg(F.count("*").alias("n"), F.max("ts").alias("end")).select(key, F.col("session_window.start").alias("start"), "end", "n")


def log_sessions(log: DataFrame, gap: float = 1800.0, late: str = "1 hour") -> DataFrame:
    """(actor, start, end, duration, n_events, first_id, last_id): the sessions of a stream of events(event_id, actor, ts), an event delivered again within the watermark counted once.

    The same rule as operators.sessions.merge_sessions(), which has a whole
    table to read: there no event is too late. Items are not counted here, since
    state of a session would hold every item.
    """
    rows = _known(log.withWatermark("ts", late), "event_id", "actor").dropDuplicatesWithinWatermark(["event_id"])
    least, most = F.min(F.struct("ts", "event_id")), F.max(F.struct("ts", "event_id"))
    w = rows.groupBy(F.session_window("ts", f"{round(gap * 1e6)} microseconds"), "actor").agg(F.count("*").alias("n_events"), least.alias("first"), most.alias("last"))
    start, end = (F.unix_micros(F.col(f"{x}.ts")) / 1e6 for x in ("first", "last"))
    return w.select("actor", start.alias("start"), end.alias("end"), (end - start).alias("duration"), "n_events", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"))


def bursts(changes: DataFrame, key: str, path: str, quiet: float = 0.5, late: str = "1 minute") -> DataFrame:
    """(key, start, end, n, paths): changes(key, path, ts) of a watched source gathered until it was quiet for more than so many seconds, each path once, in order: what is to be taken in again at a time. Rows with a null key, path or time take no part; the paths of an open burst are its state."""
    rows = _known(changes.withWatermark("ts", late), key, path)
    w = rows.groupBy(F.session_window("ts", f"{round(quiet * 1e6)} microseconds"), key).agg(F.count("*").alias("n"), F.max("ts").alias("end"), F.sort_array(F.collect_set(path)).alias("paths"))
    return w.select(key, F.col("session_window.start").alias("start"), "end", "n", "paths")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: bursts of the same event are one."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def repeats(events: DataFrame, key: str, item: str, least: int = 2, idle: int = 3600) -> DataFrame:
    """(key, item, times) each time an item is repeated by its key; the count of an item is dropped when the watermark, idle seconds behind the latest event, passes its last event by as many again."""

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        before = n
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + idle * 1000, state.getCurrentWatermarkMs() + 1))
        if n >= least and n > before:
            yield pd.DataFrame({key: [keys[0]], item: [keys[1]], "times": [n]})

    kinds = dict(events.dtypes)
    grouped = events.withWatermark("ts", f"{idle} seconds").groupBy(key, item)
    return grouped.applyInPandasWithState(count, f"{key} {kinds[key]}, {item} {kinds[item]}, times long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def closing(events: DataFrame, folder: str) -> DataFrame:
    """events and whatever row end() writes to the folder: a stream whose end can be told."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def end(events: DataFrame, folder: str, key: str = "ts") -> None:
    """Tell a stream made by closing() that no more comes: a row of nulls, long after any other, moves its watermark past all windows, and is in none that closes."""
    spark = events.sparkSession
    row = spark.range(1).select(*[(F.lit(END).cast(f.dataType) if f.name == key else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    row.write.mode("append").parquet(folder)


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", finish=None) -> DataFrame:
    """The rows a stream gives for all that its source has now, kept as files in the shared folder.

    A window that the watermark has not passed stays open in the state and gives
    no row. finish, if given, is called when the source is drained, to tell its
    end (end()); the stream then goes on from its checkpoint and closes all.
    """

    def run() -> None:
        stream.writeStream.format("parquet").option("path", f"{checkpoint}/{name}/out").option("checkpointLocation", f"{checkpoint}/{name}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()

    run()
    if finish:
        finish()
        run()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{checkpoint}/{name}/out")
