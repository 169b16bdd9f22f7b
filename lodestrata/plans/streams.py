"""Streaming queries, run over all that their table holds: the source is drained, its end told, and every window closed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.sessions import log_actors
from lodestrata.plans.sessions import SESSIONS
from lodestrata.session import work_folder
from lodestrata.streaming import log as S


def _run(spark: SparkSession, sf_dir: str, name: str, of, windows: bool = True) -> DataFrame:
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = S.events_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    if not windows:
        return S.drained(of(events), name, folder)
    return S.drained(of(S.closing(events, f"{folder}/end")), name, folder, finish=lambda: S.end(events, f"{folder}/end"))


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "daily", S.tumbling).select(F.unix_micros("start").alias("start"), "event_type", "n", "value")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "sliding", S.sliding).select(F.unix_micros("start").alias("start"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir, "sessions", lambda e: S.sessions(e, "user_id"))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "deduplicated", lambda e: S.deduplicated(e, "event_id").select("event_id", F.unix_micros("ts").alias("at")), windows=False)


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user did the same thing, the last count the stream gave; the idle time is longer than the table, so no count is dropped."""
    found = _run(spark, sf_dir, "repeats", lambda e: S.repeats(e, "user_id", "event_type", idle=10 * 365 * 86400), windows=False)
    return found.groupBy("user_id", "event_type").agg(F.max("times").alias("times"))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files: what each user touched until ten minutes were quiet."""
    found = _run(spark, sf_dir, "bursts", lambda e: S.bursts(e, "user_id", "event_type", 600.0))
    return found.select("user_id", F.unix_micros("start").alias("start"), "n", F.array_join("paths", ",").alias("paths"))


def p3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of the query log as a stream. The log's rows come late by up to its whole span (ids follow arrival, times do not), so the watermark waits that long."""
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = S.events_stream(spark, f"{sf_dir.rstrip('/')}/mcp_queries.parquet", ts=None)
    rows = log_actors(log).select("event_id", "actor", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")).alias("ts"))
    found = S.log_sessions(S.closing(rows, f"{folder}/end"), late=f"{11 * 365} days")
    micros = lambda c: F.round(F.col(c) * 1e6).cast("long").alias(c)
    return S.drained(found, "log", folder, finish=lambda: S.end(rows, f"{folder}/end")).select("actor", micros("start"), micros("end"), "n_events", "first_id", "last_id")


_MICROS = "epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL"
QUERIES = {"stream_daily": stream_daily, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_deduplicated": stream_deduplicated, "stream_repeats": stream_repeats, "stream_bursts": stream_bursts, "p3_stream": p3_stream}
ORACLES = {
    "stream_daily": f"SELECT us // 86400000000 * 86400000000 AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS value FROM (SELECT *, {_MICROS}) GROUP BY ALL",
    "stream_sliding": f"SELECT (us // 86400000000 - k) * 86400000000 AS start, count(*) AS n FROM (SELECT {_MICROS}), range(7) t(k) GROUP BY ALL",
    "stream_sessions": f"""WITH m AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM (SELECT user_id, {_MICROS}) WHERE user_id IS NOT NULL),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us) AS k FROM m)
    SELECT user_id, min(us) AS start, max(us) AS "end", count(*) AS n FROM n GROUP BY user_id, k""",
    "stream_bursts": f"""WITH m AS (SELECT user_id, event_type, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS opens FROM (SELECT user_id, event_type, {_MICROS}) WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us) AS k FROM m)
    SELECT user_id, min(us) AS start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM n GROUP BY user_id, k""",
    "stream_deduplicated": "SELECT DISTINCT event_id, epoch_us(ts) AS at FROM events",
    "p3_stream": SESSIONS
    + """SELECT actor, CAST(round(min("at") * 1e6) AS BIGINT) AS start, CAST(round(max("at") * 1e6) AS BIGINT) AS "end", count(*) AS n_events,
      min(id) FILTER (WHERE "at" = lo) AS first_id, max(id) FILTER (WHERE "at" = hi) AS last_id FROM spans GROUP BY actor, session_no""",
    "stream_repeats": "SELECT user_id, event_type, count(*) AS times FROM events GROUP BY ALL HAVING count(*) >= 2",
}
