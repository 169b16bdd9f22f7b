"""Queries over sessions of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.catalog import table
from lodestrata.operators.sessions import log_actors, merge_sessions


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sessions(log_actors(table(spark, sf_dir, "mcp_queries"))).select("actor", "first_id", "last_id")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sessions(log_actors(table(spark, sf_dir, "mcp_queries")))


SESSIONS = r"""
WITH raw AS (
  SELECT id,
    regexp_replace(lower(coalesce("user", '')), '[^\p{L}\p{N}._-]', '', 'g') AS u,
    regexp_replace(lower(coalesce(session_id, '')), '[^\p{L}\p{N}._-]', '', 'g') AS s,
    CASE WHEN ts >= 1420070400 AND ts < 1767225600 THEN ts
         WHEN ts / 1e3 >= 1420070400 AND ts / 1e3 < 1767225600 THEN ts / 1e3
         WHEN ts / 1e6 >= 1420070400 AND ts / 1e6 < 1767225600 THEN ts / 1e6 END AS "at",
    query FROM mcp_queries),
rows_ AS (
  SELECT DISTINCT id, CASE WHEN u NOT IN ('', 'unknown') THEN u WHEN s NOT IN ('', 'unknown') THEN s END AS actor, "at", query FROM raw),
marked AS (
  SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY actor ORDER BY "at", id) <= 1800 THEN 0 ELSE 1 END AS opens
  FROM rows_ WHERE actor IS NOT NULL AND "at" IS NOT NULL),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY actor ORDER BY "at", id ROWS UNBOUNDED PRECEDING) - 1 AS session_no FROM marked),
spans AS (
  SELECT *, min("at") OVER (PARTITION BY actor, session_no) AS lo, max("at") OVER (PARTITION BY actor, session_no) AS hi FROM numbered)
"""

QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions}
ORACLES = {
    "p3_found": SESSIONS + 'SELECT actor, min(id) FILTER (WHERE "at" = lo) AS first_id, max(id) FILTER (WHERE "at" = hi) AS last_id FROM spans GROUP BY actor, session_no',
    "p3_sessions": SESSIONS
    + """SELECT actor, CAST(session_no AS BIGINT) AS session_no, min("at") AS start, max("at") AS "end", max("at") - min("at") AS duration,
      count(*) AS n_events, count(DISTINCT query) AS n_items, min(id) FILTER (WHERE "at" = lo) AS first_id, max(id) FILTER (WHERE "at" = hi) AS last_id
      FROM spans GROUP BY actor, session_no""",
}
