"""Queries over the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.catalog import table
from lodestrata.functions.text import polyline, short_number
from lodestrata.operators import usage as U

QUERIES, ORACLES = {}, {}
#: The window of the reports: the first quarter of 2020, of which the log has only a part, and a moment within it.
SINCE, UNTIL, SPLIT = 1577836800, 1593561600, 1583798400


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(_log(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLES[name] = _LOG + sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.clean_log(table(spark, sf_dir, "mcp_queries"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A result is known by its query and rank.
    return table(spark, sf_dir, "mcp_query_results").dropDuplicates(["query_id", "rank"])


_LOG = r"""
WITH once AS (SELECT DISTINCT * FROM mcp_queries),
log AS (SELECT * EXCLUDE (ts, "user", session_id), lower(query) AS q,
  CASE WHEN ts >= 1420070400 AND ts < 1767225600 THEN ts WHEN ts / 1e3 >= 1420070400 AND ts / 1e3 < 1767225600 THEN ts / 1e3 WHEN ts / 1e6 >= 1420070400 AND ts / 1e6 < 1767225600 THEN ts / 1e6 END AS "at",
  coalesce(nullif(regexp_replace(lower(coalesce("user", '')), '[^\p{L}\p{N}._-]', '', 'g'), ''), 'unknown') AS actor,
  coalesce(nullif(regexp_replace(lower(coalesce(session_id, '')), '[^\p{L}\p{N}._-]', '', 'g'), ''), 'unknown') AS session FROM once),
res AS (SELECT DISTINCT * FROM mcp_query_results)
"""
_W = f'"at" >= {SINCE} AND "at" < {UNTIL}'


@_query("top_queries", f'SELECT q, count(*) AS n, count(DISTINCT actor) AS users, max("at") AS last_at, round(avg(n_results), 6) AS avg_results FROM log WHERE {_W} GROUP BY q')
def _(log, spark, sf_dir):
    return U.top_queries(U.in_window(log, SINCE, UNTIL))


@_query("failed_queries", f'SELECT l.id, l."at", l.actor, l.query, l.n_results, coalesce(max(r.score), 0) AS best_score FROM log l LEFT JOIN res r ON r.query_id = l.id WHERE {_W} GROUP BY ALL HAVING l.n_results = 0 OR coalesce(max(r.score), 0) < 0.30')
def _(log, spark, sf_dir):
    return U.failed_queries(U.in_window(log, SINCE, UNTIL), _results(spark, sf_dir))


@_query("repeated_queries", f'SELECT actor, q, count(*) AS times, min("at") AS first_at, max("at") AS last_at FROM log WHERE {_W} GROUP BY actor, q HAVING count(*) >= 2')
def _(log, spark, sf_dir):
    return U.repeated_queries(U.in_window(log, SINCE, UNTIL))


@_query("most_returned", f"SELECT r.path, count(*) AS appearances, count(*) FILTER (WHERE rank = 0) AS top1, round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(score), 6) AS avg_score FROM res r WHERE r.query_id IN (SELECT id FROM log WHERE {_W}) GROUP BY r.path")
def _(log, spark, sf_dir):
    return U.most_returned(U.in_window(log, SINCE, UNTIL), _results(spark, sf_dir))


@_query("dead_docs", f"SELECT id, path, title, status, tokens_est FROM docs d WHERE NOT EXISTS (SELECT 1 FROM res r JOIN log l ON l.id = r.query_id WHERE {_W} AND r.path = d.path)")
def _(log, spark, sf_dir):
    return U.dead_docs(table(spark, sf_dir, "docs"), U.in_window(log, SINCE, UNTIL), _results(spark, sf_dir))


@_query(
    "hour_heatmap",
    """, seen AS (SELECT isodow(to_timestamp("at")) - 1 AS day, hour(to_timestamp("at")) AS hour, count(*) AS n FROM log WHERE "at" IS NOT NULL GROUP BY ALL)
    SELECT d.day, h.hour, coalesce(n, 0) AS n FROM range(7) d(day) CROSS JOIN range(24) h(hour) LEFT JOIN seen s ON s.day = d.day AND s.hour = h.hour""",
)
def _(log, spark, sf_dir):
    return U.hour_heatmap(log)


@_query("rerank_stats", "SELECT coalesce(llm_model, 'unknown') AS model, count(*) AS calls, CAST(sum(llm_tokens_in) AS BIGINT) AS tokens_in, CAST(sum(llm_tokens_out) AS BIGINT) AS tokens_out, round(avg(llm_elapsed_ms), 6) AS avg_ms, round((SELECT count(*) FILTER (WHERE reranked = 1) * 100.0 / count(*) FROM log), 6) AS coverage_pct FROM log WHERE reranked = 1 GROUP BY 1")
def _(log, spark, sf_dir):
    return U.rerank_stats(log)


@_query(
    "rerank_divergence",
    """, r AS (SELECT count(*) AS total, count(*) FILTER (WHERE top1_changed = 1) AS changed, round(coalesce(avg(top1_lift) FILTER (WHERE top1_changed = 1), 0), 6) AS avg_lift, round(coalesce(avg(top5_overlap) FILTER (WHERE top1_changed = 1), 5), 6) AS avg_top5_overlap FROM log WHERE reranked = 1)
    SELECT *, round(changed * 100.0 / total, 6) AS changed_pct, CASE WHEN changed * 100.0 / total < 10 THEN 'confirms' WHEN changed * 100.0 / total > 40 THEN 'reorders' ELSE 'marginal' END AS verdict FROM r""",
)
def _(log, spark, sf_dir):
    return U.rerank_divergence(log)


@_query("rerank_disagreements", """SELECT id, actor, query, pre_top1_path, top1_lift, "at" FROM log WHERE reranked = 1 AND top1_changed = 1 ORDER BY top1_lift DESC, "at" DESC NULLS LAST, id LIMIT 8""")
def _(log, spark, sf_dir):
    moved = log.where("reranked = 1 and top1_changed = 1")
    return moved.select("id", "actor", "query", "pre_top1_path", "top1_lift", "at").orderBy(F.desc_nulls_last("top1_lift"), F.desc_nulls_last("at"), "id").limit(8)


@_query("lift_histogram", ", s AS (SELECT least(19, greatest(0, coalesce(top1_lift, 0))) AS lift, count(*) AS n FROM log WHERE reranked = 1 GROUP BY 1) SELECT CAST(b.lift AS INT) AS lift, coalesce(n, 0) AS n FROM range(20) b(lift) LEFT JOIN s ON s.lift = b.lift")
def _(log, spark, sf_dir):
    return U.lift_histogram(log)


@_query("suggest", """SELECT q, count(*) AS n, max("at") AS last_at FROM log WHERE starts_with(q, 's') AND trim(query) <> '' GROUP BY q ORDER BY n DESC, last_at DESC NULLS LAST, q LIMIT 6""")
def _(log, spark, sf_dir):
    return U.suggestions(log, "S")


@_query("suggest_recent", """SELECT q, count(*) AS n, max("at") AS last_at FROM log WHERE trim(query) <> '' GROUP BY q ORDER BY last_at DESC NULLS LAST, q LIMIT 6""")
def _(log, spark, sf_dir):
    return U.suggestions(log, " ")


_SUMS = "count(*) AS n, CAST(coalesce(sum(would_have_read_tokens), 0) AS BIGINT) AS would_read, CAST(coalesce(sum(response_tokens_est), 0) AS BIGINT) AS response, CAST(coalesce(sum(top_result_tokens), 0) AS BIGINT) AS top"
_RATIO = "greatest(0, would_read - top - response) AS saved, round(CASE WHEN would_read <> 0 THEN greatest(0, would_read - top - response) / would_read ELSE 0 END, 6) AS ratio"


def _savings(name: str, *keys: str) -> None:
    cols = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""

    @_query(name, f", s AS (SELECT {cols}{_SUMS} FROM log {group}) SELECT *, {_RATIO} FROM s")
    def _(log, spark, sf_dir):
        return U.savings(log, *keys)


_savings("savings_totals")
_savings("savings_by_user", "actor")
_savings("savings_by_session", "session")
_savings("savings_by_user_session", "actor", "session")


@_query("savings_rollup", f", s AS (SELECT actor, session, grouping_id(actor, session) AS level, {_SUMS} FROM log GROUP BY ROLLUP (actor, session)) SELECT *, greatest(0, would_read - top - response) AS saved FROM s")
def _(log, spark, sf_dir):
    return U.savings_cube(log)


_DAILY = f""", seen AS (SELECT CAST(floor("at" / 86400) AS BIGINT) AS day, {_SUMS} FROM log WHERE "at" IS NOT NULL GROUP BY 1),
daily AS (SELECT g.day, coalesce(n, 0) AS n, greatest(0, coalesce(would_read, 0) - coalesce(top, 0) - coalesce(response, 0)) AS saved FROM range({SINCE // 86400}, {SINCE // 86400 + 120}) g(day) LEFT JOIN seen s ON s.day = g.day)"""


@_query("savings_daily", _DAILY + " SELECT * FROM daily")
def _(log, spark, sf_dir):
    return U.daily_savings(log, SINCE, 120)


@_query("savings_trend_7d", _DAILY + ", w AS (SELECT day, CAST(sum(saved) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week_saved FROM daily) SELECT day, week_saved, week_saved - coalesce(lag(week_saved, 7) OVER (ORDER BY day), 0) AS change FROM w")
def _(log, spark, sf_dir):
    return U.savings_trend(U.daily_savings(log, SINCE, 120))


@_query("savings_top", ", g AS (SELECT id, actor, query, coalesce(would_have_read_tokens, 0) - coalesce(top_result_tokens, 0) - coalesce(response_tokens_est, 0) AS gain FROM log ORDER BY gain DESC, id LIMIT 20) SELECT id, actor, query, greatest(0, gain) AS saved FROM g")
def _(log, spark, sf_dir):
    return U.top_savings(log)


@_query("share_buckets", f", s AS (SELECT session, {_SUMS} FROM log GROUP BY session), r AS (SELECT *, {_RATIO} FROM s) SELECT CASE WHEN floor(ratio * 100) <= 0 THEN '0' WHEN floor(ratio * 100) < 25 THEN '1-24' WHEN floor(ratio * 100) < 50 THEN '25-49' WHEN floor(ratio * 100) < 65 THEN '50-64' WHEN floor(ratio * 100) < 80 THEN '65-79' ELSE '80+' END AS bucket, count(*) AS n FROM r GROUP BY 1")
def _(log, spark, sf_dir):
    return U.savings(log, "session").groupBy(U.share_bucket(F.col("ratio")).alias("bucket")).agg(F.count("*").alias("n"))


@_query(
    "sparkline",
    f""", seen AS (SELECT actor, CAST(least(23, floor(("at" - {SINCE}) / ({UNTIL - SINCE} / 24))) AS INT) AS bin, count(*) AS n FROM log WHERE "at" BETWEEN {SINCE} AND {UNTIL} GROUP BY 1, 2)
    SELECT a.actor, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT actor FROM seen) a CROSS JOIN range(24) b(bin) LEFT JOIN seen s ON s.actor = a.actor AND s.bin = b.bin""",
)
def _(log, spark, sf_dir):
    return U.sparkline(log, SINCE, UNTIL)


@_query(
    "sparkline_points",
    f""", seen AS (SELECT actor, CAST(least(23, floor(("at" - {SINCE}) / ({UNTIL - SINCE} / 24))) AS INT) AS bin, count(*) AS n FROM log WHERE "at" BETWEEN {SINCE} AND {UNTIL} GROUP BY 1, 2),
    g AS (SELECT a.actor, b.bin AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT actor FROM seen) a CROSS JOIN range(24) b(bin) LEFT JOIN seen s ON s.actor = a.actor AND s.bin = b.bin),
    m AS (SELECT *, max(n) OVER (PARTITION BY actor) AS most FROM g)
    SELECT actor, string_agg(CAST(CAST(round_even(3.0::DOUBLE + bin * 94.0::DOUBLE / 23, 1) AS DECIMAL(10,1)) AS VARCHAR) || ',' || CAST(CAST(round_even(27.0::DOUBLE - n::DOUBLE / most * 24.0::DOUBLE, 1) AS DECIMAL(10,1)) AS VARCHAR), ' ' ORDER BY bin) AS points FROM m GROUP BY actor""",
)
def _(log, spark, sf_dir):
    bins = U.sparkline(log, SINCE, UNTIL).groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"))
    return bins.select("actor", polyline(F.transform("b", lambda x: x["n"].cast("double"))).alias("points"))


@_query(
    "session_receipts",
    """, r AS (SELECT session, count(*) AS n, sum(would_have_read_tokens) AS w, greatest(0, coalesce(sum(would_have_read_tokens), 0) - coalesce(sum(top_result_tokens), 0) - coalesce(sum(response_tokens_est), 0)) AS saved FROM log GROUP BY session)
    SELECT session, 'Session ' || session || ': ~' || """
    + "{0} || ' tokens saved over ' || n || ' queries, of ~' || {1} || ' that would have been read' AS line FROM r".format(*[f"CASE WHEN {c} < 1000 THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) WHEN {c} < 1000000 THEN printf('%.1fk', floor({c} / 100) / 10) ELSE printf('%.1fM', floor({c} / 100000) / 10) END" for c in ("saved", "coalesce(w, 0)")]),
)
def _(log, spark, sf_dir):
    """What each session saved, as a line."""
    sums = U.savings(log, "session")
    return sums.select("session", F.concat(F.lit("Session "), "session", F.lit(": ~"), short_number(F.col("saved")), F.lit(" tokens saved over "), F.col("n").cast("string"), F.lit(" queries, of ~"), short_number(F.col("would_read")), F.lit(" that would have been read")).alias("line"))


@_query(
    "usage_buckets",
    f"""SELECT CASE WHEN "at" IS NULL THEN 'Unknown' WHEN {SPLIT // 86400} - floor("at" / 86400) <= 0 THEN 'Today' WHEN {SPLIT // 86400} - floor("at" / 86400) = 1 THEN 'Yesterday' ELSE 'Earlier' END AS bucket,
    count(*) AS n, count(DISTINCT actor) AS users, CAST(sum(response_tokens_est) AS BIGINT) AS response FROM log GROUP BY 1""",
)
def _(log, spark, sf_dir):
    return U.recency(log, SPLIT)


@_query("usage_per_user", """SELECT actor, count(*) AS n, max("at") AS last_at, round(avg(elapsed_ms), 6) AS avg_ms, CAST(sum(response_tokens_est) AS BIGINT) AS response, count(DISTINCT session) AS sessions FROM log GROUP BY actor""")
def _(log, spark, sf_dir):
    return U.per_actor(log)


@_query(
    "window_compare",
    f""", r AS (SELECT r.path, l."at" < {SPLIT} AS b, r.tokens_est AS t FROM res r JOIN log l ON l.id = r.query_id WHERE l."at" IS NOT NULL AND r.tokens_est IS NOT NULL)
    SELECT path, count(*) FILTER (WHERE b) AS reads_before, count(*) FILTER (WHERE NOT b) AS reads_after, CAST(sum(t) FILTER (WHERE b) AS BIGINT) AS tokens_before, CAST(sum(t) FILTER (WHERE NOT b) AS BIGINT) AS tokens_after,
    round(sum(t) FILTER (WHERE NOT b) / count(*) FILTER (WHERE NOT b) - sum(t) FILTER (WHERE b) / count(*) FILTER (WHERE b), 6) AS change FROM r GROUP BY path""",
)
def _(log, spark, sf_dir):
    return U.window_compare(_results(spark, sf_dir), log, SPLIT)


@_query("purge_old_queries", f"""SELECT r.query_id, r.rank, r.path FROM res r WHERE r.query_id IN (SELECT id FROM log WHERE "at" >= {SPLIT})""")
def _(log, spark, sf_dir):
    """Result rows left after queries before a moment are purged: they go with their query."""
    kept = log.where(F.col("at") >= SPLIT).select(F.col("id").alias("query_id"))
    return _results(spark, sf_dir).join(kept, "query_id", "left_semi").select("query_id", "rank", "path")


@_query(
    "rerank_moves",
    """, o AS (SELECT query_id, list(path ORDER BY rank, path) AS b, list(path ORDER BY coalesce(score, 0) DESC, path) AS a FROM res GROUP BY query_id)
    SELECT query_id, CASE WHEN b[1] IS DISTINCT FROM a[1] THEN 1 ELSE 0 END AS top1_changed, greatest(0, coalesce(list_position(b, a[1]), 0) - 1) AS top1_lift, len(list_intersect(list_distinct(b[1:5]), list_distinct(a[1:5]))) AS top5_overlap FROM o""",
)
def _(log, spark, sf_dir):
    """What an order by score would change in the logged order; a query's results are few."""
    orders = _results(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("b"), F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "path"))).alias("a"))
    path = lambda c: F.transform(c, lambda x: x["path"])
    return orders.select("query_id", *[c.alias(k) for k, c in U.rerank_moves(path("b"), path("a")).items()])


@_query("rate_limit_range", "SELECT id, recent, recent > 5 AS limited FROM (SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events)")
def _(log, spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = U.rate_limited(events, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 5, 3_600_000_000)
    return out.select(F.col("event_id").alias("id"), "recent", "limited")
