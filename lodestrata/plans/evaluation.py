"""Queries that measure retrieval and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.catalog import table
from lodestrata.operators import evaluation as E
from lodestrata.functions import code
from lodestrata.operators import retrieval, usage
from lodestrata.session import materialize

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = _RES + sql
        return f

    return add


_RES = """WITH res AS (SELECT DISTINCT query_id AS qid, rank, path, status, tokens_est, score FROM mcp_query_results), log AS (SELECT DISTINCT * FROM mcp_queries),
ranked AS (SELECT qid, path AS id, min(rank) AS rank FROM res GROUP BY ALL), labels AS (SELECT id AS qid, pre_top1_path AS id FROM log WHERE pre_top1_path IS NOT NULL)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mcp_query_results").groupBy(F.col("query_id").alias("qid"), F.col("path").alias("id")).agg(F.min("rank").alias("rank"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first stage of retrieval put first, as the label that the final order is measured against."""
    return table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]).where("pre_top1_path is not null").select(F.col("id").alias("qid"), F.col("pre_top1_path").alias("id"))


_METRICS = """, f AS (SELECT l.qid, count(*) AS n, count(r.rank) AS n_found, min(r.rank) AS first FROM (SELECT DISTINCT * FROM labels) l LEFT JOIN (SELECT * FROM ranked WHERE rank < 5) r ON r.qid = l.qid AND r.id = l.id GROUP BY l.qid),
m AS (SELECT qid, CASE WHEN first < 1 THEN 1 ELSE 0 END AS hit_1, CASE WHEN first < 5 THEN 1 ELSE 0 END AS hit_k, round(coalesce(1 / (first + 1), 0), 6) AS reciprocal, round(n_found / n, 6) AS recall, first IS NULL AS missed FROM f)"""
_MEANS = "count(*) AS n, round(avg(hit_1), 6) AS hit_1, round(avg(hit_k), 6) AS hit_k, round(avg(reciprocal), 6) AS reciprocal, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE missed) AS misses"


@_query("ir_metrics_by_query", _METRICS + "SELECT * FROM m")
def ir_metrics_by_query(spark, sf_dir):
    return E.rank_metrics(_ranked(spark, sf_dir), _labels(spark, sf_dir), 5)


@_query("ir_metrics", _METRICS + f"SELECT {_MEANS} FROM m")
def ir_metrics(spark, sf_dir):
    return E.mean_metrics(ir_metrics_by_query(spark, sf_dir))


@_query("gate", _METRICS + f", a AS (SELECT {_MEANS} FROM m), r AS (SELECT concat_ws('; ', CASE WHEN n < 1000000000 THEN 'too few cases' END, CASE WHEN hit_1 < 0.5 THEN 'hit@1 is too low' END) AS reasons FROM a) SELECT reasons = '' AS passed, reasons FROM r")
def gate(spark, sf_dir):
    return E.gate(ir_metrics(spark, sf_dir), 0.5, 1_000_000_000)


_RATIO = ", x AS (SELECT reranked, round(greatest(0, would_have_read_tokens - response_tokens_est) / would_have_read_tokens, 6) AS v FROM log WHERE would_have_read_tokens > 0)"


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]).where("would_have_read_tokens > 0")
    return log.select("reranked", F.round(F.greatest(F.lit(0), F.col("would_have_read_tokens") - F.col("response_tokens_est")) / F.col("would_have_read_tokens"), 6).alias("v"))


@_query(
    "savings_quartiles",
    _RATIO
    + """, o AS (SELECT reranked, v, row_number() OVER (PARTITION BY reranked ORDER BY v) AS k, count(*) OVER (PARTITION BY reranked) AS n FROM x WHERE v IS NOT NULL),
    p AS (SELECT o.*, q, q * (n + 1) AS h, greatest(1, least(n - 1, CAST(floor(q * (n + 1)) AS BIGINT))) AS j FROM o, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(q)),
    g AS (SELECT reranked, q, max(n) AS n, max(h) AS h, max(j) AS j, max(v) FILTER (WHERE k = j) AS a, max(v) FILTER (WHERE k = j + 1) AS b FROM p GROUP BY ALL)
    SELECT reranked, q, round(CASE WHEN n = 1 THEN a ELSE a + (h - j) * (b - a) END, 6) AS value FROM g""",
)
def savings_quartiles(spark, sf_dir):
    return E.exclusive_quantiles(_ratios(spark, sf_dir), "v", [0.25, 0.5, 0.75], "reranked")


@_query("pooled_savings", "SELECT count(*) AS n, round(sum(greatest(0, would_have_read_tokens - response_tokens_est)) / sum(would_have_read_tokens), 6) AS pooled FROM log WHERE would_have_read_tokens > 0 AND response_tokens_est IS NOT NULL")
def pooled_savings(spark, sf_dir):
    log = table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]).where("would_have_read_tokens > 0 and response_tokens_est is not null")
    saved = F.sum(F.greatest(F.lit(0), F.col("would_have_read_tokens") - F.col("response_tokens_est")))
    return log.agg(F.count("*").alias("n"), F.round(saved / F.sum("would_have_read_tokens"), 6).alias("pooled"))


@_query(
    "latency_percentiles",
    """, o AS (SELECT reranked, elapsed_ms AS v, row_number() OVER (PARTITION BY reranked ORDER BY elapsed_ms) - 1 AS k, count(*) OVER (PARTITION BY reranked) AS n FROM log WHERE elapsed_ms IS NOT NULL)
    SELECT reranked, q, max(v) FILTER (WHERE k = round_even(q * (n - 1), 0)) AS value FROM o, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(q) GROUP BY ALL""",
)
def latency_percentiles(spark, sf_dir):
    return E.nearest_rank(table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]), "elapsed_ms", [0.5, 0.9, 0.99], "reranked")


_CASES = ", c AS (SELECT id AS idx, coalesce(llm_model, 'none') AS category, top1_changed = 0 AS base_ok, would_have_read_tokens AS base_tokens, top5_overlap >= 4 AS ok, response_tokens_est AS tokens FROM log)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"])
    return log.select(F.col("id").alias("idx"), F.coalesce("llm_model", F.lit("none")).alias("category"), (F.col("top1_changed") == 0).alias("base_ok"), F.col("would_have_read_tokens").alias("base_tokens"), (F.col("top5_overlap") >= 4).alias("ok"), F.col("response_tokens_est").alias("tokens"))


@_query(
    "equal_success",
    _CASES
    + """SELECT category, count(*) AS n, count(*) FILTER (WHERE base_ok AND ok) AS both, round(100.0 * (sum(base_tokens) FILTER (WHERE base_ok AND ok) - sum(tokens) FILTER (WHERE base_ok AND ok)) / sum(base_tokens) FILTER (WHERE base_ok AND ok), 6) AS saved_pct,
    count(*) FILTER (WHERE ok AND NOT base_ok) AS wins, count(*) FILTER (WHERE base_ok AND NOT ok) AS losses FROM c GROUP BY category""",
)
def equal_success(spark, sf_dir):
    return E.equal_success(_cases(spark, sf_dir))


@_query("weighted_marks", "SELECT id, round(0.35 * least(100, greatest(0, elapsed_ms)) + 0.25 * least(100, greatest(0, n_results * 20)) + 0.20 * least(100, greatest(0, top5_overlap * 20)) + 0.10 * least(100, greatest(0, top1_lift)) + 0.10 * least(100, greatest(0, reranked)), 6) AS weighted FROM log")
def weighted_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]).select("id", F.col("elapsed_ms").alias("correctness"), (F.col("n_results") * 20).alias("autonomy"), (F.col("top5_overlap") * 20).alias("actionability"), F.col("top1_lift").alias("safety"), F.col("reranked").alias("concision"))
    return E.weighted_marks(marks).select("id", "weighted")


@_query("budget_prefix", ", s AS (SELECT id AS idx, llm_tokens_in + llm_tokens_out AS cost FROM log WHERE reranked = 1 AND id % 5 <> 0) SELECT idx, cost, CAST(sum(cost) OVER (ORDER BY idx) AS BIGINT) AS spent, sum(cost) OVER (ORDER BY idx) <= 100000 AS runs FROM s")
def budget_prefix(spark, sf_dir):
    """Reranked queries as a run that resumes: those done are left out, the rest run while the budget lasts."""
    cases = table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]).where("reranked = 1").select(F.col("id").alias("idx"), (F.col("llm_tokens_in") + F.col("llm_tokens_out")).alias("cost"))
    return E.within_budget(cases, "cost", 100_000, cases.where("idx % 5 = 0"))


@_query("savings_at_precision", _METRICS + f", a AS (SELECT {_MEANS} FROM m), s AS (SELECT greatest(0, sum(would_have_read_tokens) - sum(top_result_tokens) - sum(response_tokens_est)) AS saved FROM log) SELECT CAST(saved AS BIGINT) AS saved, CAST(round_even(saved * hit_1, 0) AS BIGINT) AS at_precision FROM s, a")
def savings_at_precision(spark, sf_dir):
    """Tokens saved, discounted by how often the first result is right; null without an evaluation."""
    total = usage.savings(usage.clean_log(table(spark, sf_dir, "mcp_queries"))).select("saved")
    # One row each.
    both = total.crossJoin(F.broadcast(ir_metrics(spark, sf_dir).select("hit_1")))
    return both.select("saved", F.bround(F.col("saved") * F.col("hit_1"), 0).cast("long").alias("at_precision"))


@_query(
    "latest_precision",
    """, timed AS (SELECT *, CASE WHEN ts >= 1420070400 AND ts < 1767225600 THEN ts WHEN ts / 1e3 >= 1420070400 AND ts / 1e3 < 1767225600 THEN ts / 1e3 WHEN ts / 1e6 >= 1420070400 AND ts / 1e6 < 1767225600 THEN ts / 1e6 END AS t FROM log),
    runs AS (SELECT CAST(floor(t / 86400) AS BIGINT) AS ts, round(avg(CASE WHEN top1_changed = 0 THEN 1 ELSE 0 END), 6) AS hit_1 FROM timed WHERE t IS NOT NULL GROUP BY 1),
    s AS (SELECT CAST(greatest(0, sum(would_have_read_tokens) - sum(top_result_tokens) - sum(response_tokens_est)) AS BIGINT) AS saved FROM log)
    SELECT saved, ts, hit_1, CAST(round_even(saved * hit_1, 0) AS BIGINT) AS at_precision FROM s, (SELECT * FROM runs ORDER BY ts DESC LIMIT 1)""",
)
def latest_precision(spark, sf_dir):
    """Each day of the log as a measured run; the tokens saved count at the precision of the newest."""
    log = usage.clean_log(table(spark, sf_dir, "mcp_queries"))
    runs = log.where("at is not null").groupBy(F.floor(F.col("at") / 86400).alias("ts")).agg(F.round(F.avg(F.when(F.col("top1_changed") == 0, 1).otherwise(0)), 6).alias("hit_1"))
    return E.at_precision(usage.savings(log).select("saved"), E.newest_run(runs))


@_query("savings_bench", _RATIO + "SELECT count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, (SELECT round(sum(greatest(0, would_have_read_tokens - response_tokens_est)) / sum(would_have_read_tokens), 6) FROM log WHERE would_have_read_tokens > 0 AND response_tokens_est IS NOT NULL) AS pooled FROM x")
def savings_bench(spark, sf_dir):
    """Share of tokens saved a query: mean, median and pooled. Queries that would have read nothing take no part."""
    log = table(spark, sf_dir, "mcp_queries").dropDuplicates(["id"]).where("would_have_read_tokens > 0 and response_tokens_est is not null")
    saved = F.greatest(F.lit(0), F.col("would_have_read_tokens") - F.col("response_tokens_est"))
    ratio = F.round(saved / F.col("would_have_read_tokens"), 6)
    return log.agg(F.count("*").alias("n"), F.round(F.avg(ratio), 6).alias("mean"), F.round(F.median(ratio), 6).alias("median"), F.round(F.sum(saved) / F.sum("would_have_read_tokens"), 6).alias("pooled"))


@_query("code_bench")
def code_bench(spark, sf_dir):
    """How often a piece of code is found by the names it defines: the first of the five most similar, or among them."""
    chunks = code.chunk_code(code.fenced_code(table(spark, sf_dir, "docs")), most=60).withColumn("id", F.xxhash64("doc_id", "block_no", "chunk_no"))
    named = materialize(chunks.select("id", F.col("content").alias("text"), "label"))
    asked = named.where("label not rlike '^L[0-9]+:'").select(F.col("id").alias("qid"), F.col("label").alias("query"))
    found = retrieval.near_texts(named, asked, 5)
    return E.mean_metrics(E.rank_metrics(found, asked.select("qid", F.col("qid").alias("id")), 5))
