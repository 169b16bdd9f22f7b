"""Measuring retrieval and savings: rank metrics, exact quantiles, gates and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(qid, hit_1, hit_k, reciprocal, recall, missed) of ranked(qid, id, rank from 0) for each query of labels(qid, id); queries without labels take no part."""
    found = labels.distinct().join(ranked.where(F.col("rank") < k), ["qid", "id"], "left")
    by = found.groupBy("qid").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.count("rank").alias("n_found"))
    hit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return by.select("qid", hit(F.col("first") < 1).alias("hit_1"), hit(F.col("first") < k).alias("hit_k"), F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("reciprocal"), F.round(F.col("n_found") / F.col("n"), 6).alias("recall"), F.col("first").isNull().alias("missed"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit_1", "hit_k", "reciprocal", "recall")], F.count_if(F.col("missed")).alias("misses"))


def exclusive_quantiles(rows: DataFrame, value: str, points: list[float], *keys: str) -> DataFrame:
    """(keys, q, value): quantiles by the exclusive rule, at place p(n + 1) between neighbours; for a single value that value.

    Ranks come from the counts of distinct values, so only those are ordered,
    and no group's rows are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("hi", F.sum("n").over(order)).withColumn("lo", F.col("hi") - F.col("n") + 1).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    points_ = F.explode(F.array(*[F.lit(p) for p in points]))
    placed = upto.withColumn("q", points_).withColumn("h", F.col("q") * (F.col("total") + 1))
    placed = placed.withColumn("j", F.greatest(F.lit(1), F.least(F.col("total") - 1, F.floor("h"))))
    at = lambda j: F.max(F.when((F.col("lo") <= j) & (F.col("hi") >= j), F.col(value)))
    got = placed.groupBy(*keys, "q").agg(F.max("total").alias("total"), F.max("h").alias("h"), F.max("j").alias("j"), at(F.col("j")).alias("a"), at(F.col("j") + 1).alias("b"))
    return got.select(*keys, "q", F.round(F.when(F.col("total") == 1, F.col("a")).otherwise(F.col("a") + (F.col("h") - F.col("j")) * (F.col("b") - F.col("a"))), 6).alias("value"))


def nearest_rank(rows: DataFrame, value: str, points: list[float], *keys: str) -> DataFrame:
    """(keys, q, value): the value at place round(q (n - 1)) from 0, halves to even."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("hi", F.sum("n").over(Window.partitionBy(*keys).orderBy(value))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    placed = upto.withColumn("q", F.explode(F.array(*[F.lit(p) for p in points]))).withColumn("j", F.bround(F.col("q") * (F.col("total") - 1), 0))
    return placed.groupBy(*keys, "q").agg(F.min(F.when(F.col("hi") > F.col("j"), F.col(value))).alias("value"))


def equal_success(cases: DataFrame) -> DataFrame:
    """(category, n, both, saved_pct, wins, losses) of cases(category, base_ok, base_tokens, ok, tokens): savings count only where both answers are right; a wrong cheaper answer is a loss. Every category seen is reported."""
    both = F.col("base_ok") & F.col("ok")
    base, own = F.sum(F.when(both, F.col("base_tokens"))), F.sum(F.when(both, F.col("tokens")))
    return cases.groupBy("category").agg(F.count("*").alias("n"), F.count_if(both).alias("both"), F.round(F.try_divide(100.0 * (base - own), base), 6).alias("saved_pct"), F.count_if(F.col("ok") & ~F.col("base_ok")).alias("wins"), F.count_if(F.col("base_ok") & ~F.col("ok")).alias("losses"))


def run_cases(cases: DataFrame, hits: DataFrame, texts: DataFrame, answer, judge, k: int = 3) -> DataFrame:
    """Both arms of an evaluation: one row per case(qid, query, category, ...) as equal_success() takes them.

    hits(qid, id, rank) are what a search found, texts(id, text, line) what can
    be read of it and the line it is listed by. One arm reads the first hit and
    the listing, the other the first k hits. answer(query, context) gives a
    column of the answer, judge(case row's columns by name, answer) whether it is
    right; both are injected and get columns. Tokens are those of the context,
    the answer, and in the first arm the listing. A case without hits reads an
    empty context.
    """
    read = hits.where(F.col("rank") < k).join(texts, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("line", F.lit("")).alias("line")))).alias("h"))
    joined = lambda f, by: F.coalesce(F.array_join(F.transform("h", lambda x: x[f]), by), F.lit(""))
    first = F.coalesce(F.when(F.try_element_at("h", F.lit(1))["rank"] == 0, F.try_element_at("h", F.lit(1))["text"]), F.lit(""))
    rows = cases.join(read, "qid", "left").withColumns({"_own": first, "_base": joined("text", "\n\n"), "_listing": joined("line", "\n")})
    rows = rows.withColumns({"_said": answer(F.col("query"), F.col("_own")), "_base_said": answer(F.col("query"), F.col("_base"))})
    n = lambda c: F.floor(F.char_length(c) / 4)
    return rows.select("qid", "category", judge(rows, F.col("_base_said")).alias("base_ok"), (n("_base") + n("_base_said")).alias("base_tokens"), judge(rows, F.col("_said")).alias("ok"), (n("_own") + n("_said") + n("_listing")).alias("tokens"))


def newest_run(runs: DataFrame) -> DataFrame:
    """(ts, hit_1) of the newest of runs(ts, hit_1): one row, of nulls if there is none or no run was measured."""
    known = runs.where("ts is not null and hit_1 is not null")
    return known.agg(F.max("ts").alias("ts"), F.max_by("hit_1", F.struct("ts", "hit_1")).alias("hit_1"))


def at_precision(saved: DataFrame, run: DataFrame) -> DataFrame:
    """saved(saved) beside a run(ts, hit_1), with the tokens that count at its precision, halves to even; null where nothing was measured, never the raw sum."""
    # One row each.
    return saved.crossJoin(F.broadcast(run)).withColumn("at_precision", F.bround(F.col("saved") * F.col("hit_1"), 0).cast("long"))


#: Weights of a judge's marks.
WEIGHTS = {"correctness": 0.35, "autonomy": 0.25, "actionability": 0.20, "safety": 0.10, "concision": 0.10}


def weighted_marks(marks: DataFrame) -> DataFrame:
    total = sum((F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c, F.lit(0)))) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return marks.withColumn("weighted", F.round(total, 6))


def within_budget(cases: DataFrame, cost: str, budget: float, done: DataFrame | None = None) -> DataFrame:
    """Cases(idx, cost) in order of idx with whether they still fit the budget; those done before (idx) are left out.

    Running sums are taken within blocks of 65,536 numbers, each in a task of its
    own; only the blocks' sums, one row each, are summed in one place.
    """
    left = (cases if done is None else cases.join(done.select("idx"), "idx", "left_anti")).withColumn("_block", F.shiftright("idx", 16))
    sums = left.groupBy("_block").agg(F.sum(cost).alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    spent = F.sum(cost).over(Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    out = left.withColumn("_spent", spent).join(before, "_block").withColumn("spent", F.round(F.col("_before") + F.col("_spent"), 6))
    return out.drop("_block", "_before", "_spent").withColumn("runs", F.col("spent") <= budget)


def gate(metrics: DataFrame, least_hit_1: float, least_n: int) -> DataFrame:
    """(passed, reasons): fails closed, with every reason."""
    reasons = F.concat_ws("; ", F.when(F.coalesce("n", F.lit(0)) < least_n, "too few cases"), F.when(F.col("hit_1").isNull(), "nothing was scored"), F.when(F.col("hit_1") < least_hit_1, "hit@1 is too low"))
    return metrics.select((reasons == "").alias("passed"), reasons.alias("reasons"))
