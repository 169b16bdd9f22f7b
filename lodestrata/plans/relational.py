"""Plain relational queries over the star schema: joins, aggregates, windows, sets and top-k."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.catalog import table

QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        ORACLES[name] = sql
        return f

    return add


def _money(c):
    """Sums of money as decimals, so that they do not depend on the order."""
    return F.sum(c.cast("decimal(24,6)")).cast("double")


_AMOUNT = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24,6))"


@_query("pricing_summary", f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(24,6))) AS DOUBLE) AS quantity, CAST(sum({_AMOUNT}) AS DOUBLE) AS amount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(t):
    rows = t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _money(F.col("l_quantity")).alias("quantity"), _money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))


@_query("join_agg", f"SELECT n_name, o_orderpriority, count(*) AS n, CAST(sum({_AMOUNT}) AS DOUBLE) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    joined = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), _money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))


@_query("order_topk", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@_query("segment_rollup", "SELECT r_name, n_name, grouping_id(r_name, n_name) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@_query("idle_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    """Customers without an urgent order."""
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@_query("busy_customers", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    large = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@_query("suppliers_per_part", "SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def _(t):
    joined = t("lineitem").select("l_partkey", "l_suppkey").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand", "p_type").agg(F.count_distinct("l_suppkey").alias("suppliers")).where("suppliers > 1")


@_query("latest_orders", "SELECT o_custkey, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def _(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t("orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("k", k).where("k <= 3").select("o_custkey", "o_orderkey", "k")


@_query("key_sets", "(SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5) EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def _(t):
    part = lambda w: t("lineitem").where(w).select(F.col("l_partkey").alias("key"))
    return part("l_quantity > 45").intersect(part("l_quantity < 5")).subtract(t("part").where("p_size > 25").select(F.col("p_partkey").alias("key")))


@_query("event_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")
def _(t):
    seen = t("events").where(F.col("event_type").isin("click", "view", "error"))
    pivoted = seen.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.count(F.lit(1)))
    users = t("events").select("user_id").distinct()
    return users.join(pivoted, "user_id", "left").na.fill(0)


@_query("event_json", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t("events").groupBy(F.from_json("props", "k int")["k"].alias("k"), "event_type").agg(F.count("*").alias("n"))


@_query("events_hourly", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    """The batch twin of the hourly stream."""
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return t("events").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@_query("label_vectors", "SELECT label, count(*) AS n, round(avg(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 5) AS mean_norm FROM embeddings GROUP BY label")
def _(t):
    norm = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 5).alias("mean_norm"))
