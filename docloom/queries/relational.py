"""The relational layer under the documents: joins, aggregates, windows, sets, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.queries.registry import query, table


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables are left to Spark's size check; the big join shuffles on the order key."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT a.event_id, count(b.event_id) AS near FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY GROUP BY a.event_id
""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user within a day after each, as a frame over time and not as pairs."""
    own = Window.partitionBy("user_id").orderBy("at").rangeBetween(1, 86_400_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").withColumn("at", at).select("event_id", F.count("event_id").over(own).alias("near"))


@query("""
SELECT event_id, (SELECT arg_max(value, event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id < a.event_id) AS last_purchase FROM events a
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last purchase before it: one sort, no pairs."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.last(bought, True).over(before).alias("last_purchase"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return df.groupingSets([[f], [s], []], f, s).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users, and whether the sketch is within a tenth of them.

    Beside an exact count Spark keeps a sketch for each type and user; copies of a value do
    not change a sketch, so it takes the distinct ones.
    """
    pairs = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    found = pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return found.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.1 * F.col("users") + 2).alias("near"))


@query("SELECT event_id, row_number() OVER w AS place, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("place"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("recent"), F.lag("event_type").over(w).alias("before"))


@query("""
SELECT user_id, start, count(*) AS n FROM (
  SELECT user_id, ts, max(CASE WHEN new THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start
  FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events)) GROUP BY 1, 2
""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("s.start").alias("start"), "n")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k, 'union' AS kind FROM customer UNION SELECT s_nationkey, 'union' FROM supplier UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'only' FROM customer EXCEPT SELECT s_nationkey, 'only' FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return named(a.union(b).distinct(), "union").unionByName(named(a.intersect(b), "both")).unionByName(named(a.subtract(b), "only"))


@query("SELECT l.quality, d.lang, count(*) AS n, round(avg(d.n_chars), 4) AS chars FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2")
def join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads two columns of the documents, never their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"))
