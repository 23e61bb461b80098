"""General relational forms over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import sessions as ss
from lodestone.plans.registry import query
from lodestone.sources.overlay import read


@query("hierarchy_rollup", "SELECT r_name, n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().cast("bigint").alias("level"))


@query("customers_with_orders", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("customers_without_orders", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("price_bands", "SELECT low, high, count(*) AS parts FROM part JOIN (VALUES (0, 1000), (1000, 1300), (1300, 1700), (1700, 100000)) b(low, high) ON p_retailprice >= low AND p_retailprice < high GROUP BY ALL")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 1000), (1000, 1300), (1300, 1700), (1700, 100000)], "low int, high int")
    p = read(spark, sf_dir, "part")
    return p.join(F.broadcast(bands), (p.p_retailprice >= bands.low) & (p.p_retailprice < bands.high)).groupBy("low", "high").agg(F.count("*").alias("parts"))


@query("last_purchase_before_error", "SELECT l.event_id, l.user_id, r.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def last_purchase_before_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return ss.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "value").select("event_id", "user_id", "last_value")


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    sides = {"both": c.intersect(s), "customer_only": c.exceptAll(s.distinct()).distinct().join(s, "k", "left_anti"), "either": c.union(s).distinct()}
    counts = [x.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, x in sides.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("top_orders", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", place.alias("place")).where("place <= 3")


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("segment_cube", "SELECT c_mktsegment, n_regionkey, count(*) AS customers, CAST(grouping(c_mktsegment, n_regionkey) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)")
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).cube("c_mktsegment", "n_regionkey").agg(F.count("*").alias("customers"), F.grouping_id().cast("bigint").alias("level"))


SETS = "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())"


@query("grouping_sets", f"SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY {SETS}")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return read(spark, sf_dir, "lineitem").groupingSets([[a, b], [b], []], a, b).agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


@query("orders_without_returns", "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def orders_without_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, back = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return orders.join(back, orders.o_orderkey == back.l_orderkey, "left_anti").select("o_orderkey", "o_custkey")
