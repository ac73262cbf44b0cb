"""Registered queries: the engine's relational primitives (joins, set operations, aggregates, top k) over the larger star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model


def _t(spark, d, name):
    return model.table(spark, d, name)


def rel_semi(spark, d):
    rich = _t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


def rel_anti(spark, d):
    rich = _t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(rich, "c_custkey", "left_anti").select("c_custkey")


def rel_union(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(_t(spark, d, "supplier").select("s_nationkey")).distinct()


def rel_intersect(spark, d):
    return _t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("part")).intersect(_t(spark, d, "part").filter("p_size < 20").select("p_partkey"))


def rel_except(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("part")).exceptAll(_t(spark, d, "lineitem").filter("l_quantity > 40").select("l_partkey").distinct())


def rel_topk(spark, d):
    return _t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


def rel_pricing(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    g = _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def rel_region_revenue(spark, d):
    """Five tables; the small ones are left to the planner's size check."""
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    rows = _t(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("l_orderkey").alias("orders"))


def rel_full_outer(spark, d):
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = _t(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


QUERIES = {
    "rel_semi": (rel_semi, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "rel_anti": (rel_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "rel_union": (rel_union, "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"),
    "rel_intersect": (rel_intersect, "SELECT l_partkey AS part FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20"),
    "rel_except": (rel_except, "SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40"),
    "rel_topk": (rel_topk, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "rel_pricing": (rel_pricing, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "rel_region_revenue": (rel_region_revenue, "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "rel_full_outer": (rel_full_outer, "SELECT coalesce(c.nation, s.nation) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON c.nation = s.nation"),
}
