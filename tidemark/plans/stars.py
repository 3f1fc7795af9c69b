"""Plain relational queries: joins, roll-ups, top-k and set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import tables as t
from .registry import query


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, sf_dir):
    li = t.read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("select n_name, r_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def orders_rollup(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    geo = t.read(spark, sf_dir, "nation").join(t.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return o.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
def top_orders(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("_r", rank).where("_r <= 2").drop("_r")


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def customers_without_big_orders(spark, sf_dir):
    big = t.read(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return t.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(big, "c_custkey", "left_anti")
