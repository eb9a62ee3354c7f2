"""The driver's tables as inputs of the analysis: clouds, labels, predictions, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.settings import ALTITUDES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree, x, y, z, source, altitude``: line items of a supplier as points of a tree, dealt to sensors and altitudes."""
    altitude = F.get(F.array(*map(F.lit, ALTITUDES)), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(ALTITUDES))).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tree"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("double").alias("z"), F.when(F.col("l_returnflag") == "R", "H300").otherwise("L1").alias("source"), altitude.alias("altitude"))


def exact_mean(value: Column) -> Column:
    """The mean of finite values by an exact sum, so that rows in any order give the same; the plain mean where a value isn't finite."""
    finite = ~F.isnan(value) & (F.abs(value) < 1e9)
    exact = F.sum(F.when(finite, value).cast("decimal(28,18)")).cast("double") / F.count(value)
    return F.when(F.count(value) == F.count_if(finite), exact).otherwise(F.avg(value))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree, field, class, source, x`` per supplier and source: a feature value with nulls, for fits and comparisons."""
    share = exact_mean((F.col("y") >= 25).cast("double") + F.col("x") / 1000)
    rows = cloud(spark, sf_dir).groupBy("tree", "source").agg(share.alias("x"))
    return rows.select("tree", (F.col("tree") % 4 + 1).cast("int").alias("field"), (F.col("tree") % 5).cast("int").alias("class"), "source", F.when(F.col("tree") % 17 != 0, F.round("x", 9)).alias("x"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, method, field, truth, pred``: an order's priority against two classes derived from its price."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 4 + 1).cast("int").alias("field"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("truth"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    pred = F.explode(F.array(F.struct(F.lit("A").alias("method"), (F.col("cents") % 5).cast("int").alias("pred")), F.struct(F.lit("B").alias("method"), F.when(F.col("cents") % 3 == 0, F.col("truth")).otherwise(F.floor(F.col("cents") / 10) % 5).cast("int").alias("pred"))))
    return orders.select("key", "field", "truth", pred.alias("s")).select("key", "field", "truth", "s.*")


#: The same, for the oracle.
SQL = """
cloud AS (SELECT l_suppkey AS tree, l_extendedprice / 1000 AS x, l_quantity AS y, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::DOUBLE AS z, CASE WHEN l_returnflag = 'R' THEN 'H300' ELSE 'L1' END AS source FROM lineitem),
observations AS (SELECT tree, (tree % 4 + 1)::INT AS field, (tree % 5)::INT AS class, source, CASE WHEN tree % 17 <> 0 THEN round(avg((y >= 25)::INT::DOUBLE + x / 1000), 9) END AS x FROM cloud GROUP BY tree, source),
orders5 AS (SELECT o_orderkey AS key, (o_custkey % 4 + 1)::INT AS field, left(o_orderpriority, 1)::INT - 1 AS truth, floor(o_totalprice * 100)::BIGINT AS cents FROM orders),
predictions AS (SELECT key, 'A' AS method, field, truth, (cents % 5)::INT AS pred FROM orders5 UNION ALL SELECT key, 'B', field, truth, CASE WHEN cents % 3 = 0 THEN truth ELSE ((cents // 10) % 5)::INT END FROM orders5)
"""
