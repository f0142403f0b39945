"""Observation and feature tables over the TPC-H-like test tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where a small table is read in fewer: for costly work on each row.

    A large table has more tasks than cores and stays as it is; what moves is what ``df`` has selected.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


LINE_FEATURES = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
FOREST_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def obs_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: features null at line 3 and NaN at line 5; arms from the return flag; outcome F or not."""
    line = F.col("l_linenumber")
    gap = lambda c: F.when(line == 3, F.lit(None)).when(line == 5, F.lit(math.nan)).otherwise(F.col(c).cast("double")).alias(c)
    arm = F.when(F.col("l_returnflag") == "A", "control").when(F.col("l_returnflag") == "N", "t1").otherwise("t2")
    return table(spark, sf_dir, "lineitem").select(*[gap(c) for c in LINE_FEATURES], arm.alias("treatment"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("outcome"))


def obs_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of ``obs_line`` with their discounted price as a real outcome."""
    line, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("double")
    gap = lambda c: F.when(line == 3, F.lit(None)).when(line == 5, F.lit(math.nan)).otherwise(F.col(c).cast("double")).alias(c)
    arm = F.when(F.col("l_returnflag") == "A", "control").when(F.col("l_returnflag") == "N", "t1").otherwise("t2")
    return table(spark, sf_dir, "lineitem").select(*[gap(c) for c in LINE_FEATURES], arm.alias("treatment"), (price * (1.0 - F.col("l_discount").cast("double"))).alias("outcome"))


def obs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers: balance and price; arms are market segments; outcome is status F or not."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return rows.select(F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("c_mktsegment").alias("treatment"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("outcome"))


def forest_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the forest's features as doubles, prices null at line 3 and NaN at line 5."""
    line = F.col("l_linenumber")
    price = F.when(line == 3, F.lit(None)).when(line == 5, F.lit(math.nan)).otherwise(F.col("l_extendedprice").cast("double"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey"), F.col("l_suppkey"), *[(price if c == "l_extendedprice" else F.col(c).cast("double")).alias(c) for c in FOREST_FEATURES]
    )


def wide_line(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Line items with n features w0, w1, ...: sums of price and quantity by weights that differ; arms and outcome."""
    rows = spread(obs_line(spark, sf_dir))
    wide = [(F.col("l_extendedprice") * F.lit(float(1 + k % 7)) + F.col("l_quantity") * F.lit(float(k))).alias(f"w{k}") for k in range(n)]
    return rows.select(*wide, "treatment", "outcome")


#: Expressions of ``deep_input``'s features, in turn; K is the feature's number.
DEEP_FEATURES = ("price / 50000.0D - 1.0D", "quantity / 25.0D - 1.0D", "cast((okey + K) % 4 as double)", "discount * 10.0D - 0.5D")


def deep_input(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Line items with n features of about -1 to 1 or of four categories; prices are null at line 3 and NaN at line 5."""
    price = "CASE l_linenumber WHEN 3 THEN NULL WHEN 5 THEN double('NaN') ELSE cast(l_extendedprice AS double) END AS price"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber AS line", "l_partkey", "l_suppkey", price, "cast(l_quantity AS double) AS quantity", "cast(l_discount AS double) AS discount", "l_orderkey AS okey"
    )
    return spread(rows).selectExpr("l_orderkey", "line", "l_partkey", "l_suppkey", *[f"{DEEP_FEATURES[k % 4].replace('K', str(k))} AS d{k}" for k in range(n)])


def planted_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of nodes: for each part a complete tree of 15 nodes, with one of six faults by its key, or none.

    1: the root is a child; 2: a node has two parents; 3: two links of one parent lead to one node; 4: a loop of
    two nodes, apart from the root; 5: a tree of five levels; 6: a child that the tree lacks.
    """
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tree"), (F.col("p_partkey") % 7).cast("int").alias("kind"))
    rows = rows.select("tree", "kind", F.explode(F.sequence(F.lit(0), F.lit(18))).alias("node")).where("node < 15 or kind = 5")
    inner = "node < 7 or kind = 5 and node in (14, 16)"
    left = "case when kind = 2 and node = 3 then 1 when kind = 4 and node = 0 then 2 when kind = 6 and node = 5 then 99 when kind = 5 and node >= 14 then node + 1 else 2 * node + 1 end"
    right = "case when kind = 1 and node = 6 then 0 when kind = 3 and node = 2 then 5 when kind = 4 and node = 4 then 1 when kind = 5 and node >= 14 then node + 2 else 2 * node + 2 end"
    return rows.selectExpr("tree", "node", f"if({inner}, 1, 0) AS node_type", f"{left} AS left_child", f"{right} AS right_child")
