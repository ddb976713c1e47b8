"""Matrices derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by parts, value = quantity bought (exact in doubles)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_quantity").alias("value"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian of suppliers sharing orders, plus the identity: symmetric positive definite."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null")
    # an order has few lines, so its pairs are few; each is counted once and mirrored after it is summed
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    pairs = orders.select("s", F.explode("s").alias("low")).select("low", F.explode("s").alias("high")).where("low < high")
    half = pairs.groupBy("low", "high").agg((-F.count("*")).cast("double").alias("value"))
    edges = half.select(F.inline(F.array(*(F.struct(F.col(a).alias("row_id"), F.col(b).alias("col_id"), "value") for a, b in (("low", "high"), ("high", "low"))))))
    # an order adds its other suppliers to the degree of each
    degree = orders.select(F.explode("s").alias("row_id"), (F.size("s") - 1).alias("n")).groupBy("row_id").agg(F.sum("n").cast("double").alias("w"))
    diag = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id")).join(degree, "row_id", "left")
    return edges.unionByName(diag.select("row_id", F.col("row_id").alias("col_id"), (F.coalesce("w", F.lit(0.0)) + 1).alias("value")))


def supplier_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_suppkey").cast("double").alias("value"))


def ids(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Index column of a dimension table."""
    return table(spark, sf_dir, name).select(F.col(key).alias("idx"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by parts, value = quantity, where a third of all lines stands in column 0: a column that no hash can split."""
    lines = table(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.select(line.alias("row_id"), F.when(line % 3 == 0, F.lit(0)).otherwise(F.col("l_partkey")).cast("long").alias("col_id"), F.col("l_quantity").alias("value"))
