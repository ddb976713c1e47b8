"""Deterministic symmetric positive definite grid matrix and its vectors."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_shape(size: int, aspect: float = 1.0) -> tuple[int, int]:
    cols = max(1, ceil(sqrt(size * aspect)))
    return max(1, ceil(size / cols)), cols


def _nodes(spark: SparkSession, size: int, cols: int) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("i"), F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))


# Edge weights, mass term and vectors of the generator.
def _horizontal(r: Column, c: Column) -> Column:
    return F.greatest(F.lit(0.35), 1.4 + 0.18 * F.sin(0.17 * r) + 0.11 * F.cos(0.09 * c) + F.when(F.floor(r / 9) % 2 == 0, 0.22).otherwise(-0.08))


def _vertical(r: Column, c: Column) -> Column:
    return F.greatest(F.lit(0.25), 0.95 + 0.15 * F.cos(0.13 * r) + 0.14 * F.sin(0.11 * c) + F.when(F.floor(c / 11) % 3 == 1, 0.20).otherwise(0.02))


def _contact(r: Column, c: Column) -> Column:
    return 0.08 + 0.03 * (1.0 + F.sin(0.23 * r + 0.19 * c))


def _mass(i: Column, r: Column, c: Column) -> Column:
    return 0.18 + 0.04 * F.sin(0.07 * i) + 0.03 * F.cos(0.15 * r - 0.08 * c)


def grid_edges(spark: SparkSession, size: int, aspect: float = 1.0) -> DataFrame:
    """Weighted undirected edges (i, j, w) of the grid."""
    _, cols = grid_shape(size, aspect)
    n = _nodes(spark, size, cols)
    i, r, c = F.col("i"), F.col("r"), F.col("c")
    kinds = (
        (c + 1 < cols, i + 1, _horizontal(r, c)),
        (F.lit(True), i + cols, _vertical(r, c)),
        ((r % 13 == 5) & (c % 7 == 2) & (c + 1 < cols), i + 2 * cols + 1, _contact(r, c)),
        ((r % 10 == 3) & (c % 9 == 4) & (c > 0), i + cols - 1, 0.85 * _contact(r, c)),
    )
    rows = F.array(*(F.struct(ok.alias("ok"), j.alias("j"), w.alias("w")) for ok, j, w in kinds))
    e = n.select("i", F.explode(rows).alias("e")).select("i", "e.*")
    return e.where(F.col("ok") & (F.col("j") < size) & (F.col("i") != F.col("j")) & (F.col("w") > 0)).select("i", "j", "w")


def grid_matrix(spark: SparkSession, size: int, aspect: float = 1.0) -> DataFrame:
    """Graph Laplacian of the grid plus the mass term."""
    _, cols = grid_shape(size, aspect)
    e = grid_edges(spark, size, aspect)
    both = e.select(F.col("i").alias("row_id"), F.col("j").alias("col_id"), "w").unionAll(e.select(F.col("j"), F.col("i"), "w"))
    off = both.groupBy("row_id", "col_id").agg((-F.sum("w")).alias("value"))
    mass = _nodes(spark, size, cols).select(F.col("i").alias("row_id"), _mass(F.col("i"), F.col("r"), F.col("c")).alias("w"))
    diag = both.select("row_id", "w").unionAll(mass).groupBy("row_id").agg(F.sum("w").alias("value")).select("row_id", F.col("row_id").alias("col_id"), "value")
    return off.unionByName(diag)


def grid_solution(spark: SparkSession, size: int, aspect: float = 1.0) -> DataFrame:
    """Reference solution on the grid."""
    _, cols = grid_shape(size, aspect)
    i = F.col("i")
    bump = 0.28 * F.exp(-F.pow((i - max(1, size - 1) * 0.63) / max(8.0, size * 0.07), 2))
    return _nodes(spark, size, cols).select(i.alias("idx"), (0.75 + 0.18 * F.sin(0.06 * F.col("r")) + 0.12 * F.cos(0.08 * F.col("c")) + 0.0009 * i + bump).alias("value"))


def grid_guess(spark: SparkSession, size: int, aspect: float = 1.0) -> DataFrame:
    """Initial guess on the grid."""
    _, cols = grid_shape(size, aspect)
    i = F.col("i")
    return _nodes(spark, size, cols).select(i.alias("idx"), (0.09 * F.cos(0.04 * i) - 0.06 * F.sin(0.09 * F.col("r")) + 0.03 * F.cos(0.21 * F.col("c"))).alias("value"))


def line_solution(spark: SparkSession, size: int) -> DataFrame:
    """Reference solution of converted data sets."""
    i = F.col("id")
    bump = 0.28 * F.exp(-F.pow((i - max(1, size - 1) * 0.63) / max(8.0, size * 0.07), 2))
    return spark.range(size).select(i.alias("idx"), (0.75 + 0.18 * F.sin(0.013 * i) + 0.12 * F.cos(0.017 * i) + 0.0000009 * i + bump).alias("value"))
