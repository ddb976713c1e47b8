"""Figures of measured runs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the measured stages of a solve, by what they do.
PRODUCT_STAGES = ("init_spmv", "iter_spmv")
VECTOR_STAGES = ("init_zp", "update_x", "update_rz_reduce", "update_p")


def gflops(nnz: Column, calls: Column, ms: Column) -> Column:
    """Two operations for each entry and call, in 1e9 a second; 0 for no time."""
    return F.when(ms > 0, 2.0 * nnz * calls / (ms * 1e-3) / 1e9).otherwise(0.0)


def stage_totals(runs: DataFrame) -> DataFrame:
    """``runs`` (milliseconds of the stages and ``controller_total``) with totals; a rounding error below 0 in the rest counts as 0."""
    total = lambda stages: sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    out = runs.withColumn("spmv_total", total(PRODUCT_STAGES)).withColumn("vector_total", total(VECTOR_STAGES))
    out = out.withColumn("accounted", F.col("spmv_total") + F.col("vector_total"))
    rest = F.col("controller_total") - F.col("accounted")
    return out.withColumn("unaccounted", F.when((rest < 0) & (rest > -1e-9), 0.0).otherwise(rest))
