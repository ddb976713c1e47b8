"""Validation of matrices and vectors as single aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pointer_violations(pointers: DataFrame, matrix: DataFrame, n: int) -> DataFrame:
    """Counts of broken CSR rules: pointers (pos, ptr), entries with columns outside 0..n-1, ends that do not match."""
    # neighbours are compared by a join on the position: no task sees all pointers
    after = pointers.select((F.col("pos") - 1).alias("pos"), F.col("ptr").alias("next"))
    steps = pointers.join(after, "pos").agg(F.count_if(F.col("next") < F.col("ptr")).alias("decreasing"))
    ends = pointers.agg(F.count("*").alias("n_ptr"), F.min_by("ptr", "pos").alias("first"), F.max_by("ptr", "pos").alias("last"))
    entries = matrix.agg(F.count("*").alias("nnz"), F.count_if((F.col("col_id") < 0) | (F.col("col_id") >= n)).alias("bad_columns"))
    # three rows of aggregates
    return ends.crossJoin(steps).crossJoin(entries).select(
        (F.col("n_ptr") < 2).cast("long").alias("too_short"),
        (F.coalesce("first", F.lit(-1)) != 0).cast("long").alias("bad_first"),
        (F.coalesce("last", F.lit(-1)) != F.col("nnz")).cast("long").alias("bad_last"),
        "decreasing",
        "bad_columns",
    )


def diagonal_violations(matrix: DataFrame, rows: DataFrame, eps: float = 1e-30) -> DataFrame:
    """Counts of rows without a diagonal entry and with one not above ``eps`` in size."""
    diag = matrix.where("row_id = col_id").groupBy(F.col("row_id").alias("idx")).agg(F.sum("value").alias("d"))
    return rows.select("idx").join(diag, "idx", "left").agg(F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.abs("d") <= eps).alias("too_small"))


def require_clean(violations: DataFrame) -> None:
    """Raise ValueError naming the counts that are not zero."""
    bad = {k: v for k, v in violations.first().asDict().items() if v}
    if bad:
        raise ValueError(f"invalid matrix: {bad}")


def row_steps(pointers: DataFrame) -> DataFrame:
    """(row_id, begin, end) of consecutive pointers (pos, ptr), by blocks of positions."""
    after = pointers.select((F.col("pos") - 1).alias("row_id"), F.col("ptr").alias("end"))
    return pointers.select(F.col("pos").alias("row_id"), F.col("ptr").alias("begin")).join(after, "row_id")


def outside(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries whose row or column is not an idx of ``rows``; none if the matrix is square over them."""
    known = rows.select("idx")
    ids = matrix.select(F.explode(F.array("row_id", "col_id")).alias("idx")).distinct()
    return ids.join(known, "idx", "left_anti")
