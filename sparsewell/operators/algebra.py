"""Sparse matrix and vector algebra.

A matrix is ``(row_id, col_id, value)``, a vector ``(idx, value)``.  Products are
an equi-join on the column and a grouped sum on the row; Spark picks the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of one block of a row whose positions are counted together.
COLUMN_BLOCK = 1 << 16
#: Entries of one array of a row.
SEGMENT = 1 << 13
FP64, MIXED, FP32 = "fp64", "fp32mul_fp64acc", "fp32"


def product(value: Column, x: Column, mode: str = FP64) -> Column:
    """Product of a matrix value and a vector value in the precision of ``mode``."""
    if mode == FP64:
        return value * x
    if mode in (MIXED, FP32):
        return (value.cast("float") * x.cast("float")).cast("double" if mode == MIXED else "float")
    raise ValueError(f"unknown precision mode {mode}")


def _folded(terms: DataFrame) -> DataFrame:
    """Sums of single-precision terms (row_id, col_id, p) by row, added one by one in column order.

    Single-precision sums depend on their order, so a row is added by one task;
    it reads its terms in sorted order and holds one batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, np.float32(0)
        for b in batches:
            rows = b.column(0).to_pylist()
            p = b.column(2).to_numpy(zero_copy_only=False).astype(np.float32)
            null = b.column(2).is_null().to_numpy(zero_copy_only=False)
            cuts = [k for k in range(1, len(rows)) if rows[k] != rows[k - 1]]
            done: list[tuple] = []
            for start, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if start == end:
                    continue
                if (rows[start],) != row:
                    if row:
                        done.append((row[0], total))
                    row, total = (rows[start],), np.float32(0)
                if total is not None:  # a null term makes the sum null
                    total = None if null[start:end].any() else np.add.accumulate(np.concatenate([[total], p[start:end]]).astype(np.float32), dtype=np.float32)[-1]
            yield sums(done)
        if row:
            yield sums([(row[0], total)])

    def sums(done: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r for r, _ in done], pa.int64()), pa.array([None if v is None else float(v) for _, v in done], pa.float64())], names=["idx", "value"])

    rows = terms.withColumn("row_id", F.col("row_id").cast("long"))
    return rows.repartition("row_id").sortWithinPartitions("row_id", "col_id", "p").mapInArrow(run, "idx long, value double")


def touched_rows(matrix: DataFrame, x: DataFrame, mode: str = FP64) -> DataFrame:
    """A x, only for rows with an entry whose column x has."""
    joined = matrix.join(x.select(F.col("idx").alias("col_id"), F.col("value").alias("x")), "col_id")
    if mode == FP32:  # in column order, so that rounding does not depend on the partitioning
        return _folded(joined.select("row_id", "col_id", product(F.col("value"), F.col("x"), mode).alias("p")))
    return joined.groupBy("row_id").agg(F.sum(product(F.col("value"), F.col("x"), mode)).alias("value")).withColumnRenamed("row_id", "idx")


def spmv(matrix: DataFrame, x: DataFrame, rows: DataFrame, mode: str = FP64, y: DataFrame | None = None) -> DataFrame:
    """y + A x for every idx of ``rows``; rows without entries give 0 (or y)."""
    out = rows.select("idx").join(touched_rows(matrix, x, mode), "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    return axpy(1.0, out, y) if y is not None else out


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a x + y over equal indices."""
    return x.join(y.select("idx", F.col("value").alias("_y")), "idx").select("idx", (a * F.col("value") + F.col("_y")).alias("value"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: sum of products over equal indices."""
    return x.join(y.select("idx", F.col("value").alias("_y")), "idx").agg(F.coalesce(F.sum(F.col("value") * F.col("_y")), F.lit(0.0)).alias("dot"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def merge_duplicates(matrix: DataFrame) -> DataFrame:
    """Sum entries of one place and drop zeros before and after."""
    return matrix.where("value <> 0").groupBy("row_id", "col_id").agg(F.sum("value").alias("value")).where("value <> 0")


def expand_symmetric(matrix: DataFrame) -> DataFrame:
    """Mirror the entries off the diagonal."""
    return matrix.unionByName(transpose(matrix.where("row_id <> col_id")))


def principal(matrix: DataFrame, k: int) -> DataFrame:
    """Leading principal submatrix."""
    return matrix.where((F.col("row_id") < k) & (F.col("col_id") < k))


def diagonal(matrix: DataFrame, merged: bool = True) -> DataFrame:
    """Diagonal entries by row; of repeated ones their sum, or the smallest if not ``merged`` (a table has no first one)."""
    own = matrix.where("row_id = col_id").groupBy(F.col("row_id").alias("idx"))
    return own.agg((F.sum("value") if merged else F.min("value")).alias("value"))


def first_diagonal(entries: DataFrame) -> DataFrame:
    """Diagonal entries (idx, value) by row; of repeated ones that with the smallest ``place``, the first in its file."""
    return entries.where("row_id = col_id").groupBy(F.col("row_id").alias("idx")).agg(F.min_by("value", "place").alias("value"))


def off_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("row_id <> col_id")


def prefix(counts: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(row_id, begin, end) of counts (row_id, n) laid end to end in order of row_id.

    The prefix sum runs inside blocks of rows and over block totals, so no task
    holds all rows.
    """
    blocked = counts.select("row_id", F.floor(F.col("row_id") / block).alias("blk"), F.coalesce("n", F.lit(0)).alias("n"))
    totals = blocked.groupBy("blk").agg(F.sum("n").alias("total"))
    before = totals.select("blk", (F.sum("total").over(Window.orderBy("blk")) - F.col("total")).alias("before"))
    end = F.sum("n").over(Window.partitionBy("blk").orderBy("row_id")) + F.col("before")
    return blocked.join(before, "blk").select("row_id", (end - F.col("n")).cast("long").alias("begin"), end.cast("long").alias("end"))


def pointers(matrix: DataFrame, rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """CSR pointers (row_id, begin, end) of every row of ``rows`` (idx)."""
    counts = rows.select(F.col("idx").alias("row_id")).join(matrix.groupBy("row_id").agg(F.count("*").alias("n")), "row_id", "left")
    return prefix(counts, block)


def csr_rows(matrix: DataFrame) -> DataFrame:
    """Matrix rows in segments: row_id, segment and entries sorted by column.

    The segments of a row are in column order.  Entries are dealt by ranges of row
    and column, so a row of any length is cut over tasks, and a segment is at
    most ``SEGMENT`` entries long.
    """
    kind = {f.name: f.dataType.simpleString() for f in matrix.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = b.column(0).to_numpy(zero_copy_only=False)
            change = np.ones(len(rows), bool)
            change[1:] = rows[1:] != rows[:-1]
            change[::SEGMENT] = True
            starts = np.flatnonzero(change)
            entries = pa.StructArray.from_arrays([b.column(1), b.column(2)], names=["col_id", "value"])
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(rows)], pa.int32()), entries)
            yield pa.record_batch([b.column(0).take(pa.array(starts)), pa.array(segment + np.arange(len(starts)), pa.int64()), lists], names=["row_id", "segment", "entries"])
            segment += len(starts)

    entries = matrix.select("row_id", "col_id", "value").repartitionByRange("row_id", "col_id", "value").sortWithinPartitions("row_id", "col_id", "value")
    return entries.mapInArrow(run, f"row_id {kind['row_id']}, segment long, entries array<struct<col_id:{kind['col_id']},value:{kind['value']}>>")


def with_positions(entries: DataFrame, group: list[str], block: Column, order: list[str], name: str) -> DataFrame:
    """``entries`` with their 0-based place ``name`` in the order (block, order) of their group.

    Places are counted inside blocks and over block totals, so no task holds a whole group.
    """
    blocked = entries.withColumn("_blk", block)
    totals = blocked.groupBy(*group, "_blk").agg(F.count("*").alias("_n"))
    before = totals.select(*group, "_blk", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_blk")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_blk").orderBy(*order)) - 1
    placed = blocked.withColumn("_inside", inside).join(before, [*group, "_blk"])
    return placed.select(*entries.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))
