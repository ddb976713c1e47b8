"""A matrix row with a large part of all entries is cut over arrays and tasks."""

import numpy as np
from pyspark.sql import functions as F

from sparsewell.operators import algebra, layout
from sparsewell.sources import files

LONG = 150_000


def hot(spark):
    """Row 3 has an entry in every column, every other row up to 9 one."""
    first = spark.range(LONG).select(F.lit(3).cast("long").alias("row_id"), F.col("id").alias("col_id"), (1.0 / (F.col("id") % 97 + 1)).alias("value"))
    rest = spark.range(10).where("id <> 3").select(F.col("id").alias("row_id"), (F.col("id") * 7).alias("col_id"), (F.col("id") + 0.5).alias("value"))
    return first.unionAll(rest)


def test_segments_are_bounded_and_ordered(spark):
    segments = algebra.csr_rows(hot(spark)).where("row_id = 3").orderBy("segment").collect()
    assert max(len(s.entries) for s in segments) <= algebra.SEGMENT
    assert [e.col_id for s in segments for e in s.entries] == list(range(LONG))


def test_single_precision_sum_in_column_order(spark):
    x = spark.range(LONG).select(F.col("id").alias("idx"), (F.col("id") % 13 + 0.1).alias("value"))
    products = algebra.touched_rows(hot(spark), x, algebra.FP32)
    assert "collect_list" not in products._jdf.queryExecution().toString()
    got = {r.idx: r.value for r in products.collect()}
    cols = np.arange(LONG)
    p = (1.0 / (cols % 97 + 1)).astype(np.float32) * (cols % 13 + 0.1).astype(np.float32)
    assert len(got) == 10 and got[3] == float(np.add.accumulate(p, dtype=np.float32)[-1])


def test_null_terms(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 2.0), (1, 0, 3.0)], "row_id long, col_id long, value double")
    x = spark.createDataFrame([(i, 2.0) for i in range(3)], "idx long, value double")
    assert {r.idx: r.value for r in algebra.touched_rows(a, x, algebra.FP32).collect()} == {0: None, 1: 6.0}


def test_positions_of_long_rows(spark, tmp_path):
    a = hot(spark)
    slots = layout.lane_slots(a)
    assert slots.groupBy("batch", "channel", "lane").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).where("n <> m + 1 or n <> d").count() == 0
    files.write_csr_folder(a, spark.range(LONG).withColumnRenamed("id", "idx"), f"{tmp_path}/csr")
    assert files.read_csr_folder(spark, f"{tmp_path}/csr").exceptAll(a).count() == 0 and a.exceptAll(files.read_csr_folder(spark, f"{tmp_path}/csr")).count() == 0
