"""Solver steps read stored tables where they lie, check their input and leave nothing behind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sparse import DENSE, matrix, values, vector

from sparsewell.operators import algebra, layout
from sparsewell.plans import solvers
from sparsewell.storage import discard, discard_all, materialize_by, run_folder


def test_a_step_moves_only_sums(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = materialize_by(matrix(spark, DENSE), "col_id", "m", 4)
        state = materialize_by(vector(spark, [1, 2, 3]).withColumn("p", F.lit(2.0)), "idx", "s", 4)
        ap = algebra.spmv(a, state.select("idx", F.col("p").alias("value")), state.select("idx")).withColumnRenamed("value", "ap")
        plan = state.join(ap, "idx").repartition(4, "idx")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(row_id" in plan and "partial_sum" in plan
    discard(a)
    discard(state)


def left_over(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in fs.listStatus(folder)} if fs.exists(folder) else set()


def test_nothing_is_left_but_the_solution(spark):
    a, b = matrix(spark, DENSE), vector(spark, [1, 2, 3])
    before, tables = left_over(spark), len(spark.catalog.listTables())
    out = solvers.pcg(a, b)
    assert len(left_over(spark) - before) == 1 and len(spark.catalog.listTables()) == tables + 1
    assert np.allclose(values(out.solution), np.linalg.solve(DENSE, [1, 2, 3]))
    after = left_over(spark)
    with pytest.raises(ArithmeticError):
        solvers.pcg(matrix(spark, [[1.0, 1.0], [1.0, 1.0]]), vector(spark, [1, -1]), max_iters=3, policy=solvers.GOLDEN)
    with pytest.raises(ValueError):
        solvers.jacobi(matrix(spark, [[0.0, 1.0], [1.0, 2.0]]), vector(spark, [1, 1]), 2)
    assert left_over(spark) == after
    discard_all(spark)
    assert not left_over(spark) and not [t for t in spark.catalog.listTables() if t.name.startswith("sparsewell_tmp_")]


def test_input_is_checked(spark):
    b = vector(spark, [1, 2, 3])
    wide = np.eye(3, 4) * 2
    wide[0, 3] = 1.0
    for solve in (lambda m: solvers.pcg(m, b), lambda m: solvers.jacobi(m, b, 1)):
        with pytest.raises(ValueError, match="square"):
            solve(matrix(spark, wide))
    small = matrix(spark, np.diag([2.0, 1e-31, 4.0]))
    with pytest.raises(ValueError, match="diagonal"):
        solvers.pcg(small, b)
    assert solvers.pcg(small, vector(spark, [2.0, 1e-31, 4.0]), policy=solvers.GOLDEN).status == solvers.CONVERGED
    for steps, rhs in ((-1, b), (1, b.limit(0))):
        with pytest.raises(ValueError):
            solvers.jacobi(matrix(spark, DENSE), rhs, steps)


def test_quotients_and_history(spark):
    assert math.isnan(solvers._ratio(0.0, 0.0)) and solvers._ratio(1.0, 0.0) == math.inf and solvers._ratio(-1.0, 0.0) == -math.inf and solvers._ratio(1.0, -0.0) == -math.inf
    out = solvers.pcg(matrix(spark, DENSE), vector(spark, [1, 2, 3]), tau=1e-12)
    rows = [tuple(r) for r in out.history_table().orderBy("iteration").collect()]
    assert rows[0] == (0, 14.0) and len(rows) == out.iterations + 1 and rows[-1][1] == out.rr <= 1e-12


def test_diagonal_is_dropped_and_empty_channels_count(spark):
    full = layout.pack_summary(matrix(spark, DENSE)).first()
    rest = layout.pack_summary(matrix(spark, DENSE), drop_diagonal=True).first()
    assert (full.real_nnz, rest.real_nnz) == (5, 2) and full.channel_real_min == full.pe_real_min == 0
    assert layout.pack_summary(matrix(spark, DENSE).limit(0)).first().real_nnz == 0
