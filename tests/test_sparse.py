"""Sparse operators and solvers against NumPy."""

import numpy as np
import pytest

from sparsewell.operators import algebra, layout, validate
from sparsewell.plans import solvers
from sparsewell.sources import files, generator

DENSE = np.array([[4.0, 1.0, 0.0], [1.0, 3.0, 0.0], [0.0, 0.0, 2.0]])


def matrix(spark, dense):
    rows = [(i, j, float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "row_id long, col_id long, value double")


def vector(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, value double")


def values(df):
    return np.array([r.value for r in df.orderBy("idx").collect()])


@pytest.mark.parametrize("mode", [algebra.FP64, algebra.MIXED, algebra.FP32])
def test_spmv_fills_empty_rows(spark, mode):
    a = np.array([[1.0, 2.0], [0.0, 0.0], [0.0, 3.0]])
    out = algebra.spmv(matrix(spark, a), vector(spark, [5, 7]), vector(spark, [0, 0, 0]), mode)
    assert np.allclose(values(out), a @ [5, 7])


def test_diagonal_violations_raise(spark):
    a = matrix(spark, [[0.0, 1.0], [1.0, 2.0]])
    with pytest.raises(ValueError):
        validate.require_clean(validate.diagonal_violations(a, vector(spark, [0, 0])))


@pytest.mark.parametrize("policy", [solvers.GOLDEN, solvers.HOST, solvers.KERNEL])
def test_pcg_converges_on_squared_norm(spark, policy):
    limit = 50
    out = solvers.pcg(matrix(spark, DENSE), vector(spark, [1, 2, 3]), tau=1e-12, max_iters=limit, policy=policy)
    assert out.status == solvers.CONVERGED and out.rr <= 1e-12 and out.iterations <= 4
    assert np.allclose(values(out.solution), np.linalg.solve(DENSE, [1, 2, 3]), atol=1e-6)


def test_diagonal_matrix_takes_one_iteration(spark):
    out = solvers.pcg(matrix(spark, np.diag([2.0, 4.0])), vector(spark, [2, 4]), max_iters=5)
    assert out.iterations == 1 and out.status == solvers.CONVERGED


def test_pcg_breakdown(spark):
    a = matrix(spark, [[1.0, 2.0], [2.0, 1.0]])
    b = vector(spark, [1.0, -1.0])
    bad = matrix(spark, [[1.0, 1.0], [1.0, 1.0]])
    assert solvers.pcg(bad, b, max_iters=3).status == solvers.BREAKDOWN
    with pytest.raises(ArithmeticError):
        solvers.pcg(bad, b, max_iters=3, policy=solvers.GOLDEN)
    with pytest.raises(ValueError):
        solvers.pcg(a, b, tau=0)


def test_policies_of_bad_starts(spark):
    a, b = matrix(spark, DENSE), vector(spark, [1, 2, 3])
    nan = vector(spark, [float("nan"), 2, 3])
    assert solvers.pcg(a, nan, max_iters=3, policy=solvers.KERNEL).status == solvers.BREAKDOWN
    for policy in (solvers.KERNEL, solvers.GRAPH, solvers.SPLIT):
        assert solvers.pcg(a, b, tau=-1.0, policy=policy).status == solvers.BREAKDOWN
    out = solvers.pcg(a, b, tau=1e-12, multiply=lambda x, rows: algebra.spmv(layout.unblock(layout.bitmap_blocks(a)), x, rows), stored=True)
    assert out.status == solvers.CONVERGED and solvers.true_residual(a, out.solution, b).first().norm < 1e-5


def test_matrix_vectors(spark, tmp_path):
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n4 2 4\n2 1 5\n2 1 6.5\n4 1 1\n3 2 9\n")
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix array real general\n% c\n3 2\n1\n2 3\n4\n5\n6\n")
    assert values(files.read_matrix_market_vector(spark, f"{tmp_path}/c.mtx")).tolist() == [0, 6.5, 0, 1]
    assert values(files.read_matrix_market_vector(spark, f"{tmp_path}/a.mtx")).tolist() == [1, 2, 3]


def test_jacobi_uses_whole_old_vector(spark):
    x = np.zeros(3)
    for _ in range(3):
        x = ([1, 2, 3] - (DENSE - np.diag(np.diag(DENSE))) @ x) / np.diag(DENSE)
    out, change = solvers.jacobi(matrix(spark, DENSE), vector(spark, [1, 2, 3]), 3)
    assert np.allclose(values(out), x) and change >= 0


def test_files_round_trip(spark, tmp_path):
    a = matrix(spark, DENSE)
    want = sorted(map(tuple, a.collect()))
    files.write_matrix_market(a, f"{tmp_path}/a.mtx", 3, 3)
    assert sorted(map(tuple, files.load_matrix(spark, f"{tmp_path}/a.mtx").collect())) == want
    files.write_csr_folder(a, vector(spark, [0, 0, 0]), f"{tmp_path}/csr")
    assert sorted(map(tuple, files.load_matrix(spark, f"{tmp_path}/csr").collect())) == want
    data = files.encode_binary_csr(np.array([0, 2, 4, 5]), np.array([0, 1, 0, 1, 2]), np.array([4.0, 1, 1, 3, 2]), 3)
    (tmp_path / "a.cbd").write_bytes(data)
    assert sorted(map(tuple, files.load_matrix(spark, f"{tmp_path}/a.cbd").collect())) == want


def test_symmetric_pattern_file(spark, tmp_path):
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n2 2 2\n1 1\n2 1\n")
    assert sorted(map(tuple, files.read_matrix_market(spark, f"{tmp_path}/p.mtx").collect())) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]


def test_grid_is_symmetric_positive_definite(spark):
    d = np.zeros((60, 60))
    for r in generator.grid_matrix(spark, 60).collect():
        d[r.row_id, r.col_id] = r.value
    assert np.allclose(d, d.T) and np.linalg.eigvalsh(d).min() > 0


def test_blocks_keep_entries(spark):
    a = matrix(spark, np.arange(36.0).reshape(6, 6))
    assert sorted(map(tuple, layout.unblock(layout.bitmap_blocks(a)).collect())) == sorted(map(tuple, a.collect()))
