"""CSR folders whose files do not agree are refused; b and x0 are read and checked."""

import pytest

from sparsewell.sources import files

GOOD = {"row_ptr": "0 2 4 5", "col_idx": "0 1 0 1 2", "values": "4 1 1 3 2", "b": "1 2 3", "x0": "0 0 0.5"}


def folder(path, **other):
    for name, text in (GOOD | other).items():
        if text is not None:
            (path / f"{name}.txt").write_text(text.replace(" ", "\n") + "\n")
    return str(path)


@pytest.mark.parametrize("name, text", [("values", "4 1 1 3"), ("values", "4 1 1 3 2 9"), ("col_idx", "0 1 0 1"), ("row_ptr", "0 2 4 4"), ("row_ptr", "0 2 4 6"), ("row_ptr", "1 2 4 5"), ("row_ptr", "0 4 2 5"), ("row_ptr", "0"), ("col_idx", "0 1 0 1 3"), ("col_idx", "0 1 0 1 -1"), ("b", "1 2"), ("x0", "0 0 0 0")])
def test_broken_folder_raises(spark, tmp_path, name, text):
    with pytest.raises(ValueError):
        files.read_csr_system(spark, folder(tmp_path, **{name: text}))


def test_system(spark, tmp_path):
    a, b, x0 = files.read_csr_system(spark, folder(tmp_path))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0), (2, 2, 2.0)]
    assert sorted(map(tuple, b.collect())) == [(0, 1.0), (1, 2.0), (2, 3.0)] and sorted(map(tuple, x0.collect()))[2] == (2, 0.5)


def test_vectors_are_optional_and_wide_matrices_possible(spark, tmp_path):
    path = folder(tmp_path, b=None, x0=None, col_idx="0 1 0 1 8")
    assert files.read_csr_vector(spark, path, "b") is None
    assert files.read_csr_folder(spark, path, n_cols=9).count() == 5
