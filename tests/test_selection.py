"""Selection of data sets, and matrices known by what their folder holds."""

import pytest

from sparsewell.sources import files

KNOWN = {"one": 10, "two_n4": 4, "three": 30}


@pytest.mark.parametrize(
    "asked, want",
    [([], [("one", 10)]), (["all"], list(KNOWN.items())), (["three, one", "two_n4"], [("three", 30), ("one", 10), ("two_n4", 4)]), (["three_n7"], [("three_n7", 7)]), (["one_n10,one"], [("one_n10", 10), ("one", 10)])],
)
def test_selection(asked, want):
    assert files.select_datasets(asked, KNOWN, "one") == want


@pytest.mark.parametrize("asked", [["none"], ["one", "all"], ["one_n0"], ["one_n11"], ["one_nx"], ["four_n2"]])
def test_bad_selection(asked):
    with pytest.raises(ValueError):
        files.select_datasets(asked, KNOWN, "one")


def test_folders_and_fallbacks(spark, tmp_path):
    for name, text in {"row_ptr": "0\n1\n2", "col_idx": "0\n3", "values": "0.1\n2"}.items():
        (tmp_path / f"{name}.txt").write_text(text + "\n")
    path = f"file://{tmp_path}"
    assert files.is_csr_folder(spark, path) and not files.is_csr_folder(spark, f"{path}/none")
    with pytest.raises(ValueError):
        files.load_matrix(spark, path)  # square unless the metadata say otherwise
    (tmp_path / "meta.txt").write_text("# c\nm=2\nn=5\n")
    a = files.load_matrix(spark, path)
    assert sorted(map(tuple, a.collect())) == [(0, 0, 0.1), (1, 3, 2.0)]
    assert files.read_csr_dataset(spark, path, narrow=True).orderBy("row_id").first().value == 0.10000000149011612
    assert sorted(map(tuple, files.read_rhs(spark, path, a).collect())) == [(0, 0.1), (1, 2.0)]
    (tmp_path / "b.txt").write_text("7\n8\n")
    assert sorted(map(tuple, files.read_rhs(spark, path, a).collect())) == [(0, 7.0), (1, 8.0)]
    with pytest.raises(ValueError):
        files.load_matrix(spark, f"{path}/other.dat")
