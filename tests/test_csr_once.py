"""CSR folders at size: the matrix is computed once, words are numbered where they are read, joins of entries are never broadcast."""

import re

import pytest

from sparsewell.sources import discovery, files


@pytest.fixture()
def folder(spark, tmp_path):
    a = spark.createDataFrame([(i, (i * 7 + k) % 50, float(k + 1)) for i in range(50) for k in range(3)], "row_id long, col_id long, value double")
    files.write_csr_folder(a, spark.range(50).withColumnRenamed("id", "idx"), f"file://{tmp_path}/csr")
    return a, f"file://{tmp_path}/csr"


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrix_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    a = spark.range(100).selectExpr("id % 10 AS row_id", "id AS col_id", "id / 2 AS value").mapInArrow(count, "row_id long, col_id long, value double")
    files.write_csr_folder(a, spark.range(10).withColumnRenamed("id", "idx"), f"file://{tmp_path}/csr")
    assert seen.value == 100
    assert files.read_csr_folder(spark, f"file://{tmp_path}/csr", 100).count() == 100


def test_entries_of_other_rows_are_left_out(spark, tmp_path):
    a = spark.createDataFrame([(0, 0, 0.1), (1, 1, 1e-300), (2, 0, 5.0)], "row_id long, col_id long, value double")
    files.write_csr_folder(a, spark.range(2).withColumnRenamed("id", "idx"), f"file://{tmp_path}/csr")
    assert sorted(map(tuple, files.read_csr_folder(spark, f"file://{tmp_path}/csr").collect())) == [(0, 0, 0.1), (1, 1, 1e-300)]


def test_places_of_files_are_told_once_a_file(spark, folder, plain):
    words = discovery._words(spark, [f"{folder[1]}/row_ptr.txt", f"{folder[1]}/col_idx.txt"])
    assert [tuple(r)[1:] for r in words.collect()] == [(51, 150)]
    below = plan(words).split("HashAggregate")[-1]
    assert "Scan text" in below and "regexp_extract" not in below


def test_entries_are_not_broadcast(spark, folder, plain):
    joins = re.findall(r"(\w+Join)[^\n]*\[pos#", plan(files.read_csr_folder(spark, folder[1])))
    assert joins and set(joins) == {"SortMergeJoin"}
    assert files.read_csr_folder(spark, folder[1]).exceptAll(folder[0]).count() == 0


def test_words_are_numbered_where_they_are_read(spark, tmp_path, plain):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.txt").write_text("% c\n0 1\n\n 2\t3 \n4\n")
    (tmp_path / "n" / "b.txt").write_text("5\n6 7")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4")
    try:
        numbers = files.read_numbers(spark, f"file://{tmp_path}/n", "long", comment="%")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, numbers.collect())) == [(i, i) for i in range(8)]
    assert len(re.findall(r"\) Window|- Window|Window \[", plan(numbers))) <= 1
