"""Matrix files by byte ranges: every split gives the same entries, bounds are applied in the reader, formats are told by content."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from sparsewell.operators import algebra
from sparsewell.sources import files, ranges

MARKET = """%%MatrixMarket matrix coordinate real general
% made for tests
%
 5 6 8

1 1 2.5
1   1 -2.5
% between
5 6 1e-3
2 3 0

3\t3 7
3 3 8
4 1 -1.25e2
1 6 4"""
ENTRIES = [(0, 0, 2.5), (0, 0, -2.5), (4, 5, 1e-3), (1, 2, 0.0), (2, 2, 7.0), (2, 2, 8.0), (3, 0, -125.0), (0, 5, 4.0)]


def rows(df):
    return [tuple(r) for r in df.orderBy("place").select("row_id", "col_id", "value").collect()]


@pytest.mark.parametrize("split", [1, 7, 40, 1 << 20])
@pytest.mark.parametrize("held", [3, 1 << 20])
def test_market_reader_splits(tmp_path, monkeypatch, split, held):
    monkeypatch.setattr(ranges, "HELD_BYTES", held)
    (tmp_path / "a.mtx").write_text(MARKET)
    reader = ranges.MarketReader(str(tmp_path / "a.mtx"), split)
    found = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [f[:3] for f in found] == ENTRIES
    assert all(MARKET[f[3] :].split()[:2] == [str(f[0] + 1), str(f[1] + 1)] for f in found)
    assert len(reader.partitions()) > 1 or split > 100


def test_market_forms(spark, tmp_path):
    for name, head, body, want in (
        ("sym", "real symmetric", "2 1 3\n2 2 4\n", [(1, 0, 3.0), (0, 1, 3.0), (1, 1, 4.0)]),
        ("pat", "pattern general", "2 1\n", [(1, 0, 1.0)]),
        ("com", "complex hermitian", "2 1 3 9\n", [(1, 0, 3.0), (0, 1, 3.0)]),
        ("int", "integer general", "", []),
    ):
        (tmp_path / name).write_text(f"%%MatrixMarket matrix coordinate {head}\n2 2 {body.count(chr(10))}\n{body}")
        got = ranges.matrix_entries(spark, f"{tmp_path}/{name}", split=4)
        assert sorted(rows(got)) == sorted(want)
        assert sorted(rows(got.where("row_id = 1"))) == sorted(w for w in want if w[0] == 1)
    for text in ("%%MatrixMarket matrix array real general\n2 2\n1\n", "%%MatrixMarket matrix coordinate real general\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1\n"):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(Exception, match="banner|size line|too few"):
            ranges.matrix_entries(spark, f"{tmp_path}/bad").collect()


def test_folder_of_parts_is_one_file(spark, tmp_path):
    rnd = random.Random(1)
    entries = [(rnd.randrange(50), rnd.randrange(50), float(i)) for i in range(500)]
    df = spark.createDataFrame(entries, "row_id long, col_id long, value double").orderBy("value")
    files.write_matrix_market(df, f"{tmp_path}/m", 50, 50)
    got = ranges.matrix_entries(spark, f"{tmp_path}/m", split=100)
    assert rows(got) == entries and got.rdd.getNumPartitions() > 20
    first = {}
    for r, c, v in entries:
        if r == c:
            first.setdefault(r, v)
    assert {r.idx: r.value for r in algebra.first_diagonal(got).collect()} == first


def csr(entries, m, n):
    entries = sorted(entries)
    row = np.array([e[0] for e in entries], np.int64)
    return files.encode_binary_csr(np.searchsorted(row, np.arange(m + 1)), np.array([e[1] for e in entries]), np.array([e[2] for e in entries], float), n), entries


def some(seed, m=300, n=40, k=800):
    rnd = random.Random(seed)
    return [(rnd.choice([7, 7, 250, rnd.randrange(m)]), rnd.randrange(n), float(rnd.randrange(1, 9))) for _ in range(k)]


@pytest.mark.parametrize("split", [12, 100, 1000, 1 << 20])
@pytest.mark.parametrize("held", [36, 500, 1 << 20])
def test_binary_reader_splits(tmp_path, monkeypatch, split, held):
    monkeypatch.setattr(ranges, "HELD_BYTES", held)
    data, entries = csr(some(3), 300, 40)
    (tmp_path / "a").write_bytes(data)
    for low, high in ((0, 300), (7, 8), (8, 250), (251, 999), (5, 5), (-4, 3)):
        reader = ranges.BinaryReader(str(tmp_path / "a"), split)
        left = list(reader.pushFilters([GreaterThanOrEqual(("row_id",), low), LessThan(("row_id",), high), IsNotNull(("col_id",)), EqualTo(("value",), 1.0), In(("row_id",), (1, 2))]))
        assert len(left) == 2
        parts = reader.partitions()
        found = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [f[:3] for f in found] == [e for e in entries if low <= e[0] < high]
        # only entries of these rows are read
        assert sum(p.end - p.start for p in parts) == len(found)


@pytest.mark.parametrize("numbers", [1 << 20, 64])
def test_writer_gives_the_bytes_of_one_file(spark, tmp_path, monkeypatch, numbers):
    monkeypatch.setattr(files, "PART_NUMBERS", numbers)
    data, entries = csr(some(4), 300, 40)
    df = spark.createDataFrame(entries, "row_id long, col_id long, value double").repartition(5)
    files.write_binary_csr(df, 300, 40, f"file://{tmp_path}/m")
    parts = sorted(os.listdir(tmp_path / "m"))
    assert b"".join((tmp_path / "m" / p).read_bytes() for p in parts) == data
    assert len(parts) > 20 or numbers > 64
    got = ranges.matrix_entries(spark, f"{tmp_path}/m", split=240)
    assert rows(got) == entries
    some_rows = got.where("row_id >= 20 and row_id <= 200 and col_id < 9 and value > 2")
    assert rows(some_rows) == [e for e in entries if 20 <= e[0] <= 200 and e[1] < 9 and e[2] > 2]
    plan = some_rows._jdf.queryExecution().executedPlan().toString()
    left = re.findall(r"Filter \(?[^\n]*", plan)
    assert all("row_id" not in f and "col_id" not in f for f in left), left


def test_writer_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id long, col_id long, value double")
    files.write_binary_csr(empty, 3, 2, f"file://{tmp_path}/e")
    assert ranges.matrix_entries(spark, f"{tmp_path}/e").collect() == [] and ranges.sniff(f"{tmp_path}/e") == ranges.BINARY
    for bad in ((3, 0), (0, 2), (-1, 0)):
        with pytest.raises(ValueError, match="outside"):
            files.write_binary_csr(spark.createDataFrame([(*bad, 1.0)], "row_id long, col_id long, value double"), 3, 2, f"file://{tmp_path}/x")


def test_formats_by_content(spark, tmp_path):
    data, entries = csr(some(5, k=50), 300, 40)
    (tmp_path / "matrix.mtx").write_bytes(data)
    (tmp_path / "matrix.cbd").write_text(MARKET)
    spark.createDataFrame(entries, "row_id long, col_id long, value double").write.parquet(f"{tmp_path}/matrix.txt")
    assert sorted(map(tuple, files.load_matrix(spark, f"{tmp_path}/matrix.mtx").collect())) == entries
    assert sorted(map(tuple, files.load_matrix(spark, f"{tmp_path}/matrix.cbd").collect())) == sorted(map(tuple, files.read_matrix_market(spark, f"{tmp_path}/matrix.cbd").collect()))
    assert sorted(map(tuple, files.load_matrix(spark, f"{tmp_path}/matrix.txt").collect())) == entries
    for name, content in (("short", b"abc"), ("cut.cbd", data[:-1]), ("words.mtx", b"%%Matrix no"), ("empty.cbd", b"")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ValueError, match="no matrix"):
            files.load_matrix(spark, f"{tmp_path}/{name}")
    with pytest.raises(ValueError, match="no matrix"):
        files.load_matrix(spark, f"{tmp_path}/missing.cbd")


def test_broken_pointers_raise(tmp_path):
    data = bytearray(csr([(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0)], 3, 3)[0])
    data[16 + 8 : 16 + 16] = (9).to_bytes(8, "little")
    (tmp_path / "a").write_bytes(data)
    reader = ranges.BinaryReader(str(tmp_path / "a"), 1 << 20)
    with pytest.raises(ValueError, match="pointers decrease"):
        [list(reader.read(p)) for p in reader.partitions()]
