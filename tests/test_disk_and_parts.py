"""Blocks are dealt once, shuffle files go with what was written, matrix files are short, and tasks do not look for parts."""

import glob
import math
import re

from sparsewell.operators import layout
from sparsewell.sources import files, ranges
from sparsewell.storage import discard, materialize


def test_blocks_are_dealt_once(spark):
    entries = [(0, 0, 1.0), (0, 0, 2.0), (1, 3, 5.0), (1, 3, -5.0), (9, 4, 0.0), (6, 5, math.inf), (3, 2, None)]
    blocks = layout.placed_blocks(spark.createDataFrame(entries, "row_id long, col_id long, value double"))
    found = {(b.block_row, b.block_col): {k: b[f"v{k}"] for k in range(16) if b[f"v{k}"] is not None} for b in blocks.collect()}
    assert found == {(0, 0): {0: 3.0}, (1, 1): {9: math.inf}}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = blocks.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_shuffle_files_go_with_what_was_written(spark):
    at = spark.sparkContext.getConf().get("spark.local.dir") + "/blockmgr*/*/shuffle_*.data"
    before = set(glob.glob(at))
    written = materialize(spark.range(10_000).repartition(8, "id"), "test")
    assert not set(glob.glob(at)) - before
    assert written.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    discard(written)


def test_numbers_are_short_and_exact(spark, tmp_path):
    values = [0.1, 3.0, -1e-300, 1.7976931348623157e308, 1 / 3]
    a = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "row_id long, col_id long, value double").coalesce(1)
    files.write_matrix_market(a, f"file://{tmp_path}/m", 1, 5)
    lines = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/m/part-*"))).splitlines()
    assert "1 1 0.1" in lines and "1 2 3.0" in lines
    for back in (files.load_matrix(spark, f"file://{tmp_path}/m"), ranges.matrix_entries(spark, f"file://{tmp_path}/m")):
        assert {r.col_id: r.value for r in back.collect()} == dict(enumerate(values))


def test_tasks_do_not_look_for_parts(spark, tmp_path, monkeypatch):
    a = spark.range(300).selectExpr("id % 20 AS row_id", "id AS col_id", "id / 2 AS value").repartition(3)
    files.write_matrix_market(a, f"file://{tmp_path}/m", 20, 300)
    reader = ranges.MarketReader(f"file://{tmp_path}/m", 500)
    parts = reader.partitions()
    monkeypatch.setattr(ranges.Joined, "_begins", lambda *_: 1 / 0)
    monkeypatch.setattr(ranges.pafs, "FileSelector", lambda *_: 1 / 0)
    assert len(parts) > 3 and sorted(c for p in parts for b in reader.read(p) for c in b.column("col_id").to_pylist()) == list(range(300))
