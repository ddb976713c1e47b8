"""Tiles: bounded records however the entries lie, products where the tiles lie, and the same sums as entry by entry."""

import math
import random
import re

import pytest

from sparsewell.operators import algebra, layout, tiles
from sparsewell.plans import solvers
from sparsewell.storage import discard_all

GRID = tiles.Grid(16, 8, 10)


def matrix(spark, entries):
    return spark.createDataFrame(entries, "row_id long, col_id long, value double").repartition(3)


def vector(spark, values):
    return spark.createDataFrame(values, "idx long, value double")


def product(entries, x):
    known, out = dict(x), {}
    for r, c, v in entries:
        if v is not None and known.get(c) is not None:
            out[r] = out.get(r, 0.0) + v * known[c]
    return out


@pytest.mark.parametrize("grid", [GRID, tiles.Grid(1, 1, 1), tiles.Grid(1 << 32), None])
def test_product_with_a_hot_column(spark, grid):
    rnd = random.Random(2)
    entries = [(rnd.randrange(200), 5 if k % 3 == 0 else rnd.randrange(60), float(rnd.randrange(1, 9))) for k in range(900)]
    entries += [(7, 7, None), (7, 59, 2.0), (7, 59, 2.0), (10_000_000_000, 0, 1.0)]
    x = [(i, None if i == 11 else float(i % 7)) for i in range(58)] + [(10_000, 1.0)]
    stored = tiles.TiledMatrix(matrix(spark, entries), grid)
    assert {(r.idx, r.value) for r in stored.touched_rows(vector(spark, x)).collect()} == set(product(entries, x).items())
    assert sorted(tuple(r) for r in stored.entries().collect()) == sorted(e for e in entries if e[2] is not None)
    rows = vector(spark, [(0, 0.0), (7, 0.0), (999, 0.0)])
    got = {r.idx: r.value for r in stored.multiply(vector(spark, x), rows).collect()}
    assert got == {i: product(entries, x).get(i, 0.0) for i in (0, 7, 999)}
    stored.close()


def test_records_are_bounded(spark):
    entries = [(r, 0, 1.0) for r in range(500)] + [(0, c, 1.0) for c in range(1, 100)] + [(3, 3, 1.0)] * 75
    stored = tiles.TiledMatrix(matrix(spark, entries), GRID)
    records = stored.tiles.collect()
    assert sum(r.n for r in records) == len(entries) and max(r.n for r in records) <= GRID.entries
    assert all(len(r.at_rows) == 4 * r.n == len(r.at_cols) and len(r.vals) == 8 * r.n for r in records)
    assert len({r.slot for r in records}) == len(records)
    loads = {(r.tile_row, r.tile_col): (r.nnz, r.n_records) for r in tiles.tile_loads(stored.tiles).collect()}
    assert loads[0, 0][0] == 16 + 7 + 75 and loads[0, 0][1] >= 10


def test_special_values_and_empty_matrices(spark):
    stored = tiles.TiledMatrix(matrix(spark, [(0, 0, math.inf), (1, 0, math.nan), (2, 1, 0.0)]), GRID)
    got = {r.idx: r.value for r in stored.touched_rows(vector(spark, [(0, 1.0), (1, math.inf)])).collect()}
    assert got[0] == math.inf and math.isnan(got[1]) and math.isnan(got[2])
    assert tiles.TiledMatrix(matrix(spark, [])).touched_rows(vector(spark, [(0, 1.0)])).collect() == []
    assert stored.touched_rows(vector(spark, [])).collect() == []


def test_grid_follows_density():
    assert tiles.choose_grid(1 << 20, 1 << 20, 1 << 24).rows == 1 << 17
    assert tiles.choose_grid(1 << 20, 1 << 20, 0).rows == 1 << 32
    assert tiles.choose_grid(100, 10, 10**9).rows == 1


def test_tiles_stay_where_they_lie(spark):
    stored = tiles.TiledMatrix(matrix(spark, [(r, c, 1.0) for r in range(40) for c in range(40)]), GRID)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stored.touched_rows(vector(spark, [(i, 1.0) for i in range(40)]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    moved = re.findall(r"Exchange [^\n]*", plan)
    join = plan[plan.index("SortMergeJoin [slot") :]
    ours = join[: join.index("Exchange")]
    assert "at_rows" in ours and "Bucketed: true" in ours  # the side of the tiles has no exchange
    assert not any("vals" in m for m in moved)


def test_solver_on_tiles(spark):
    n = 60
    entries = [(i, j, 4.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n] + [(0, j, -0.01) for j in range(2, n)] + [(j, 0, -0.01) for j in range(2, n)]
    a, b = matrix(spark, entries), vector(spark, [(i, float(i % 5)) for i in range(n)])
    plain = solvers.pcg(a, b, tau=1e-18)
    tiled = solvers.pcg(a, b, tau=1e-18, multiply=tiles.product_of(a, GRID))
    blocks = layout.StoredBlocks(a)
    blocked = solvers.pcg(a, b, tau=1e-18, multiply=blocks.multiply)
    want = {r.idx: r.value for r in plain.solution.collect()}
    for other in (tiled, blocked):
        assert other.status == plain.status == "converged" and abs(other.iterations - plain.iterations) <= 1
        assert all(abs(r.value - want[r.idx]) < 1e-8 for r in other.solution.collect())
    discard_all(spark)


def test_blocks_stay_where_they_lie(spark):
    rnd = random.Random(4)
    places = {(rnd.randrange(90), rnd.randrange(90)) for _ in range(700)}
    entries = [(r, c, float(rnd.randrange(1, 9))) for r, c in places]
    a, x = matrix(spark, entries), [(i, float(i % 11)) for i in range(0, 90, 2)]
    rows = vector(spark, [(i, 0.0) for i in range(95)])
    for windowed in (False, True):
        blocks = layout.StoredBlocks(a, windowed)
        got = {r.idx: r.value for r in blocks.multiply(vector(spark, x), rows).collect()}
        assert got == {i: product(entries, x).get(i, 0.0) for i in range(95)}
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = blocks.multiply(vector(spark, x), rows)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        join = plan[plan.index("SortMergeJoin [block_col") :]
        assert "Bucketed: true" in join[: join.index("Exchange")]
        assert not any("places" in m for m in re.findall(r"Exchange [^\n]*", plan))
    assert algebra.spmv(a, vector(spark, x), rows).count() == 95


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_filled_windows_expand_to_the_dense_grid(spark, monkeypatch, block):
    monkeypatch.setattr(layout, "COLUMN_BLOCK", block)
    rnd = random.Random(6)
    a = matrix(spark, [(rnd.randrange(50), rnd.choice([rnd.randrange(600), rnd.randrange(5000)]), 1.0) for _ in range(120)])
    blocks = layout.bitmap_blocks(a)
    filled = sorted(tuple(r) for r in layout.filled_windows(blocks, 50, 5000).collect())
    dense = sorted(tuple(r) for r in layout.window_pointers(blocks, 50, 5000).collect())
    expanded, end = [], 0
    for window, row, begin, stop, empty in filled:
        expanded += [(end, end)] * empty + [(begin, stop)]
        assert begin == end
        end = stop
    expanded += [(end, end)] * (len(dense) - len(expanded))
    assert expanded == [d[2:] for d in dense] and len(filled) < len(dense)
