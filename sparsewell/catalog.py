"""Driver queries of the sparse operators, each with equal DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import measures, packing
from .operators import algebra, layout, tiles, validate
from .plans import report, solvers
from .sources import discovery, files, fixtures, generator, ranges
from .storage import discard, materialize, materialize_by, new_path

Query = Callable[[SparkSession, str], DataFrame]

BUY = "(SELECT o_custkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_SUP = """pairs AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
edges AS (SELECT a.l_suppkey AS row_id, b.l_suppkey AS col_id, -count(*)::DOUBLE AS value FROM pairs a JOIN pairs b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2),
sup AS (SELECT * FROM edges UNION ALL SELECT s_suppkey, s_suppkey, coalesce(w, 0) + 1 FROM supplier LEFT JOIN (SELECT row_id, -sum(value) AS w FROM edges GROUP BY 1) ON row_id = s_suppkey)"""
#: Suppliers by parts with repeated entries, explicit zeros, sums that vanish, columns out of range, and missing and zero diagonals.
FAULTY = """(SELECT l_suppkey AS row_id, CASE WHEN l_linenumber = 6 THEN l_suppkey + 100000000 WHEN l_linenumber % 3 = 0 AND l_suppkey % 4 <> 1 THEN l_suppkey ELSE (l_partkey + l_suppkey % 2) % 50 + CASE WHEN (l_partkey + l_suppkey % 2) % 50 = l_suppkey THEN 50 ELSE 0 END END AS col_id,
  CASE WHEN l_suppkey % 4 = 2 OR l_quantity < 5 THEN 0.0::DOUBLE ELSE l_quantity % 7 - 3 END AS value, l_orderkey * 8 + l_linenumber AS line FROM lineitem)"""
STEPS_JACOBI = 5


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.table(spark, sf_dir, "lineitem")
    supp, line = F.col("l_suppkey"), F.col("l_linenumber")
    part = (F.col("l_partkey") + supp % 2) % 50
    col = F.when(line == 6, supp + 100000000).when((line % 3 == 0) & (supp % 4 != 1), supp).otherwise(part + F.when(part == supp, 50).otherwise(0))
    value = F.when((supp % 4 == 2) | (F.col("l_quantity") < 5), 0.0).otherwise(F.col("l_quantity") % 7 - 3)
    return lines.select(supp.alias("row_id"), col.cast("long").alias("col_id"), value.alias("value"), (F.col("l_orderkey") * 8 + line).alias("line"))


def _suppliers_idx(s: SparkSession, d: str) -> DataFrame:
    return fixtures.ids(s, d, "supplier", "s_suppkey")


def _six(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _customers(s: SparkSession, d: str) -> DataFrame:
    return fixtures.ids(s, d, "customer", "c_custkey")


def _parts(s: SparkSession, d: str, value: str = "cast(idx % 7 as double)") -> DataFrame:
    return fixtures.ids(s, d, "part", "p_partkey").select("idx", F.expr(value).alias("value"))


REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


# Products -----------------------------------------------------------------

_X = "(SELECT p_partkey AS idx, (p_partkey % 7)::DOUBLE AS value FROM part)"
_AX = f"SELECT c_custkey AS idx, coalesce(v, 0.0) AS value FROM customer LEFT JOIN (SELECT row_id, sum(a.value * x.value) AS v FROM {BUY} a JOIN {_X} x ON col_id = idx GROUP BY 1) ON row_id = c_custkey"


@query(_AX)
def k1_spmv_buy(s, d):
    return algebra.spmv(fixtures.purchases(s, d), _parts(s, d), _customers(s, d))


@query(f"SELECT idx, value + idx AS value FROM ({_AX})")
def k2_spmv_accumulate(s, d):
    y = _customers(s, d).select("idx", F.col("idx").cast("double").alias("value"))
    return algebra.spmv(fixtures.purchases(s, d), _parts(s, d), _customers(s, d), y=y)


@query(_AX)
def k3_spmv_slices(s, d):
    a = fixtures.purchases(s, d)
    # a slice's entries come back from its list; slices hold at most 64 x 64 entries
    packed = a.groupBy(F.floor(F.col("row_id") / layout.SLICE), F.floor(F.col("col_id") / layout.SLICE)).agg(F.collect_list(F.struct("row_id", "col_id", "value")).alias("e"))
    return algebra.spmv(packed.select(F.explode("e").alias("e")).select("e.*"), _parts(s, d), _customers(s, d))


_TENTH = "cast(idx % 7 as double) / 10"


@query(f"SELECT c_custkey AS idx, round(coalesce(v, 0.0), 4) AS value FROM customer LEFT JOIN (SELECT row_id, sum((a.value::FLOAT * (x.value / 10)::FLOAT)::DOUBLE) AS v FROM {BUY} a JOIN {_X} x ON col_id = idx GROUP BY 1) ON row_id = c_custkey")
def k4_spmv_mixed(s, d):
    return _six(algebra.spmv(fixtures.purchases(s, d), _parts(s, d, _TENTH), _customers(s, d), algebra.MIXED), "value", digits=4)


@query(_AX)
def k8_spmv_fp32(s, d):
    return algebra.spmv(fixtures.purchases(s, d), _parts(s, d), _customers(s, d), algebra.FP32)


@query(_AX)
def k6_spmv_bitmap(s, d):
    return algebra.spmv(layout.unblock(layout.bitmap_blocks(fixtures.purchases(s, d))), _parts(s, d), _customers(s, d))


@query(f"WITH {_SUP} SELECT row_id AS idx, sum(-value * col_id) AS value FROM sup WHERE row_id <> col_id GROUP BY 1")
def k14_negated_product(s, d):
    rest = algebra.off_diagonal(fixtures.suppliers(s, d))
    return algebra.touched_rows(rest, fixtures.supplier_rhs(s, d).select("idx", (-F.col("value")).alias("value")))


@query(f"SELECT row_id AS idx, sum(value)::BIGINT AS total FROM {BUY} GROUP BY 1")
def a17_touched_row_sum(s, d):
    return fixtures.purchases(s, d).groupBy(F.col("row_id").alias("idx")).agg(F.sum("value").cast("long").alias("total"))


_LINES = "(SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE WHEN (l_orderkey * 8 + l_linenumber) % 3 = 0 THEN 0 ELSE l_partkey END AS col_id, l_quantity AS value FROM lineitem)"
_SMALL_TILES = tiles.Grid(8192, 64, 512)


@query(f"SELECT row_id AS idx, sum(a.value * x.value) AS value FROM {_LINES} a JOIN {_X} x ON col_id = idx GROUP BY 1")
def p13_tiled_product(s, d):
    return tiles.TiledMatrix(fixtures.order_lines(s, d)).touched_rows(_parts(s, d))


@query(f"SELECT col_id AS idx, sum(value * (row_id % 5)) AS value FROM {_LINES} GROUP BY 1")
def p13_tiled_transposed_product(s, d):
    lines = fixtures.order_lines(s, d)
    x = lines.select(F.col("row_id").alias("idx"), (F.col("row_id") % 5).cast("double").alias("value")).distinct()
    return tiles.TiledMatrix(algebra.transpose(lines), _SMALL_TILES).touched_rows(x)


@query(f"""SELECT row_id // {_SMALL_TILES.rows} AS tile_row, col_id // {_SMALL_TILES.cols} AS tile_col, count(*)::BIGINT AS nnz, count(*) > {_SMALL_TILES.entries} AS split, true AS bounded FROM {_LINES} GROUP BY 1, 2""")
def p13_tile_loads(s, d):
    loads = tiles.tile_loads(tiles.TiledMatrix(fixtures.order_lines(s, d), _SMALL_TILES).tiles)
    return loads.select("tile_row", "tile_col", "nnz", (F.col("nnz") > _SMALL_TILES.entries).alias("split"), (F.col("largest") <= _SMALL_TILES.entries).alias("bounded"))


# Conversions ---------------------------------------------------------------


@query(f"SELECT row_id, col_id, value FROM {BUY}")
def p1_csr_to_coo(s, d):
    rows = algebra.csr_rows(fixtures.purchases(s, d))
    return rows.select("row_id", F.explode("entries").alias("e")).select("row_id", "e.col_id", "e.value")


@query(f"SELECT col_id, count(*)::BIGINT AS n, min(row_id) AS first_row, max(row_id) AS last_row, sum(value) AS total FROM {BUY} GROUP BY 1")
def p2_coo_to_csc(s, d):
    cols = algebra.csr_rows(algebra.transpose(fixtures.purchases(s, d)))
    total = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e.value)
    parts = cols.select(F.col("row_id").alias("col_id"), F.size("entries").cast("long").alias("n"), F.get("entries", F.lit(0)).col_id.alias("first_row"), F.element_at("entries", -1).col_id.alias("last_row"), total.alias("total"))
    return parts.groupBy("col_id").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("total").alias("total"))


_PTR = f"SELECT c_custkey AS row_id, (sum(coalesce(n, 0)) OVER (ORDER BY c_custkey) - coalesce(n, 0))::BIGINT AS \"begin\", (sum(coalesce(n, 0)) OVER (ORDER BY c_custkey))::BIGINT AS \"end\" FROM customer LEFT JOIN (SELECT row_id, count(*) AS n FROM {BUY} GROUP BY 1) ON row_id = c_custkey"


@query(_PTR)
def p3_csr_pointers(s, d):
    return algebra.pointers(fixtures.purchases(s, d), _customers(s, d))


@query(f"SELECT p_partkey AS col_id, (sum(coalesce(n, 0)) OVER (ORDER BY p_partkey) - coalesce(n, 0))::BIGINT AS \"begin\", (sum(coalesce(n, 0)) OVER (ORDER BY p_partkey))::BIGINT AS \"end\" FROM part LEFT JOIN (SELECT col_id, count(*) AS n FROM {BUY} GROUP BY 1) ON col_id = p_partkey")
def p2_csc_pointers(s, d):
    found = algebra.pointers(algebra.transpose(fixtures.purchases(s, d)), fixtures.ids(s, d, "part", "p_partkey"))
    return found.withColumnRenamed("row_id", "col_id")


@query("SELECT s_nationkey AS nation, width, ceil(n / width::DOUBLE)::BIGINT AS packets, (ceil(n / 1024.0) * 1024)::BIGINT AS padded, (ceil(n / 1024.0) * 1024 - n)::BIGINT AS padding FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), (VALUES (8), (16)) AS w(width)")
def p12_packets(s, d):
    n = fixtures.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    cut = F.array(*(F.struct(F.lit(w).alias("width"), layout.packets(F.col("n"), w).alias("p")) for w in (8, 16)))
    return n.select("nation", F.explode(cut).alias("e")).select("nation", "e.width", "e.p.*")


@query(_PTR)
def p4_prefix_scan(s, d):
    return algebra.pointers(fixtures.purchases(s, d), _customers(s, d), block=64)


@query("SELECT o_custkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <> 0 GROUP BY 1, 2 HAVING sum(l_quantity) <> 0")
def p5_merge_duplicates(s, d):
    lines, orders = fixtures.table(s, d, "lineitem"), fixtures.table(s, d, "orders")
    raw = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").alias("value"))
    return algebra.merge_duplicates(raw)


@query(f"WITH {_SUP} SELECT row_id, col_id, value FROM sup")
def p6_symmetric_expansion(s, d):
    return algebra.expand_symmetric(fixtures.suppliers(s, d).where("row_id >= col_id"))


@query(f"WITH {_SUP} SELECT row_id AS idx, value FROM sup WHERE row_id = col_id")
def p8_diagonal(s, d):
    return algebra.diagonal(fixtures.suppliers(s, d))


@query(f"WITH {_SUP} SELECT row_id AS idx, round(1 / value, 9) AS value FROM sup WHERE row_id = col_id")
def p9_inverse_diagonal(s, d):
    return algebra.diagonal(fixtures.suppliers(s, d)).select("idx", F.round(1 / F.col("value"), 9).alias("value"))


@query(f"WITH {_SUP} SELECT row_id = col_id AS on_diagonal, count(*)::BIGINT AS n, sum(value) AS total FROM sup GROUP BY 1")
def p10_split(s, d):
    a = fixtures.suppliers(s, d)
    diag = algebra.diagonal(a).select(F.lit(True).alias("on_diagonal"), "value")
    both = diag.unionAll(algebra.off_diagonal(a).select(F.lit(False), "value"))
    return both.groupBy("on_diagonal").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice::FLOAT)::DOUBLE AS value FROM lineitem")
def p11_narrowing(s, d):
    return fixtures.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("float").cast("double").alias("value"))


# Validation ----------------------------------------------------------------


def _faulty_pointers(s: SparkSession, d: str) -> DataFrame:
    p = algebra.pointers(_faulty(s, d), _suppliers_idx(s, d))
    return p.select(F.col("row_id").alias("pos"), F.col("begin").alias("ptr")).unionAll(p.agg((F.max("row_id") + 1).alias("pos"), F.max("end").alias("ptr")))


@query(f"""SELECT 0::BIGINT AS too_short, 0::BIGINT AS bad_first, 0::BIGINT AS bad_last, 0::BIGINT AS decreasing, count(*) FILTER (col_id < 0 OR col_id >= (SELECT count(*) FROM supplier))::BIGINT AS bad_columns FROM {FAULTY}""")
def f1_pointer_violations(s, d):
    return validate.pointer_violations(_faulty_pointers(s, d), _faulty(s, d), _suppliers_idx(s, d).count())


@query(f"""WITH n AS (SELECT s_suppkey AS pos, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT row_id, count(*) AS n FROM {FAULTY} GROUP BY 1) ON row_id = s_suppkey),
p AS (SELECT pos, sum(n) OVER (ORDER BY pos) - n AS ptr FROM n UNION ALL SELECT max(pos) + 1, sum(n) FROM n),
q AS (SELECT pos, ptr + 1 - CASE WHEN pos % 5 = 3 THEN 100000 ELSE 0 END AS ptr FROM p)
SELECT 0::BIGINT AS too_short, 1::BIGINT AS bad_first, 1::BIGINT AS bad_last, (SELECT count(*) FROM q a JOIN q b ON b.pos = a.pos + 1 WHERE b.ptr < a.ptr)::BIGINT AS decreasing, (SELECT count(*) FILTER (col_id < 0 OR col_id >= 3) FROM {FAULTY})::BIGINT AS bad_columns""")
def f1_broken_pointers(s, d):
    broken = _faulty_pointers(s, d).select("pos", (F.col("ptr") + 1 - F.when(F.col("pos") % 5 == 3, 100000).otherwise(0)).alias("ptr"))
    return validate.pointer_violations(broken, _faulty(s, d), 3)


@query(f"SELECT row_id, col_id, value FROM {BUY} WHERE row_id < 50 AND col_id < 50")
def f2_principal(s, d):
    return algebra.principal(fixtures.purchases(s, d), 50)


@query(f"SELECT row_id, col_id, sum(value) AS value FROM {FAULTY} WHERE value <> 0 GROUP BY 1, 2 HAVING sum(value) <> 0")
def f3_drop_zeros(s, d):
    return algebra.merge_duplicates(_faulty(s, d))


@query(f"WITH {_SUP} SELECT row_id, col_id, value FROM sup WHERE row_id <> col_id")
def f4_off_diagonal(s, d):
    return algebra.off_diagonal(fixtures.suppliers(s, d))


@query(f"SELECT count(*) FILTER (v IS NULL)::BIGINT AS missing, count(*) FILTER (abs(v) <= 1e-30)::BIGINT AS too_small FROM supplier LEFT JOIN (SELECT row_id, sum(value) AS v FROM {FAULTY} WHERE row_id = col_id GROUP BY 1) ON row_id = s_suppkey")
def f6_diagonal_violations(s, d):
    return validate.diagonal_violations(_faulty(s, d), _suppliers_idx(s, d))


@query("SELECT l_orderkey * 8 + l_linenumber AS code, ((l_orderkey * 8 + l_linenumber) & 131072) <> 0 AS padding FROM lineitem")
def f9_padding(s, d):
    code = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return fixtures.table(s, d, "lineitem").select(code.alias("code"), packing.is_padding(code).alias("padding"))


# Layouts -------------------------------------------------------------------


@query(f"SELECT col_id // 64 // 128 AS batch, count(*)::BIGINT AS n, sum(value) AS total FROM {BUY} GROUP BY 1")
def l1_column_batches(s, d):
    return layout.column_batches(fixtures.purchases(s, d)).groupBy("batch").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"SELECT slice_col, slice_row, n::BIGINT AS n, (sum(n) OVER (ORDER BY slice_col, slice_row) - n)::BIGINT AS \"offset\" FROM (SELECT col_id // 64 AS slice_col, row_id // 64 AS slice_row, count(*) AS n FROM {BUY} GROUP BY 1, 2)")
def l2_slices(s, d):
    return layout.slices(fixtures.purchases(s, d))


@query("SELECT i AS row_id, ((i // 2 % 8) * 2 + i // 16 % 2) * 8 + i // 32 % 8 AS lane FROM (SELECT o_orderkey AS i FROM orders)")
def l3_lane_of_row(s, d):
    return fixtures.ids(s, d, "orders", "o_orderkey").select(F.col("idx").alias("row_id"), packing.lane_of_row(F.col("idx")).alias("lane"))


@query(" UNION ALL ".join(f"SELECT {c}::INT AS channels, i AS row_id, ((i // 2 % 8) * {c // 8} + i // 16 % {c // 8}) * 8 + i // {2 * c} % 8 AS lane FROM (SELECT c_custkey AS i FROM customer)" for c in (8, 16, 24, 32)))
def l4_lane_by_channels(s, d):
    rows = F.array(*(F.struct(F.lit(c).alias("channels"), packing.lane_of_row(F.col("idx"), c).alias("lane")) for c in (8, 16, 24, 32)))
    return _customers(s, d).select(F.col("idx").alias("row_id"), F.explode(rows).alias("e")).select("e.channels", "row_id", "e.lane")


@query("SELECT o_orderkey AS row_id, o_orderkey AS restored FROM orders")
def l5_restored_row(s, d):
    r = F.col("idx")
    return fixtures.ids(s, d, "orders", "o_orderkey").select(r.alias("row_id"), packing.global_row(packing.lane_of_row(r), packing.local_row(r)).cast("long").alias("restored"))


@query(f"SELECT row_id, col_id, ((col_id % 8192) << 50) | (((row_id // 256) * 2 + row_id % 2) << 32) AS place FROM {BUY}")
def l6_pack_place(s, d):
    return fixtures.purchases(s, d).select("row_id", "col_id", packing.pack_place(F.col("col_id") % 8192, packing.local_row(F.col("row_id"))).alias("place"))


@query(f"SELECT row_id, col_id % 8192 AS local_col, (row_id // 256) * 2 + row_id % 2 AS code, value::FLOAT::DOUBLE AS value FROM {BUY}")
def l6_element_round_trip(s, d):
    word = packing.pack_element(F.col("col_id") % 8192, packing.local_row(F.col("row_id")), F.col("value"))
    words = fixtures.purchases(s, d).select("row_id", word.alias("word"))
    return words.select("row_id", packing.unpack_element(F.col("word")).alias("e")).select("row_id", "e.local_col", "e.code", F.col("e.value").cast("double").alias("value"))


_LANES = f"(SELECT *, ((row_id // 2 % 8) * 2 + row_id // 16 % 2) * 8 + row_id // 32 % 8 AS pe, col_id // 8192 AS batch FROM {BUY})"


@query(f"SELECT row_id, col_id, value, batch, pe // 8 AS channel, pe % 8 AS lane, row_number() OVER (PARTITION BY batch, pe ORDER BY col_id, row_id) - 1 AS slot FROM {_LANES}")
def l12_lane_slots(s, d):
    return layout.lane_slots(fixtures.purchases(s, d))


@query(f"SELECT batch, channel, max(n)::BIGINT AS beats FROM (SELECT batch, pe // 8 AS channel, pe, count(*) AS n FROM {_LANES} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def l10_channel_beats(s, d):
    return layout.lane_slots(fixtures.purchases(s, d)).groupBy("batch", "channel").agg((F.max("slot") + 1).alias("beats"))


@query(f"SELECT row_id // 4 AS block_row, col_id // 4 AS block_col, bit_or((1 << (row_id % 4 * 4 + col_id % 4))::INT) AS mask, count(*)::BIGINT AS n, sum(value) AS total FROM {BUY} WHERE value <> 0 GROUP BY 1, 2")
def l13_bitmap_blocks(s, d):
    b = layout.bitmap_blocks(fixtures.purchases(s, d))
    return b.select("block_row", "block_col", "mask", F.size("places").cast("long").alias("n"), F.aggregate("places", F.lit(0.0), lambda a, p: a + p.value).alias("total"))


@query(f'SELECT block_col // 128 AS "window", block_row, count(*)::BIGINT AS n_blocks FROM (SELECT DISTINCT row_id // 4 AS block_row, col_id // 4 AS block_col FROM {BUY} WHERE value <> 0) GROUP BY 1, 2')
def l14_window_blocks(s, d):
    return layout.window_blocks(layout.bitmap_blocks(fixtures.purchases(s, d)))


@query(f"""WITH {_SUP}, size AS (SELECT ((max(s_suppkey) + 4) // 4)::BIGINT AS nb, ((max(s_suppkey) + 512) // 512)::BIGINT AS nw FROM supplier), cells AS (SELECT w AS "window", r AS block_row FROM size, unnest(range(nw)) q(w), unnest(range(nb)) t(r)),
blocks AS (SELECT DISTINCT row_id // 4 AS block_row, col_id // 4 AS block_col FROM sup WHERE value <> 0), n AS (SELECT block_col // 128 AS "window", block_row, count(*) AS n FROM blocks GROUP BY 1, 2)
SELECT "window", block_row, (sum(coalesce(n, 0)) OVER o - coalesce(n, 0))::BIGINT AS "begin", (sum(coalesce(n, 0)) OVER o)::BIGINT AS "end" FROM cells LEFT JOIN n USING ("window", block_row) WINDOW o AS (ORDER BY "window", block_row)""")
def l14_window_pointers(s, d):
    n = fixtures.table(s, d, "supplier").agg(F.max("s_suppkey") + 1).first()[0]
    return layout.window_pointers(layout.bitmap_blocks(fixtures.suppliers(s, d)), n, n)


@query(f"""WITH size AS (SELECT ((SELECT max(c_custkey) FROM customer) + 4) // 4 AS nb),
n AS (SELECT col_id // 512 AS "window", row_id // 4 AS block_row, count(DISTINCT col_id // 4) AS n FROM {BUY} GROUP BY 1, 2), c AS (SELECT *, "window" * nb + block_row AS cell FROM n, size)
SELECT "window", block_row, (sum(n) OVER o - n)::BIGINT AS "begin", (sum(n) OVER o)::BIGINT AS "end", (cell - lag(cell, 1, -1) OVER o - 1)::BIGINT AS empty_before FROM c WINDOW o AS (ORDER BY cell)""")
def l14_filled_windows(s, d):
    n_rows, n_cols = _customers(s, d).agg(F.max("idx") + 1).first()[0], _parts(s, d).agg(F.max("idx") + 1).first()[0]
    return layout.filled_windows(layout.bitmap_blocks(fixtures.purchases(s, d)), n_rows, n_cols)


@query(_AX)
def k7_spmv_windowed(s, d):
    return layout.windowed_product(layout.bitmap_blocks(fixtures.purchases(s, d)), _parts(s, d), _customers(s, d))


@query(f"""SELECT batch, sum("real")::BIGINT AS real_nnz, sum(lane_beats)::BIGINT AS lane_read_beats, (max(lane_beats) * 16)::BIGINT AS shared_read_beats, sum(ceil("real" / 8.0))::BIGINT AS compact_read_beats,
  (CASE WHEN count(*) = 16 THEN min("real") ELSE 0 END)::BIGINT AS channel_real_min, max("real")::BIGINT AS channel_real_max, (sum(lane_beats) * 8 - sum("real"))::BIGINT AS padding_slots,
  round(sum("real") / (sum(lane_beats) * 8), 6) AS density, round(sum("real") / (16 * max("real")), 6) AS channel_balance
FROM (SELECT batch, pe // 8 AS channel, sum(n) AS "real", max(n) AS lane_beats FROM (SELECT batch, pe, count(*) AS n FROM {_LANES} GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1""")
def i13_pack_profile(s, d):
    own = ("batch", "real_nnz", "lane_read_beats", "shared_read_beats", "compact_read_beats", "channel_real_min", "channel_real_max", "padding_slots", "density", "channel_balance")
    return _six(layout.pack_profile(fixtures.purchases(s, d)).select(*own), "density", "channel_balance")


def _summary_sql(channels: int, source: str = BUY) -> str:
    """One row of the gap-free layout for a number of channels."""
    width, group = layout.slice_width(channels), channels // 8
    lane = f"((row_id // 2 % 8) * {group} + row_id // 16 % {group}) * 8 + row_id // {2 * channels} % 8"
    kinds = ("lane_batch", "lane_stream", "compact_batch", "compact_stream", "balanced")
    return f"""SELECT {channels}::INT AS channels, {width}::INT AS slice_width, batches, real_nnz, matrix_len, matrix_len * {channels} AS read_beats, matrix_len * {channels * 8} - real_nnz AS padding_slots,
  round(real_nnz / (matrix_len * {channels * 8}), 6) AS density, channel_real_min, channel_real_max, pe_real_min, pe_real_max, {", ".join(f"{k}_beats" for k in kinds)},
  {", ".join(f"round(real_nnz / ({k}_beats * 8), 6) AS {k}_density" for k in kinds)}, {", ".join(f"matrix_len * {channels * 8} - {k}_beats * 8 AS {k}_savings_slots" for k in kinds)},
  round(real_nnz / (channel_real_max * {channels}), 6) AS channel_balance, round(real_nnz / (pe_real_max * {channels * 8}), 6) AS pe_balance
FROM (WITH l AS (SELECT col_id // {width} AS batch, {lane} AS pe, count(*) AS n FROM {source} GROUP BY 1, 2),
  c AS (SELECT batch, pe // 8 AS channel, sum(n) AS r, max(n) AS m FROM l GROUP BY 1, 2), p AS (SELECT pe, sum(n) AS n FROM l GROUP BY 1), s AS (SELECT pe // 8 AS channel, sum(n) AS r, max(n) AS m FROM p GROUP BY 1)
  SELECT (SELECT count(DISTINCT batch) FROM l)::BIGINT AS batches, (SELECT sum(n) FROM l)::BIGINT AS real_nnz, (SELECT sum(m) FROM (SELECT max(m) AS m FROM c GROUP BY batch))::BIGINT AS matrix_len,
    (SELECT CASE WHEN count(*) = {channels} THEN min(r) ELSE 0 END FROM s)::BIGINT AS channel_real_min, (SELECT max(r) FROM s)::BIGINT AS channel_real_max,
    (SELECT CASE WHEN count(*) = {channels * 8} THEN min(n) ELSE 0 END FROM p)::BIGINT AS pe_real_min, (SELECT max(n) FROM p)::BIGINT AS pe_real_max,
    (SELECT sum(m) FROM c)::BIGINT AS lane_batch_beats, (SELECT sum(m) FROM s)::BIGINT AS lane_stream_beats, (SELECT sum(ceil(r / 8.0)) FROM c)::BIGINT AS compact_batch_beats, (SELECT sum(ceil(r / 8.0)) FROM s)::BIGINT AS compact_stream_beats,
    (SELECT ceil(ceil(sum(r) / {channels}.0) / 8) * {channels} FROM s)::BIGINT AS balanced_beats)"""


_SUMMARY_ROUNDED = ("density", "lane_batch_density", "lane_stream_density", "compact_batch_density", "compact_stream_density", "balanced_density", "channel_balance", "pe_balance")


@query(" UNION ALL ".join(_summary_sql(c) for c in (16, 24, 32)))
def i13_pack_summary(s, d):
    a = materialize(fixtures.purchases(s, d), "matrix")
    first, *rest = (layout.pack_summary(a, c) for c in (16, 24, 32))
    for other in rest:
        first = first.unionByName(other)
    return _six(first, *_SUMMARY_ROUNDED)


@query(f"WITH {_SUP} " + _summary_sql(16, "(SELECT * FROM sup WHERE row_id <> col_id)"))
def f5_summary_without_diagonal(s, d):
    return _six(layout.pack_summary(fixtures.suppliers(s, d), drop_diagonal=True), *_SUMMARY_ROUNDED)


def _batches_sql(channels: int, order: str) -> str:
    width, group = layout.slice_width(channels), channels // 8
    lane = f"((row_id // 2 % 8) * {group} + row_id // 16 % {group}) * 8 + row_id // {2 * channels} % 8"
    return f"""SELECT batch, padding, round(density, 6) AS density, extra, round(balance, 6) AS balance FROM (
  SELECT batch, (max(m) * {channels * 8} - sum(r))::BIGINT AS padding, sum(r) / (max(m) * {channels * 8}) AS density, greatest(max(m) - ceil(sum(m) / {channels}.0), 0)::BIGINT AS extra, sum(m) / ({channels} * max(m)) AS balance
  FROM (SELECT batch, pe // 8 AS channel, sum(n) AS r, max(n) AS m FROM (SELECT col_id // {width} AS batch, {lane} AS pe, count(*) AS n FROM {_WIDE} GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1) ORDER BY {order}, batch LIMIT 5"""


#: Suppliers by orders: many columns, so that there are many batches.
_WIDE = "(SELECT l_suppkey AS row_id, l_orderkey AS col_id, l_quantity AS value FROM lineitem)"


def _top(s, d, by):
    wide = fixtures.table(s, d, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_orderkey").alias("col_id"), F.col("l_quantity").alias("value"))
    top = layout.top_batches(layout.pack_profile(wide, 24), 5, by)
    return top.select("batch", F.col("shared_padding_slots").alias("padding"), F.round("shared_density", 6).alias("density"), F.col("channel_extra_beats").cast("long").alias("extra"), F.round("beats_balance", 6).alias("balance"))


@query(_batches_sql(24, "padding DESC, density DESC"))
def o5_top_batches_by_padding(s, d):
    return _top(s, d, "padding")


@query(_batches_sql(24, "extra DESC, balance"))
def o5_top_batches_by_imbalance(s, d):
    return _top(s, d, "imbalance")


@query(f"SELECT row_id, count(*)::BIGINT AS n FROM {BUY} GROUP BY 1 ORDER BY n DESC, row_id LIMIT 10")
def o5_top_rows(s, d):
    return fixtures.purchases(s, d).groupBy("row_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "row_id").limit(10)


@query(f"SELECT row_id, col_id, value FROM {BUY} ORDER BY row_id, col_id LIMIT 24")
def o7_first_entries(s, d):
    return fixtures.purchases(s, d).orderBy("row_id", "col_id").limit(24)


# Reductions ----------------------------------------------------------------


@query(f"SELECT sum(a.value * a.value)::DOUBLE AS dot FROM ({_AX}) a")
def a1_dot(s, d):
    y = k1_spmv_buy(s, d)
    return algebra.dot(y, y)


@query(f"SELECT sqrt(sum(value * value)) AS norm FROM ({_AX})")
def a4_norm(s, d):
    return k1_spmv_buy(s, d).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


_RESIDUAL = f"(WITH {_SUP} SELECT s_suppkey AS idx, s_suppkey::DOUBLE - (SELECT sum(value * (col_id % 3)) FROM sup WHERE row_id = s_suppkey) AS r FROM supplier)"


def _residual(s, d):
    a, b = fixtures.suppliers(s, d), fixtures.supplier_rhs(s, d)
    ax = algebra.spmv(a, b.select("idx", (F.col("value") % 3).alias("value")), b)
    return algebra.axpy(-1.0, ax, b).withColumnRenamed("value", "r")


@query(f"SELECT sqrt(sum(r * r)) AS norm FROM {_RESIDUAL}")
def a5_true_residual(s, d):
    return _residual(s, d).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))


@query(f"SELECT round(sqrt(sum(r * r)) / greatest(sqrt(sum(idx::DOUBLE * idx)), 1e-30), 9) AS relative FROM {_RESIDUAL}")
def a6_relative_residual(s, d):
    r = _residual(s, d).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("idx").cast("double") * F.col("idx")).alias("bb"))
    return r.select(F.round(F.sqrt("rr") / F.greatest(F.sqrt("bb"), F.lit(1e-30)), 9).alias("relative"))


@query(f"SELECT coalesce(max(abs(r)), 0.0) AS diff_max FROM {_RESIDUAL}")
def a7_largest_change(s, d):
    return _residual(s, d).agg(F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("diff_max"))


@query(f"SELECT max(abs(r)) AS max_abs_diff, round(max(abs(r) / greatest(abs(idx::DOUBLE), 1e-12)), 6) AS max_rel_diff FROM {_RESIDUAL} WHERE idx > 0")
def a8_differences(s, d):
    rel = F.abs("r") / F.greatest(F.abs(F.col("idx").cast("double")), F.lit(1e-12))
    return _residual(s, d).where("idx > 0").agg(F.max(F.abs("r")).alias("max_abs_diff"), F.round(F.max(rel), 6).alias("max_rel_diff"))


@query(f"SELECT count(*) FILTER (abs(r - idx) / (least(abs(r), abs(idx)) + 1e-4) > 1e-4)::BIGINT AS errors FROM {_RESIDUAL}")
def a9_error_count(s, d):
    gap = F.abs(F.col("r") - F.col("idx")) / (F.least(F.abs("r"), F.abs(F.col("idx").cast("double"))) + 1e-4)
    return _residual(s, d).agg(F.count_if(gap > 1e-4).alias("errors"))


@query(f"SELECT row_id, count(*)::BIGINT AS degree FROM {BUY} GROUP BY 1")
def a10_row_degree(s, d):
    return fixtures.purchases(s, d).groupBy("row_id").agg(F.count("*").alias("degree"))


@query(f"WITH {_SUP} SELECT min(abs(value)) FILTER (row_id = col_id) AS min_diag, max(abs(value)) AS max_abs, count(*)::BIGINT AS nnz, round(count(*) / (count(DISTINCT row_id) * count(DISTINCT row_id))::DOUBLE, 9) AS density FROM sup")
def a12_matrix_summary(s, d):
    n = F.count_distinct("row_id")
    a = fixtures.suppliers(s, d)
    return a.agg(F.min(F.when(F.col("row_id") == F.col("col_id"), F.abs("value"))).alias("min_diag"), F.max(F.abs("value")).alias("max_abs"), F.count("*").alias("nnz"), F.round(F.count("*") / (n * n), 9).alias("density"))


@query(f"SELECT min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, sum(n)::BIGINT AS total, round(sum(n) / (128.0 * max(n)), 6) AS efficiency FROM (SELECT pe, count(*) AS n FROM {_LANES} GROUP BY 1)")
def a13_balance(s, d):
    n = fixtures.purchases(s, d).groupBy(packing.lane_of_row(F.col("row_id")).alias("pe")).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.sum("n").alias("total"), F.round(F.sum("n") / (128 * F.max("n")), 6).alias("efficiency"))


@query(f"WITH {_SUP} SELECT row_id AS idx, -sum(value) AS degree FROM edges GROUP BY 1")
def a14_weighted_degree(s, d):
    return algebra.off_diagonal(fixtures.suppliers(s, d)).groupBy(F.col("row_id").alias("idx")).agg((-F.sum("value")).alias("degree"))


_RUN = "o_orderkey AS run, (o_totalprice / 100)::DOUBLE AS controller_total, (o_orderkey % 7)::DOUBLE AS init_spmv, (o_custkey % 50)::DOUBLE AS iter_spmv, (o_orderkey % 5)::DOUBLE AS init_zp, (o_custkey % 9)::DOUBLE AS update_x, NULL::DOUBLE AS update_rz_reduce, (o_orderkey % 900)::DOUBLE AS update_p"


def _runs(s, d):
    """Orders taken as measured runs: whole milliseconds by stage, some not measured."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stages = {"init_spmv": k % 7, "iter_spmv": c % 50, "init_zp": k % 5, "update_x": c % 9, "update_rz_reduce": F.lit(None), "update_p": k % 900}
    return fixtures.table(s, d, "orders").select(k.alias("run"), (F.col("o_totalprice") / 100).cast("double").alias("controller_total"), *(v.cast("double").alias(n) for n, v in stages.items()))


@query(f"SELECT run, round(CASE WHEN init_spmv + iter_spmv > 0 THEN 2.0::DOUBLE * 1e6 * (run % 11) / ((init_spmv + iter_spmv) * 1e-3) / 1e9 ELSE 0 END, 6)::DOUBLE AS gflops FROM (SELECT {_RUN} FROM orders)")
def a15_throughput(s, d):
    runs = measures.stage_totals(_runs(s, d))
    return runs.select("run", F.round(measures.gflops(F.lit(1e6), F.col("run") % 11, F.col("spmv_total")), 6).alias("gflops"))


@query(f"SELECT run, init_spmv + iter_spmv AS spmv_total, init_zp + update_x + update_p AS vector_total, init_spmv + iter_spmv + init_zp + update_x + update_p AS accounted, round(controller_total - (init_spmv + iter_spmv + init_zp + update_x + update_p), 6) AS unaccounted FROM (SELECT {_RUN} FROM orders)")
def a16_stage_totals(s, d):
    return measures.stage_totals(_runs(s, d)).select("run", "spmv_total", "vector_total", "accounted", F.round("unaccounted", 6).alias("unaccounted"))


# Generator -----------------------------------------------------------------

# The edge weights, mass term and vectors below are those of the generator.
# The grid has a node for every customer.
_SIZE, _COLS = "(SELECT count(*) FROM customer)", "(SELECT ceil(sqrt(count(*)))::BIGINT FROM customer)"
_LINE = f"(SELECT unnest(range(0, {_SIZE})) AS i)"
_NODES = f"(SELECT i, i // {_COLS} AS r, i % {_COLS} AS c FROM {_LINE})"
_CONTACT = "(0.08 + 0.03 * (1.0 + sin(0.23 * r + 0.19 * c)))"
_GRID_SQL = f"""WITH n AS {_NODES}, e AS (
  SELECT i, i + 1 AS j, greatest(0.35, 1.4 + 0.18 * sin(0.17 * r) + 0.11 * cos(0.09 * c) + CASE WHEN r // 9 % 2 = 0 THEN 0.22 ELSE -0.08 END) AS w FROM n WHERE c + 1 < {_COLS}
  UNION ALL SELECT i, i + {_COLS}, greatest(0.25, 0.95 + 0.15 * cos(0.13 * r) + 0.14 * sin(0.11 * c) + CASE WHEN c // 11 % 3 = 1 THEN 0.20 ELSE 0.02 END) FROM n
  UNION ALL SELECT i, i + 2 * {_COLS} + 1, {_CONTACT} FROM n WHERE r % 13 = 5 AND c % 7 = 2 AND c + 1 < {_COLS}
  UNION ALL SELECT i, i + {_COLS} - 1, 0.85 * {_CONTACT} FROM n WHERE r % 10 = 3 AND c % 9 = 4 AND c > 0),
b AS (SELECT i AS row_id, j AS col_id, w FROM e WHERE j < {_SIZE} AND w > 0 UNION ALL SELECT j, i, w FROM e WHERE j < {_SIZE} AND w > 0),
grid AS (SELECT row_id, col_id, -sum(w) AS value FROM b GROUP BY 1, 2
  UNION ALL SELECT row_id, row_id, sum(w) FROM (SELECT row_id, w FROM b UNION ALL SELECT i, 0.18 + 0.04 * sin(0.07 * i) + 0.03 * cos(0.15 * r - 0.08 * c) FROM n) GROUP BY 1)"""


def _grid_size(s: SparkSession, d: str) -> int:
    return _customers(s, d).count()


@query(f"{_GRID_SQL} SELECT row_id, col_id, round(value::DOUBLE, 9) AS value FROM grid")
def s17_grid_matrix(s, d):
    return _six(generator.grid_matrix(s, _grid_size(s, d)), "value", digits=9)


_BUMP = f"0.28 * exp(-pow((i - greatest(1, {_SIZE} - 1)::DOUBLE * 0.63::DOUBLE) / greatest(8.0::DOUBLE, {_SIZE}::DOUBLE * 0.07::DOUBLE), 2))"
_SOLUTION = f"SELECT i AS idx, (0.75 + 0.18 * sin(0.06 * r) + 0.12 * cos(0.08 * c) + 0.0009 * i + {_BUMP})::DOUBLE AS value FROM {_NODES}"


@query(f"SELECT idx, round(value, 9) AS value FROM ({_SOLUTION})")
def s20_grid_solution(s, d):
    return _six(generator.grid_solution(s, _grid_size(s, d)), "value", digits=9)


@query(f"SELECT i AS idx, round((0.09 * cos(0.04 * i) - 0.06 * sin(0.09 * r) + 0.03 * cos(0.21 * c))::DOUBLE, 9) AS value FROM {_NODES}")
def s20_grid_guess(s, d):
    return _six(generator.grid_guess(s, _grid_size(s, d)), "value", digits=9)


@query(f"SELECT i AS idx, round((0.75 + 0.18 * sin(0.013 * i) + 0.12 * cos(0.017 * i) + 0.0000009 * i + {_BUMP})::DOUBLE, 9) AS value FROM {_LINE}")
def s20_line_solution(s, d):
    return _six(generator.line_solution(s, _grid_size(s, d)), "value", digits=9)


@query(f"{_GRID_SQL}, x AS ({_SOLUTION}) SELECT row_id AS idx, round(sum(grid.value * x.value)::DOUBLE, 8) AS value FROM grid JOIN x ON col_id = idx GROUP BY 1")
def s21_manufactured_rhs(s, d):
    x = generator.grid_solution(s, _grid_size(s, d))
    return _six(algebra.spmv(generator.grid_matrix(s, _grid_size(s, d)), x, x), "value", digits=8)


@query(f"WITH {_SUP} SELECT row_id AS idx, sum(value) AS value FROM sup GROUP BY 1")
def s22_row_sums(s, d):
    return fixtures.suppliers(s, d).groupBy(F.col("row_id").alias("idx")).agg(F.sum("value").alias("value"))


# Files ---------------------------------------------------------------------


@query(f"WITH {_SUP} SELECT row_id, col_id, value FROM sup")
def s1_csr_folder(s, d):
    path = new_path(s, "csr")
    files.write_csr_folder(fixtures.suppliers(s, d), fixtures.ids(s, d, "supplier", "s_suppkey"), path)
    return files.load_matrix(s, path)


def _written_purchases(s: SparkSession, d: str) -> str:
    path = new_path(s, "binary")
    n_rows, n_cols = _customers(s, d).agg(F.max("idx") + 1).first()[0], _parts(s, d).agg(F.max("idx") + 1).first()[0]
    files.write_binary_csr(fixtures.purchases(s, d), n_rows, n_cols, path)
    return path


@query(f"SELECT row_id, col_id, value FROM {BUY}")
def s12_binary_csr(s, d):
    return files.load_matrix(s, _written_purchases(s, d))


@query(f"SELECT row_id, col_id, value, row_number() OVER (ORDER BY row_id, col_id) - 1 AS place FROM {BUY}")
def s13_binary_writer(s, d):
    return ranges.matrix_entries(s, _written_purchases(s, d), split=1 << 16)


@query(f"SELECT row_id, col_id, value FROM {BUY} WHERE row_id < 50 AND col_id < 50")
def f2_pruned_file(s, d):
    return algebra.principal(ranges.matrix_entries(s, _written_purchases(s, d)), 50).select("row_id", "col_id", "value")


def _lines_in_order(s: SparkSession, d: str, path: str) -> str:
    """The faulty matrix as a MatrixMarket file with its entries in order of lines, columns, values and rows."""
    lines = _faulty(s, d).orderBy("line", "col_id", "value", "row_id").select("row_id", "col_id", "value")
    files.write_matrix_market(lines, path, 1 << 30, 1 << 30)
    return path


@query(f"SELECT row_id AS idx, arg_min(value, row(line, value)) AS value FROM {FAULTY} WHERE row_id = col_id GROUP BY 1")
def p8_first_diagonal(s, d):
    return algebra.first_diagonal(ranges.matrix_entries(s, _lines_in_order(s, d, new_path(s, "raw")), split=1 << 15))


@query(f"SELECT row_number() OVER (ORDER BY line, col_id, value, row_id) AS nth, row_id, col_id, value FROM {FAULTY}")
def s8_file_order(s, d):
    entries = ranges.matrix_entries(s, _lines_in_order(s, d, new_path(s, "raw")), split=1 << 16)
    # the file is read once; its entries lie by blocks of places, where they are counted
    entries = materialize_by(entries.withColumn("blk", F.floor(F.col("place") / (1 << 14))), "blk", "entries", int(s.conf.get("spark.sql.shuffle.partitions")))
    placed = algebra.with_positions(entries, [], F.col("blk"), ["place"], "before")
    return placed.select((F.col("before") + 1).alias("nth"), "row_id", "col_id", "value")


@query(f"WITH {_SUP} SELECT row_id AS idx, sum(value) AS value FROM sup GROUP BY 1")
def s4_rhs_fallback(s, d):
    path = new_path(s, "csr")
    files.write_csr_folder(fixtures.suppliers(s, d), fixtures.ids(s, d, "supplier", "s_suppkey"), path)
    return files.read_rhs(s, path, files.load_matrix(s, path))


@query(f"SELECT row_id, col_id, (value / 10)::FLOAT::DOUBLE AS value FROM {BUY} WHERE row_id < 200")
def s3_csr_with_metadata(s, d):
    path = new_path(s, "csr")
    rows = _customers(s, d).where("idx < 200")
    files.write_csr_folder(fixtures.purchases(s, d).where("row_id < 200").withColumn("value", F.col("value") / 10), rows, path)
    files.write_metadata(s, {"n": 1 << 40}, f"{path}/meta.txt")  # more columns than rows
    return files.read_csr_dataset(s, path, narrow=True)


@query("SELECT o_orderstatus AS key, max(o_orderkey)::VARCHAR AS value FROM orders GROUP BY 1")
def s5_metadata(s, d):
    path = new_path(s, "meta")
    lines = fixtures.table(s, d, "orders").groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("k")).select(F.format_string(" %s = %d", "o_orderstatus", "k").alias("value"))
    lines.write.text(path)
    return files.metadata_pairs(s.read.text(path))


@query(f"SELECT max(c_custkey) + 1 AS row_num, (SELECT max(p_partkey) + 1 FROM part) AS column_num, ceil((max(c_custkey) + 1) / 16.0)::BIGINT AS y_packets, (SELECT count(DISTINCT col_id // 8192) FROM {BUY})::BIGINT AS batch_num, 16::INT AS hbm_channels, 8192::INT AS slice_width, (SELECT sum(value) FROM ({_AX})) AS checksum FROM customer")
def k13_product_with_metrics(s, d):
    a = materialize(fixtures.purchases(s, d), "matrix")
    y = algebra.spmv(a, _parts(s, d), _customers(s, d))
    size = y.agg((F.max("idx") + 1).alias("row_num"), F.sum("value").alias("checksum"))
    cols = _parts(s, d).agg((F.max("idx") + 1).alias("column_num"))
    summary = layout.pack_summary(a).select(F.col("batches").alias("batch_num"), F.col("channels").alias("hbm_channels"), "slice_width")
    # three rows of aggregates
    one = size.crossJoin(cols).crossJoin(summary)
    return one.select("row_num", "column_num", layout.packets(F.col("row_num"), 16).packets.alias("y_packets"), "batch_num", "hbm_channels", "slice_width", "checksum")


@query(f"WITH {_SUP} SELECT row_id, col_id, value FROM sup")
def s9_matrix_market(s, d):
    path = new_path(s, "matrix") + ".mtx"
    _written_suppliers(s, d, path)
    return files.load_matrix(s, path)


@query(f"SELECT row_id, col_id, value FROM {FAULTY}")
def s8_unmerged_entries(s, d):
    path = new_path(s, "raw") + ".mtx"
    files.write_matrix_market(_faulty(s, d), path, 1 << 30, 1 << 30)
    return files.read_matrix_market(s, path, merged=False)


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS value FROM supplier")
def s10_array_vector(s, d):
    path = new_path(s, "vector")
    files.write_matrix_market_vector(fixtures.table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("value")), path)
    return files.read_matrix_market_vector(s, path)


@query("SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 0.0 END AS value FROM supplier")
def s10_coordinate_vector(s, d):
    path = new_path(s, "vector")
    rows = fixtures.table(s, d, "supplier")
    entries = rows.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("row_id"), F.lit(0).alias("col_id"), F.col("s_acctbal").alias("value"))
    files.write_matrix_market(entries, path, rows.count(), 1)
    return files.read_matrix_market_vector(s, path)


@query(f"WITH {_SUP} SELECT row_id, col_id, value FROM sup")
def s14_read_through(s, d):
    path, cache = new_path(s, "matrix") + ".mtx", new_path(s, "cache")
    _written_suppliers(s, d, path)
    files.read_through(s, path, cache)
    return files.read_through(s, path, cache)


def _written_suppliers(s: SparkSession, d: str, path: str) -> None:
    a = materialize(fixtures.suppliers(s, d), "matrix")
    files.write_matrix_market(a, path, 1 << 20, 1 << 20)
    discard(a)


def _data_folders(s: SparkSession, d: str) -> str:
    """Five folders: one without metadata, two with sizes in either form, one without values, one with a bad size."""
    root = new_path(s, "data")
    suppliers, rows = materialize(fixtures.suppliers(s, d), "matrix"), _suppliers_idx(s, d)
    bought = materialize(fixtures.purchases(s, d).where("row_id < 40 and col_id < 40"), "matrix")
    few = _customers(s, d).where("idx < 40")
    for name, matrix, over in (("plain", suppliers, rows), ("stated", suppliers, rows), ("deep/er", bought, few), ("broken", bought, few), ("odd", bought, few)):
        files.write_csr_folder(matrix, over, f"{root}/{name}", stored=True)
    files.write_metadata(s, {"name": "suppliers", "n": rows.count(), "nnz": suppliers.count(), "source": "supplier"}, f"{root}/stated/meta.txt")
    s.createDataFrame([(f'{{"name": "bought", "shape": "[40, 40]", "nnz_csr": {bought.count()}}}',)], "value string").coalesce(1).write.text(f"{root}/deep/er/meta.json")
    files.write_metadata(s, {"n": "many", "nnz": 3}, f"{root}/odd/meta.txt")
    files.remove(s, f"{root}/broken/values.txt")
    return root


_FEW = f"(SELECT count(*) FROM {BUY} WHERE row_id < 40 AND col_id < 40)"


@query(f"""WITH {_SUP}, size AS (SELECT (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM sup) AS nnz)
SELECT 'plain' AS name, n, nnz, NULL::VARCHAR AS problem FROM size UNION ALL SELECT 'suppliers', n, nnz, NULL FROM size UNION ALL SELECT 'bought', 40, {_FEW}, NULL
UNION ALL SELECT 'broken', 40, {_FEW}, 'missing values.txt' UNION ALL SELECT 'odd', NULL, 3, 'no valid size'""")
def s26_discovered_datasets(s, d):
    return discovery.discover_datasets(s, _data_folders(s, d)).select("name", "n", "nnz", "problem")


@query(f"SELECT name, n, {_FEW} AS nnz, r::BIGINT AS rows FROM (VALUES ('bought_n10', 40::BIGINT, 10), ('bought', 40, 40)) AS v(name, n, r)")
def s26_selected_datasets(s, d):
    found = discovery.discover_datasets(s, _data_folders(s, d))
    return discovery.selected(found, ["bought_n10, bought"], "plain").select("name", "n", "nnz", "rows")


@query(f"WITH {_SUP}, sums AS (SELECT row_id, sum(value) AS v FROM sup GROUP BY 1) SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, v AS value FROM sums")
def s25_number_file(s, d):
    path = new_path(s, "numbers")
    files.write_numbers(s22_row_sums(s, d).withColumnRenamed("idx", "pos"), path)
    return files.read_numbers(s, path)


@query(f"SELECT max(row_id) + 1 AS n_rows, max(col_id) + 1 AS n_cols, count(*)::BIGINT AS nnz, max(row_id) = max(col_id) AS square FROM {BUY}")
def s26_inferred_size(s, d):
    return files.inferred_size(fixtures.purchases(s, d))


@query("SELECT to_json({status: o_orderstatus, n: count(*)})::VARCHAR AS report FROM orders GROUP BY o_orderstatus")
def s27_json_report(s, d):
    counts = fixtures.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return counts.select(F.to_json(F.struct("status", "n")).alias("report"))


@query("SELECT 'report' AS tag, 'status' AS key, o_orderstatus AS value, count(*)::BIGINT AS n FROM orders GROUP BY 3 UNION ALL SELECT 'report', 'priority', string_split(o_orderpriority, ' ')[1], count(*)::BIGINT FROM orders GROUP BY 3")
def s29_report_records(s, d):
    lines = fixtures.table(s, d, "orders").select(F.concat(F.lit("[report] status="), "o_orderstatus", F.lit(" priority="), "o_orderpriority").alias("value"))
    return files.report_records(lines).groupBy("tag", "key", "value").agg(F.count("*").alias("n"))


# Updates and solvers -------------------------------------------------------


_SUM, _MIXED = "sum(value * p)", "sum((value::FLOAT * p::FLOAT)::DOUBLE)"
_FP32 = "list_reduce(list((value::FLOAT * p::FLOAT)::FLOAT ORDER BY col_id), lambda a, b: (a + b)::FLOAT)::DOUBLE"
#: Iterations that the SQL unrolls; the supplier matrix is solved to the default limit well before.
STEPS_PCG, TAU = 14, 1e-10


def _unrolled_pcg(product: str = _SUM, steps: int = STEPS_PCG) -> str:
    """Chained CTEs of the iterations from x = 0 on the supplier matrix.

    history has alpha, beta and rr by iteration, done the iteration that reaches the limit, solved its x.
    """
    parts = [f"WITH {_SUP}", "s0 AS MATERIALIZED (SELECT row_id AS idx, value AS d, 0.0::DOUBLE AS x, row_id::DOUBLE AS r, row_id / value AS z, row_id / value AS p FROM sup WHERE row_id = col_id)"]
    for k in range(steps):
        parts.append(f"ap{k} AS MATERIALIZED (SELECT row_id AS idx, {product} AS ap FROM sup JOIN s{k} ON col_id = idx GROUP BY 1)")
        parts.append(f"al{k} AS MATERIALIZED (SELECT sum(r * z) AS rz, sum(r * z) / sum(p * ap) AS alpha FROM s{k} JOIN ap{k} USING (idx))")
        parts.append(f"u{k} AS MATERIALIZED (SELECT idx, d, x + alpha * p AS x, r - alpha * ap AS r, (r - alpha * ap) / d AS z, p, rz FROM s{k} JOIN ap{k} USING (idx), al{k})")
        parts.append(f"be{k} AS MATERIALIZED (SELECT sum(r * z) / any_value(rz) AS beta, sum(r * r) AS rr, sum(r * z) AS rz FROM u{k})")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT idx, d, x, r, z, z + beta * p AS p FROM u{k}, be{k})")
    rows = ["SELECT 0::INT AS iteration, NULL::DOUBLE AS alpha, NULL::DOUBLE AS beta, sum(r * r) AS rr FROM s0"]
    parts.append("everything AS MATERIALIZED (" + " UNION ALL ".join(rows + [f"SELECT {k + 1}::INT, alpha, beta, rr FROM al{k}, be{k}" for k in range(steps)]) + ")")
    parts.append(f"done AS MATERIALIZED (SELECT min(iteration) AS k FROM everything WHERE rr <= {TAU}::DOUBLE)")
    parts.append("history AS MATERIALIZED (SELECT everything.* FROM everything, done WHERE iteration <= k)")
    parts.append("solved AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT idx, x FROM s{k}, done WHERE k = {k}" for k in range(steps + 1)) + ")")
    return parts[0] + ",\n" + ",\n".join(parts[1:])


_PCG = _unrolled_pcg()
_SOLVED = f"{_PCG} SELECT idx, round(x, 6) AS x FROM solved"


def _pcg(s, d, policy=solvers.GOLDEN, mode=algebra.FP64, matrix=None, **more):
    """The supplier system, solved to the default limit; ``matrix``: its written table."""
    return solvers.pcg(fixtures.suppliers(s, d) if matrix is None else matrix, fixtures.supplier_rhs(s, d), tau=TAU, max_iters=100, policy=policy, mode=mode, stored=matrix is not None, **more)


def _x(result, digits=6):
    return result.solution.select("idx", F.round("value", digits).alias("x"))


@query(_SOLVED)
def i1_pcg_solution(s, d):
    return _x(_pcg(s, d))


@query(f"{_PCG} SELECT iteration, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM history WHERE iteration > 0")
def i1_pcg_trace(s, d):
    return _pcg(s, d).trace_table().select("iteration", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def _outcome(s, result):
    return s.createDataFrame([(result.status, result.iterations, result.rr <= TAU, round(result.rr0, 6))], "status string, iterations int, reached boolean, rr0 double")


_OUTCOME = "SELECT 'converged' AS status, k AS iterations, true AS reached, (SELECT round(rr, 6) FROM history WHERE iteration = 0) AS rr0 FROM done"


@query(f"{_PCG} {_OUTCOME}")
def i3_pcg_host_outcome(s, d):
    a, b = fixtures.suppliers(s, d), fixtures.supplier_rhs(s, d)
    return _outcome(s, solvers.pcg(a, b))  # default limits


@query(f"{_unrolled_pcg(_MIXED)} SELECT idx, round(x, 3) AS x FROM solved")
def i4_pcg_mixed(s, d):
    return _x(_pcg(s, d, solvers.HOST, algebra.MIXED), 3)


@query(f"{_unrolled_pcg(_FP32)} SELECT idx, round(x, 3) AS x FROM solved")
def i7_pcg_fp32(s, d):
    return _x(_pcg(s, d, solvers.KERNEL, algebra.FP32), 3)


@query(f"{_PCG}, ax AS (SELECT row_id AS idx, sum(value * x) AS v FROM sup JOIN solved ON col_id = idx GROUP BY 1) SELECT sqrt(sum((v - idx) * (v - idx))) < 1e-4 AS small FROM ax")
def i2_true_residual(s, d):
    residual = solvers.true_residual(fixtures.suppliers(s, d), _pcg(s, d).solution, fixtures.supplier_rhs(s, d))
    return residual.select((F.col("norm") < 1e-4).alias("small"))


@query(_SOLVED)
def i5_pcg_blocked(s, d):
    a = materialize(fixtures.suppliers(s, d), "matrix")
    return _x(_pcg(s, d, solvers.HOST, matrix=a, multiply=layout.StoredBlocks(a).multiply))


@query(_SOLVED)
def i6_pcg_windowed(s, d):
    a = materialize(fixtures.suppliers(s, d), "matrix")
    return _x(_pcg(s, d, solvers.KERNEL, matrix=a, multiply=layout.StoredBlocks(a, windowed=True).multiply))


@query(_SOLVED)
def i5_pcg_tiled(s, d):
    a = materialize(fixtures.suppliers(s, d), "matrix")
    own = tiles.TiledMatrix(a, tiles.Grid(256, 64, 512))
    return _x(_pcg(s, d, solvers.HOST, matrix=a, multiply=own.multiply))


# Measured runs: times differ from run to run, so queries give what must hold for them.


@query(f"""{_PCG} SELECT 'setup' AS stage, 3::BIGINT AS calls, true AS took_time FROM done UNION ALL SELECT 'init', 1, true FROM done UNION ALL SELECT 'product', k, true FROM done
UNION ALL SELECT 'update', k, true FROM done UNION ALL SELECT 'other', 1, true FROM done""")
def a16_measured_stages(s, d):
    stages = _pcg(s, d).clock.table(s)
    return stages.select("stage", "calls", (F.col("seconds") > 0).alias("took_time"))


@query(f"""{_PCG} SELECT 2 * (SELECT count(*) FROM sup) * k AS operations, true AS positive, true AS adds_up FROM done""")
def a15_measured_throughput(s, d):
    a = materialize(fixtures.suppliers(s, d), "matrix")
    solved = solvers.pcg(a, fixtures.supplier_rhs(s, d), tau=TAU, max_iters=100)
    made = report.run_report(solved, a, fixtures.supplier_rhs(s, d), {})
    product = F.filter("timing", lambda t: t.stage == "product")[0]
    total = F.aggregate("timing", F.lit(0.0), lambda n, t: n + t.seconds)
    rate = F.col("operations") / product.seconds / 1e9
    sized = made.withColumn("operations", 2 * F.col("dataset.nnz") * product.calls)
    return sized.select("operations", ((F.col("product_gflops") > 0) & (F.abs(F.col("product_gflops") / rate - 1) < 1e-9)).alias("positive"), (F.abs(total / F.col("wall_seconds") - 1) < 0.01).alias("adds_up"))


@query(f"{_PCG} SELECT 'converged' AS status, k::BIGINT AS iterations, k::BIGINT AS products, k::BIGINT AS updates, (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM sup) AS nnz, true AS small FROM done")
def i8_pcg_graph_metrics(s, d):
    a, b = materialize(fixtures.suppliers(s, d), "matrix"), fixtures.supplier_rhs(s, d)
    made = report.run_report(solvers.pcg(a, b, tau=TAU, max_iters=100, policy=solvers.GRAPH), a, b, {"policy": "graph"})
    calls = lambda stage: F.filter("timing", lambda t: t.stage == stage)[0].calls
    return made.select("result.status", "result.iterations", calls("product").alias("products"), calls("update").alias("updates"), "dataset.n", "dataset.nnz", (F.col("result.residual_rel") < 1e-5).alias("small"))


def _report(s: SparkSession, d: str) -> DataFrame:
    a, b = materialize(fixtures.suppliers(s, d), "matrix"), fixtures.supplier_rhs(s, d)
    solved = solvers.pcg(a, b, tau=TAU, max_iters=100)
    return report.run_report(solved, a, b, {"tau": TAU, "max_iters": 100, "policy": "host"}, {"true_residual": solvers.true_residual(a, solved.solution, b).first()[0]})


@query(f"{_PCG} SELECT h.iteration, round(log10(h.rr), 3) AS log_rr, k::BIGINT AS iterations, (SELECT count(*) FROM sup) AS nnz, 'host' AS policy, true AS small FROM history h, done WHERE h.iteration > 0")
def s27_full_report(s, d):
    path = new_path(s, "report")
    report.as_json(_report(s, d)).write.text(path)
    back = report.from_json(s.read.text(path).withColumnRenamed("value", "report"))
    steps = back.select("result.iterations", "dataset.nnz", F.col("config")["policy"].alias("policy"), (F.col("errors")["true_residual"] < 1e-4).alias("small"), F.explode("trace").alias("t"))
    return steps.select("t.iteration", F.round(F.log10("t.rr"), 3).alias("log_rr"), "iterations", "nnz", "policy", "small")


@query(f"{_PCG} SELECT 'iteration' AS tag, k::BIGINT AS lines FROM done UNION ALL SELECT tag, n FROM (VALUES ('config', 3::BIGINT), ('dataset', 1), ('result', 1), ('error', 1), ('stage', 5), ('total', 1)) AS v(tag, n)")
def s27_report_lines(s, d):
    path = new_path(s, "report")
    report.as_lines(_report(s, d)).orderBy("at").select("value").write.text(path)
    first = {"config": 1, "dataset": 2, "result": 7, "error": 1, "stage": 4, "total": 2, "iteration": 6}
    width = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    records = files.report_records(s.read.text(path)).groupBy("tag").agg(F.count("*").alias("n"))
    return records.select("tag", (F.col("n") / width[F.col("tag")]).cast("long").alias("lines"))


@query(f"{_PCG} {_OUTCOME}")
def i8_pcg_graph_outcome(s, d):
    return _outcome(s, _pcg(s, d, solvers.GRAPH))


@query(f"{_PCG} SELECT iteration, round(log10(rr), 3) AS log_rr FROM history")
def i9_residual_history(s, d):
    history = _pcg(s, d, solvers.SPLIT).history_table()
    return history.select("iteration", F.round(F.log10("rr"), 3).alias("log_rr"))


@query(_SOLVED)
def i14_pcg_exact_policy(s, d):
    return _x(_pcg(s, d, solvers.EXACT))


# What each variant makes of a solvable system with max_iters 0, of p.Ap = 0, of tau = -1 and of an infinite right-hand side.
_POLICY_OUTCOMES = {
    "golden": ("converged 1", "ArithmeticError", "ValueError", "max_iter 1"),
    "host": ("converged 1", "breakdown 0", "ValueError", "breakdown 0"),
    "kernel": ("max_iter 0", "breakdown 0", "breakdown 0", "breakdown 1"),
    "graph": ("converged 1", "breakdown 0", "breakdown 0", "max_iter 1"),
    "split": ("max_iter 0", "breakdown 0", "breakdown 0", "breakdown 1"),
    "exact": ("max_iter 0", "ArithmeticError", "ValueError", "ArithmeticError"),
}


@query("SELECT *, (SELECT count(*) FROM supplier) AS n_rows FROM (VALUES " + ", ".join(str((k, *v)) for k, v in _POLICY_OUTCOMES.items()) + ") AS v(policy, no_limit, flat, bad_tau, infinite)")
def i14_policy_outcomes(s, d):
    i = F.col("idx")
    rows = _suppliers_idx(s, d)
    good = materialize(rows.select(i.alias("row_id"), i.alias("col_id"), (2.0 + i % 3).alias("value")), "policy")
    pairs = F.explode(F.array(i, i + 1 - 2 * (i % 2)))  # neighbours 0 and 1, 2 and 3, ...
    flat = materialize(rows.select(i.alias("row_id"), pairs.alias("col_id"), F.lit(1.0).alias("value")), "policy")
    b, odd = rows.select("idx", (2.0 + i % 3).alias("value")), rows.select("idx", (1.0 - 2 * (i % 2)).alias("value"))
    endless = rows.select("idx", F.when(i == 0, float("inf")).otherwise(2.0 + i % 3).alias("value"))

    def outcome(*args, **more):
        try:
            r = solvers.pcg(*args, **more)
            return f"{r.status} {r.iterations}"
        except (ArithmeticError, ValueError) as x:
            return type(x).__name__

    found = []
    for name in _POLICY_OUTCOMES:
        policy = getattr(solvers, name.upper())
        found.append((name, outcome(good, b, policy=policy), outcome(flat, odd, max_iters=2, policy=policy), outcome(good, b, tau=-1.0, policy=policy), outcome(good, endless, max_iters=2, policy=policy), rows.count()))
    return s.createDataFrame(found, "policy string, no_limit string, flat string, bad_tau string, infinite string, n_rows long")


@query(f"{_PCG} SELECT to_json({{status: 'converged', iterations: k, reached: true}})::VARCHAR AS report FROM done")
def s27_run_report(s, d):
    return _outcome(s, _pcg(s, d)).select(F.to_json(F.struct("status", "iterations", "reached")).alias("report"))


@query(f"{_PCG} SELECT idx, round(x, 6) AS x FROM solved ORDER BY idx LIMIT 16")
def o6_first_rows(s, d):
    return _x(_pcg(s, d)).orderBy("idx").limit(16)


@query(f"WITH {_SUP}, s AS (SELECT row_id AS idx, row_id::DOUBLE AS r, row_id / value AS z FROM sup WHERE row_id = col_id), a AS (SELECT row_id AS idx, sum(value * z) AS ap FROM sup JOIN s ON col_id = idx GROUP BY 1) SELECT round(sum(r * z), 6) AS rz, round(sum(r * r), 6) AS rr, round(sum(z * ap), 6) AS pap FROM s JOIN a USING (idx)")
def v1_start_sums(s, d):
    a, b = fixtures.suppliers(s, d), fixtures.supplier_rhs(s, d)
    state = b.select("idx", F.col("value").alias("r")).join(algebra.diagonal(a), "idx").select("idx", "r", (F.col("r") / F.col("value")).alias("z"))
    state = state.join(algebra.spmv(a, state.select("idx", F.col("z").alias("value")), b), "idx")
    total = lambda x, y: F.round(F.sum(F.col(x) * F.col(y)), 6)
    return state.agg(total("r", "z").alias("rz"), total("r", "r").alias("rr"), total("z", "value").alias("pap"))


@query(f"{_unrolled_pcg(steps=1)} SELECT idx, round(x, 6) AS x, round(r, 6) AS r, round(z, 6) AS z, round(p, 6) AS p FROM s1")
def v2_first_step(s, d):
    b = fixtures.supplier_rhs(s, d)
    a = fixtures.suppliers(s, d)
    start = b.select("idx", F.col("value").alias("r")).join(algebra.diagonal(a).withColumnRenamed("value", "d"), "idx").withColumn("z", F.col("r") / F.col("d"))
    state = start.join(algebra.spmv(a, start.select("idx", F.col("z").alias("value")), b).withColumnRenamed("value", "ap"), "idx")
    # two one-row aggregates
    first = state.agg(F.sum(F.col("r") * F.col("z")).alias("rz"), F.sum(F.col("z") * F.col("ap")).alias("pap"))
    new = state.crossJoin(F.broadcast(first)).withColumn("alpha", F.col("rz") / F.col("pap")).select("idx", "d", "rz", (F.col("alpha") * F.col("z")).alias("x"), (F.col("r") - F.col("alpha") * F.col("ap")).alias("r"), F.col("z").alias("p"))
    new = new.withColumn("z", F.col("r") / F.col("d"))
    beta = new.agg((F.sum(F.col("r") * F.col("z")) / F.max("rz")).alias("beta"))
    out = new.crossJoin(F.broadcast(beta)).select("idx", "x", "r", "z", (F.col("z") + F.col("beta") * F.col("p")).alias("p"))
    return _six(out, "x", "r", "z", "p")


_JACOBI = f"WITH {_SUP}, j0 AS (SELECT row_id AS idx, value AS d, 0.0::DOUBLE AS x FROM sup WHERE row_id = col_id), " + ", ".join(
    f"j{k + 1} AS MATERIALIZED (SELECT idx, d, (idx - coalesce(rx, 0)) / d AS x FROM j{k} LEFT JOIN (SELECT row_id, sum(value * x) AS rx FROM sup JOIN j{k} ON col_id = idx WHERE row_id <> col_id GROUP BY 1) ON row_id = idx)" for k in range(STEPS_JACOBI)
)


@query(f"{_JACOBI} SELECT idx, round(x, 6) AS x FROM j{STEPS_JACOBI}")
def i10_jacobi(s, d):
    return solvers.jacobi(fixtures.suppliers(s, d), fixtures.supplier_rhs(s, d), STEPS_JACOBI)[0].select("idx", F.round("value", 6).alias("x"))


@query(f"{_JACOBI} SELECT round(max(abs(a.x - b.x)), 6) AS diff_max FROM j{STEPS_JACOBI} a JOIN j{STEPS_JACOBI - 1} b USING (idx)")
def i11_jacobi_change(s, d):
    change = solvers.jacobi(fixtures.suppliers(s, d), fixtures.supplier_rhs(s, d), STEPS_JACOBI)[1]
    return s.range(1).select(F.round(F.lit(change), 6).alias("diff_max"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
