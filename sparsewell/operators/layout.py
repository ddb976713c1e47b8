"""Tilings of the edge table: column batches, slices, bitmap blocks, windows and lane placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import lane_of_row
from ..storage import discard, materialize_by
from .algebra import COLUMN_BLOCK, pointers, prefix, with_positions

# Fixed values of the layouts.
SLICE, SLICES_PER_BATCH, BLOCK, WINDOW_BLOCKS, LANES = 64, 128, 4, 128, 8


def slice_width(channels: int = 16) -> int:
    """Columns of one batch: whole slices of four columns per channel within 8192."""
    return SLICE * SLICES_PER_BATCH // (4 * channels) * (4 * channels)


def column_batches(matrix: DataFrame, channels: int = 16) -> DataFrame:
    """Entries with the batch of their column."""
    return matrix.withColumn("batch", F.floor(F.col("col_id") / slice_width(channels)))


def slices(matrix: DataFrame) -> DataFrame:
    """Entries per 64 x 64 slice, with the offset of each slice in column-slice-major order.

    Prefix sums run inside blocks of slice columns and over block totals.
    """
    counts = matrix.groupBy(F.floor(F.col("col_id") / SLICE).alias("slice_col"), F.floor(F.col("row_id") / SLICE).alias("slice_row")).agg(F.count("*").alias("n"))
    per_col = counts.groupBy("slice_col").agg(F.sum("n").alias("n")).select(F.col("slice_col").alias("row_id"), "n")
    base = prefix(per_col).select(F.col("row_id").alias("slice_col"), F.col("begin").alias("base"))
    blocked = counts.withColumn("blk", F.floor(F.col("slice_row") / COLUMN_BLOCK))
    totals = blocked.groupBy("slice_col", "blk").agg(F.sum("n").alias("t"))
    before = totals.select("slice_col", "blk", (F.sum("t").over(Window.partitionBy("slice_col").orderBy("blk")) - F.col("t")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("slice_col", "blk").orderBy("slice_row")) - F.col("n")
    placed = blocked.withColumn("inside", inside).join(before, ["slice_col", "blk"]).join(base, "slice_col")
    return placed.select("slice_col", "slice_row", "n", (F.col("base") + F.col("before") + F.col("inside")).alias("offset"))


def bitmap_blocks(matrix: DataFrame) -> DataFrame:
    """4 x 4 blocks: bit mask of filled places and their values in place order."""
    place = (F.col("row_id") % BLOCK) * BLOCK + F.col("col_id") % BLOCK
    merged = matrix.groupBy("row_id", "col_id").agg(F.sum("value").alias("value")).where("value <> 0")
    at = merged.select(F.floor(F.col("row_id") / BLOCK).alias("block_row"), F.floor(F.col("col_id") / BLOCK).alias("block_col"), place.cast("int").alias("place"), "value")
    # at most sixteen values a block
    return at.groupBy("block_row", "block_col").agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("mask"), F.sort_array(F.collect_list(F.struct("place", "value"))).alias("places"))


def placed_blocks(matrix: DataFrame) -> DataFrame:
    """4 x 4 blocks with a value or null for each place: v0 to v15, row by row.

    Entries are dealt by their block once; repeated ones are summed where their block is put together.
    """
    place = (F.col("row_id") % BLOCK) * BLOCK + F.col("col_id") % BLOCK
    at = matrix.select(F.floor(F.col("row_id") / BLOCK).alias("block_row"), F.floor(F.col("col_id") / BLOCK).alias("block_col"), place.cast("int").alias("place"), F.col("value").cast("double").alias("value"))
    values = {f"v{k}": F.sum(F.when(F.col("place") == k, F.col("value"))) for k in range(BLOCK * BLOCK)}
    blocks = at.repartition("block_row", "block_col").groupBy("block_row", "block_col").agg(*(v.alias(n) for n, v in values.items()))
    filled = blocks.select("block_row", "block_col", *(F.when(F.col(n) != 0, F.col(n)).alias(n) for n in values))
    return filled.where(F.coalesce(*values).isNotNull())


def unblock(blocks: DataFrame) -> DataFrame:
    """Entries of bitmap blocks."""
    e = blocks.select("block_row", "block_col", F.explode("places").alias("p"))
    return e.select((F.col("block_row") * BLOCK + F.floor(F.col("p.place") / BLOCK)).alias("row_id"), (F.col("block_col") * BLOCK + F.col("p.place") % BLOCK).alias("col_id"), F.col("p.value").alias("value"))


def window_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks per column window and block row."""
    return blocks.groupBy(F.floor(F.col("block_col") / WINDOW_BLOCKS).alias("window"), "block_row").agg(F.count("*").alias("n_blocks"))


def window_pointers(blocks: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Pointers (window, block_row, begin, end) of every cell of the dense grid of windows and block rows, window by window."""
    per_window, windows = -(-n_rows // BLOCK), -(-n_cols // (WINDOW_BLOCKS * BLOCK))
    cell = (F.floor(F.col("block_col") / WINDOW_BLOCKS) * per_window + F.col("block_row")).cast("long")
    grid = blocks.sparkSession.range(per_window * windows).withColumnRenamed("id", "idx")
    found = pointers(blocks.select(cell.alias("row_id")), grid)
    return found.select(F.floor(F.col("row_id") / per_window).alias("window"), (F.col("row_id") % per_window).alias("block_row"), "begin", "end")


def filled_windows(blocks: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``window_pointers`` of filled cells only: window, block_row, begin, end, and how many empty cells stand before.

    Its size is that of the filled cells, whatever the grid.  Prefix sums and
    neighbours run inside ranges of cells and over range totals, of which there
    are at most 2**20.
    """
    per_window, windows = -(-n_rows // BLOCK), -(-n_cols // (WINDOW_BLOCKS * BLOCK))
    size = max(COLUMN_BLOCK, -(-per_window * windows // (1 << 20)))
    cell = (F.floor(F.col("block_col") / WINDOW_BLOCKS) * per_window + F.col("block_row")).cast("long")
    counts = blocks.groupBy(cell.alias("row_id")).agg(F.count("*").alias("n"))
    placed = prefix(counts, size).withColumn("blk", F.floor(F.col("row_id") / size))
    last = placed.groupBy("blk").agg(F.max("row_id").alias("last"))
    before = last.select("blk", F.lag("last").over(Window.orderBy("blk")).alias("earlier"))
    inside = F.lag("row_id").over(Window.partitionBy("blk").orderBy("row_id"))
    found = placed.withColumn("inside", inside).join(before, "blk")
    empty = F.col("row_id") - F.coalesce("inside", "earlier", F.lit(-1)) - 1
    return found.select(F.floor(F.col("row_id") / per_window).alias("window"), (F.col("row_id") % per_window).alias("block_row"), "begin", "end", empty.alias("empty_before"))


def windowed_product(blocks: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """A x of bitmap blocks: partial sums by column window, then over windows."""
    entries = unblock(blocks).withColumn("window", F.floor(F.col("col_id") / (WINDOW_BLOCKS * BLOCK)))
    joined = entries.join(x.select(F.col("idx").alias("col_id"), F.col("value").alias("x")), "col_id")
    parts = joined.groupBy("row_id", "window").agg(F.sum(F.col("value") * F.col("x")).alias("part"))
    sums = parts.groupBy(F.col("row_id").alias("idx")).agg(F.sum("part").alias("value"))
    return rows.select("idx").join(sums, "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))


class StoredBlocks:
    """Blocks written by block column, a column for each of their sixteen places, with products where they lie.

    ``windowed`` adds partial sums by column window first.  A product moves the
    values of x, four to a block column, and four sums by block row, never the blocks.
    """

    def __init__(self, matrix: DataFrame, windowed: bool = False, buckets: int | None = None):
        self.windowed = windowed
        buckets = buckets or int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = materialize_by(placed_blocks(matrix), "block_col", "blocks", buckets)

    def multiply(self, x: DataFrame, rows: DataFrame) -> DataFrame:
        """A x for every idx of ``rows``; rows without entries give 0.  ``x`` has at most one value for each idx."""
        fours = x.groupBy(F.floor(F.col("idx") / BLOCK).alias("block_col")).agg(*(F.max(F.when(F.col("idx") % BLOCK == k, F.col("value"))).alias(f"x{k}") for k in range(BLOCK)))
        # an empty place or a missing value of x adds nothing
        part = lambda r: sum((F.coalesce(F.col(f"v{r * BLOCK + k}") * F.col(f"x{k}"), F.lit(0.0)) for k in range(1, BLOCK)), F.coalesce(F.col(f"v{r * BLOCK}") * F.col("x0"), F.lit(0.0)))
        terms = self.blocks.join(fours, "block_col").select("block_row", F.floor(F.col("block_col") / WINDOW_BLOCKS).alias("window"), *(part(r).alias(f"s{r}") for r in range(BLOCK)))
        added = [F.sum(f"s{r}").alias(f"s{r}") for r in range(BLOCK)]
        terms = terms.groupBy("block_row", "window").agg(*added) if self.windowed else terms
        sums = terms.groupBy("block_row").agg(*added)
        sums = sums.select(F.inline(F.array(*(F.struct((F.col("block_row") * BLOCK + r).alias("idx"), F.col(f"s{r}").alias("value")) for r in range(BLOCK)))))
        return rows.select("idx").join(sums, "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))

    def close(self) -> None:
        discard(self.blocks)


def lane_slots(matrix: DataFrame, channels: int = 16) -> DataFrame:
    """Entries with batch, channel, lane and slot: lanes hold their entries by column, then row, without gaps."""
    placed = column_batches(matrix, channels).withColumn("pe", lane_of_row(F.col("row_id"), channels))
    placed = with_positions(placed, ["batch", "pe"], F.col("col_id"), ["row_id"], "slot")
    return placed.select("row_id", "col_id", "value", "batch", F.floor(F.col("pe") / LANES).alias("channel"), (F.col("pe") % LANES).alias("lane"), "slot")


def _lanes(matrix: DataFrame, channels: int, drop_diagonal: bool) -> DataFrame:
    """Entries n by batch, channel and lane (pe)."""
    kept = matrix.where("row_id <> col_id") if drop_diagonal else matrix
    pe = lane_of_row(F.col("row_id"), channels)
    return column_batches(kept, channels).withColumn("pe", pe).groupBy("batch", F.floor(F.col("pe") / LANES).alias("channel"), "pe").agg(F.count("*").alias("n"))


def pack_profile(matrix: DataFrame, channels: int = 16, drop_diagonal: bool = False) -> DataFrame:
    """Load balance of the gap-free layout: entries, beats, density and padding per batch and over channels."""
    lanes = _lanes(matrix, channels, drop_diagonal)
    per_channel = lanes.groupBy("batch", "channel").agg(F.sum("n").alias("real"), F.max("n").alias("lane_beats"), F.ceil(F.sum("n") / LANES).alias("compact_beats"))
    batch = per_channel.groupBy("batch").agg(
        F.sum("real").alias("real_nnz"),
        F.sum("lane_beats").alias("lane_read_beats"),
        (F.max("lane_beats") * channels).alias("shared_read_beats"),
        F.sum("compact_beats").alias("compact_read_beats"),
        F.when(F.count("*") == channels, F.min("real")).otherwise(0).alias("channel_real_min"),
        F.max("real").alias("channel_real_max"),
        F.max("lane_beats").alias("longest"),
    )
    slots, shared = F.col("lane_read_beats") * LANES, F.col("shared_read_beats") * LANES
    ideal = F.ceil(F.col("lane_read_beats") / channels)
    return batch.select(
        *(c for c in batch.columns if c != "longest"),
        (slots - F.col("real_nnz")).alias("padding_slots"),
        (F.col("real_nnz") / slots).alias("density"),
        (F.col("real_nnz") / (channels * F.col("channel_real_max"))).alias("channel_balance"),
        (shared - F.col("real_nnz")).alias("shared_padding_slots"),
        (F.col("real_nnz") / shared).alias("shared_density"),
        F.greatest(F.col("longest") - ideal, F.lit(0)).alias("channel_extra_beats"),
        (F.col("lane_read_beats") / (channels * F.col("longest"))).alias("beats_balance"),
    )


def top_batches(profile: DataFrame, n: int, by: str = "padding") -> DataFrame:
    """The ``n`` batches with most padding, or with the largest channel imbalance (``by="imbalance"``)."""
    order = [F.desc("shared_padding_slots"), F.desc("shared_density")] if by == "padding" else [F.desc("channel_extra_beats"), F.asc("beats_balance")]
    return profile.orderBy(*order, "batch").limit(n)


def pack_summary(matrix: DataFrame, channels: int = 16, drop_diagonal: bool = False) -> DataFrame:
    """One row over all batches of the gap-free layout, by how channels and lanes are filled.

    ``shared``: all lanes are as long as a batch's longest; ``lane``: a channel's
    lanes are as long as its longest, by batch or as one stream; ``compact``: a
    channel's entries are dealt over its lanes; ``balanced``: over all channels.
    """
    lanes = _lanes(matrix, channels, drop_diagonal)
    pes = channels * LANES
    per_channel = lanes.groupBy("batch", "channel").agg(F.sum("n").alias("real"), F.max("n").alias("longest"))
    batch = per_channel.groupBy("batch").agg(F.max("longest").alias("longest"))
    by_batch = batch.agg(F.count("*").alias("batches"), F.coalesce(F.sum("longest"), F.lit(0)).alias("matrix_len"))
    beats = per_channel.agg(F.coalesce(F.sum("longest"), F.lit(0)).alias("lane_batch_beats"), F.coalesce(F.sum(F.ceil(F.col("real") / LANES)), F.lit(0)).alias("compact_batch_beats"))
    pe = lanes.groupBy("channel", "pe").agg(F.sum("n").alias("n"))
    least = lambda c, count: F.when(F.count("*") == count, F.min(c)).otherwise(0)
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    by_pe = pe.agg(least("n", pes).alias("pe_real_min"), most("n").alias("pe_real_max"))
    stream = pe.groupBy("channel").agg(F.sum("n").alias("real"), F.max("n").alias("longest"))
    by_channel = stream.agg(
        F.coalesce(F.sum("real"), F.lit(0)).alias("real_nnz"),
        least("real", channels).alias("channel_real_min"),
        most("real").alias("channel_real_max"),
        F.coalesce(F.sum("longest"), F.lit(0)).alias("lane_stream_beats"),
        F.coalesce(F.sum(F.ceil(F.col("real") / LANES)), F.lit(0)).alias("compact_stream_beats"),
    )
    # four rows of aggregates
    one = by_channel.crossJoin(by_pe).crossJoin(by_batch).crossJoin(beats)
    one = one.withColumn("read_beats", F.col("matrix_len") * channels).withColumn("balanced_beats", F.ceil(F.ceil(F.col("real_nnz") / channels) / LANES) * channels)
    share = lambda b: F.coalesce(F.try_divide(F.col("real_nnz"), F.col(b) * LANES), F.lit(0.0))
    kinds = ("lane_batch", "lane_stream", "compact_batch", "compact_stream", "balanced")
    even = lambda top, count: F.coalesce(F.try_divide(F.col("real_nnz"), F.col(top) * count), F.lit(0.0))
    return one.select(
        F.lit(channels).alias("channels"),
        F.lit(slice_width(channels)).alias("slice_width"),
        "batches",
        "real_nnz",
        "matrix_len",
        "read_beats",
        (F.col("read_beats") * LANES - F.col("real_nnz")).alias("padding_slots"),
        share("read_beats").alias("density"),
        "channel_real_min",
        "channel_real_max",
        "pe_real_min",
        "pe_real_max",
        *(F.col(f"{k}_beats").cast("long") for k in kinds),
        *(share(f"{k}_beats").alias(f"{k}_density") for k in kinds),
        *((F.col("read_beats") * LANES - F.col(f"{k}_beats") * LANES).cast("long").alias(f"{k}_savings_slots") for k in kinds),
        even("channel_real_max", channels).alias("channel_balance"),
        even("pe_real_max", pes).alias("pe_balance"),
    )


def packets(length: Column, width: int, align: int = 1024) -> Column:
    """Struct (packets, padded, padding) of a vector of ``length`` cut into packets of ``width`` and padded to ``align``."""
    padded = F.ceil(length / align) * align
    return F.struct(F.ceil(length / width).alias("packets"), padded.alias("padded"), (padded - length).alias("padding"))
