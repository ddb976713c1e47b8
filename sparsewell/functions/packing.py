"""Row placement and 64-bit element words as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, LongType

# Rows per packet, lanes per channel, checkers, and the bit positions of a word.
ROWS_PER_PACKET, LANES, CHECKERS = 2, 8, 8
COL_SHIFT, ROW_SHIFT, ROW_MASK, COL_MASK, PADDING_BIT = 50, 32, 0x3FFFF, 0x3FFF, 0x20000


def lane_of_row(row: Column, channels: int = 16) -> Column:
    """Global lane number of a row, for 8, 16, 24 or 32 channels."""
    group = channels // CHECKERS
    packet = F.floor(row / ROWS_PER_PACKET)
    return ((packet % CHECKERS) * group + F.floor(packet / CHECKERS) % group) * LANES + F.floor(packet / channels) % LANES


def local_row(row: Column, channels: int = 16) -> Column:
    """Row code inside its lane: group in the high bits, parity in bit 0."""
    return F.floor(row / (ROWS_PER_PACKET * channels * LANES)) * 2 + row % 2


def global_row(lane: Column, code: Column, channels: int = 16) -> Column:
    """Inverse of ``lane_of_row`` with ``local_row``."""
    group = channels // CHECKERS
    channel = F.floor(lane / LANES)
    packet = F.floor(code / 2) * (channels * LANES) + F.floor(channel / group) + (channel % group) * CHECKERS + (lane % LANES) * channels
    return packet * 2 + code % 2


def pack_place(local_col: Column, code: Column) -> Column:
    """Column and row bits of an element word."""
    col = F.shiftleft(local_col.cast("long").bitwiseAND(F.lit(COL_MASK).cast("long")), COL_SHIFT)
    return col.bitwiseOR(F.shiftleft(code.cast("long").bitwiseAND(F.lit(ROW_MASK).cast("long")), ROW_SHIFT))


@F.pandas_udf(LongType())
def _float_bits(value: pd.Series) -> pd.Series:
    return pd.Series(value.to_numpy(np.float32).view(np.uint32).astype(np.int64))


@F.pandas_udf(FloatType())
def _bits_float(bits: pd.Series) -> pd.Series:
    return pd.Series(bits.to_numpy(np.int64).astype(np.uint32).view(np.float32))


def pack_element(local_col: Column, code: Column, value: Column) -> Column:
    """Element word: column and row bits above the bits of the 32-bit value (SQL has no such cast)."""
    return pack_place(local_col, code).bitwiseOR(_float_bits(value.cast("float")))


def unpack_element(word: Column) -> Column:
    """Struct (local_col, code, value) of an element word."""
    bits = lambda shift, mask: F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(mask).cast("long"))
    return F.struct(bits(COL_SHIFT, COL_MASK).alias("local_col"), bits(ROW_SHIFT, ROW_MASK).alias("code"), _bits_float(bits(0, 0xFFFFFFFF)).alias("value"))


def is_padding(code: Column) -> Column:
    """Whether a row code marks padding."""
    return code.bitwiseAND(F.lit(PADDING_BIT).cast("long")) != 0
