"""Packing of token streams into fixed windows: concatenate and cut.

Pass 1 encodes every document and writes its ids with the number of ids before
it in its task's share.  The shares' totals give, by a prefix sum over shares,
each share's offset in the whole stream.  Pass 2 adds the two and cuts every
document at multiples of the window; a document that reaches over a boundary
leaves one piece on either side.  Only the totals, one row per task of pass 1,
are ever gathered in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, tokenizer_path
from .tokens import encoder

WINDOW = 1024
END_ID = 0


def encode_shares(docs: DataFrame, vocab_path: str, end_id: int = END_ID) -> DataFrame:
    """Pass 1: doc_id, ids (packed, closed by ``end_id``), share (task) and before (ids earlier in the share)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_path, True).encode_column
        share, before = TaskContext.get().partitionId(), 0
        end = pa.scalar(np.array([end_id], "<u4").tobytes(), pa.binary())
        for b in batches:
            ids = pc.binary_join_element_wise(encode(b.column(1)), end, pa.scalar(b"", pa.binary()))
            bounds = before + np.cumsum([0, *(pc.binary_length(ids).to_numpy() // 4)], dtype=np.int64)
            before = int(bounds[-1])
            yield pa.record_batch([b.column(0), ids, pa.array(np.full(len(ids), share, np.int64)), pa.array(bounds[:-1])], names=["doc_id", "ids", "share", "before"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids binary, share long, before long")


def cut_pieces(encoded: DataFrame, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pass 2 over a written ``encode_shares`` table: pieces, with their ids unless ``with_ids`` is off."""
    total = encoded.groupBy("share").agg(F.max(F.col("before") + F.length("ids") / 4).cast("long").alias("total"))
    # one row per task of pass 1, whatever the number of documents
    first = total.select("share", (F.sum("total").over(Window.orderBy("share")) - F.col("total")).alias("offset"))
    placed = encoded.join(F.broadcast(first), "share").select("doc_id", "ids", (F.col("before") + F.col("offset")).alias("at"))
    bounded_batches(encoded.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            pieces = []
            for doc, ids, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, start = len(ids) // 4, 0
                view = memoryview(ids)
                while start < n:
                    here = at + start
                    size = min(n - start, window - here % window)
                    piece = view[4 * start : 4 * (start + size)]
                    for col, value in zip(cols, (doc, start, size, zlib.crc32(piece), n, here // window, here % window), strict=True):
                        col.append(value)
                    if with_ids:
                        pieces.append(bytes(piece))
                    start += size
            arrays = [*(pa.array(c, pa.int64()) for c in cols), *([pa.array(pieces, pa.binary())] if with_ids else [])]
            yield pa.record_batch(arrays, names=names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocab_path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of ``window`` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (packed little-endian unsigned 32-bit).  All
    sequences but the last are full, so only the last one needs padding.  Null
    and empty texts are one ``end_id``; a null id stays null; repeated rows are
    packed each on its own; texts of any length are packed whole; other columns
    are ignored; an empty table gives no pieces.
    """
    path = vocab_path or tokenizer_path("byte_bpe_50k.json")
    return cut_pieces(materialize(encode_shares(docs, path, end_id), "packing"), window, with_ids)


def packed_digests(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """``pack_documents`` without the ids themselves."""
    return pack_documents(docs, vocab_path, with_ids=False)
