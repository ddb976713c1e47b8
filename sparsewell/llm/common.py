"""Helpers shared by the training-data operators.

Nothing here is specific to one operator: written intermediate tables (those of
the library), and Arrow batch limits that keep Python workers small.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..storage import discard, materialize, new_path, shared_dir

__all__ = ["DOCUMENT_COLUMNS", "bounded_batches", "discard", "materialize", "new_path", "shared_dir", "sorted_groups", "tokenizer_path"]

#: Columns of the ``documents`` table; every filtering stage returns exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Upper bounds of one Arrow batch handed to a Python worker, so that a run of
#: very long texts never has to fit into memory together.
ARROW_BATCH_BYTES = 16 * 1024 * 1024
ARROW_BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Bound rows and bytes of an Arrow batch unless the session already has smaller bounds.

    The bounds stay set in the session: plans are lazy and read them when they run.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)):
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: the installed package, or SPARSEWELL_TOKENIZERS."""
    base = os.environ.get("SPARSEWELL_TOKENIZERS")
    if base:
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal values in the first ``n_keys`` columns of sorted rows, over batch borders."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), n]
        for start, end in zip(bounds, bounds[1:], strict=False):
            key = tuple(k[start] for k in keys)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(b.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)
