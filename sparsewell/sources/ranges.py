"""Matrix files as a Spark data source that reads byte ranges.

``sparse_matrix`` reads a coordinate MatrixMarket file or a binary CSR file, or a
folder of ordered parts of one, as (row_id, col_id, value, place): many tasks
read one file, bounds on rows and columns are applied before entries
reach Spark, and binary files are read only between the pointers of the rows
asked for.  ``place`` tells the order of entries in the file.

Files are reached through Arrow's file systems: shared folders, HDFS and object stores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "row_id long, col_id long, value double, place long"
#: Bytes of a file that one task reads, and that it holds at a time.
SPLIT_BYTES, HELD_BYTES = 64 << 20, 4 << 20
MARKET, BINARY, PARQUET = "matrix_market", "binary_csr", "parquet"
#: How files of these formats begin, and bytes of the head of binary CSR, of a pointer, a column and a value.
_BANNER, _PARQUET_MAGIC = b"%%MatrixMarket", b"PAR1"
_HEAD, _PTR, _COL, _VAL = 16, 8, 4, 8
_LAST = 2**63 - 1


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def write_bytes(path: str, data: bytes) -> None:
    """Write a whole file; folders on the way are made where the store has any."""
    fs, at = _opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(data)


class Joined:
    """One file, or the parts of a folder in order of their names, as one run of bytes."""

    def __init__(self, path: str, first: bytes = b"", files: list[tuple[str, int]] | None = None):
        """``files``: the (path, size) of its parts in order, where they are known; else they are looked for, that which begins with ``first`` in front."""
        self.fs, at = _opened(path)
        if files is not None:
            self._place(files)
            return
        info = self.fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [f for f in self.fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._"]
        self._place(sorted(((f.path, f.size) for f in found if f.size), key=lambda f: (not self._begins(f[0], first), f[0]) if first else f[0]))

    def _place(self, files: list[tuple[str, int]]) -> None:
        self.files, self.starts = files, [0]
        for _, size in self.files:
            self.starts.append(self.starts[-1] + size)
        self.size = self.starts[-1]

    def _begins(self, path: str, with_: bytes) -> bool:
        with self.fs.open_input_file(path) as f:
            return f.read(len(with_)) == with_

    def read(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``."""
        out = []
        for (path, size), start in zip(self.files, self.starts, strict=False):
            if n > 0 and start <= at < start + size:
                with self.fs.open_input_file(path) as f:
                    f.seek(at - start)
                    out.append(f.read(min(n, start + size - at)))
                at, n = at + len(out[-1]), n - len(out[-1])
        return b"".join(out)

    def numbers(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.read(at, n * np.dtype(kind).itemsize), kind)


def sniff(path: str) -> str | None:
    """Format of a file or folder of parts by its bytes, whatever its name: MARKET, BINARY, PARQUET or None."""
    whole = Joined(path, _BANNER)
    head = whole.read(0, _HEAD)
    if head.startswith(_BANNER):
        return MARKET
    if whole.files and whole._begins(whole.files[0][0], _PARQUET_MAGIC):
        return PARQUET
    return BINARY if _binary_sizes(whole) else None


def _binary_sizes(whole: Joined) -> tuple[int, int, int] | None:
    """Rows, columns and entries of binary CSR; None if the head does not account for all bytes."""
    if whole.size < _HEAD:
        return None
    (m, n), (nnz,) = whole.numbers(0, 2, "<i4").tolist(), whole.numbers(8, 1, "<i8").tolist()
    return (m, n, nnz) if min(m, n, nnz) >= 0 and whole.size == _HEAD + _PTR * (m + 1) + (_COL + _VAL) * nnz else None


@dataclass
class _Range(InputPartition):
    """Bytes of a MatrixMarket body, or entries of binary CSR, from ``start`` to ``end``."""

    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.bounds = {"row_id": [-_LAST, _LAST], "col_id": [-_LAST, _LAST]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take bounds on row_id and col_id; return the rest."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in self.bounds:
                yield f
                continue
            low, high = self.bounds[name]
            if isinstance(f, EqualTo):
                self.bounds[name] = [max(low, f.value), min(high, f.value)]
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.bounds[name] = [max(low, f.value + isinstance(f, GreaterThan)), high]
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.bounds[name] = [low, min(high, f.value - isinstance(f, LessThan))]
            elif not isinstance(f, IsNotNull):  # rows and columns are never null
                yield f

    def _batch(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        (a, b), (c, d) = self.bounds["row_id"], self.bounds["col_id"]
        keep = (row >= a) & (row <= b) & (col >= c) & (col <= d)
        return pa.record_batch([pa.array(x[keep]) for x in (row, col, value, place)], names=["row_id", "col_id", "value", "place"])

    def _ranges(self, start: int, end: int, step: int) -> list[InputPartition]:
        return [_Range(at, min(at + step, end)) for at in range(start, end, step)] or [_Range(start, start)]


class MarketReader(_Reader):
    """Lines of a coordinate file that begin in a range; the place of an entry is that of its line."""

    def __init__(self, path: str, split: int):
        super().__init__(path, split)
        whole = Joined(path, _BANNER)
        at, lines = 0, []
        while not lines or lines[-1].startswith(b"%") or not lines[-1].strip():
            line = self._line(whole, at)
            if not line:
                raise ValueError("no size line")
            lines.append(line)
            at += len(line)
        banner = lines[0].lower().split()
        if len(banner) != 5 or banner[:3] != [b"%%matrixmarket", b"matrix", b"coordinate"] or banner[3] not in (b"real", b"integer", b"pattern", b"complex") or banner[4] not in (b"general", b"symmetric", b"hermitian", b"skew-symmetric"):
            raise ValueError(f"unsupported banner {lines[0]!r}")
        if len(lines[-1].split()) != 3:
            raise ValueError("no size line")
        self.body, self.size, self.files = at, whole.size, whole.files  # tasks need not look for the parts again
        self.words = {b"pattern": 2, b"complex": 4}.get(banner[3], 3)
        self.mirrored = banner[4] in (b"symmetric", b"hermitian")

    @staticmethod
    def _line(whole: Joined, at: int) -> bytes:
        out, step = b"", 256
        while b"\n" not in out and at + len(out) < whole.size:
            out += whole.read(at + len(out), step)
        return out.partition(b"\n")[0] + (b"\n" if b"\n" in out else b"")

    def partitions(self) -> list[InputPartition]:
        return self._ranges(self.body, self.size, self.split)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        whole, at = Joined(self.path, files=self.files), part.start
        if at > self.body:  # the line under way belongs to the range before
            at += len(self._line(whole, at - 1)) - 1
        rest = b""
        while at < part.end:
            chunk = whole.read(at, min(HELD_BYTES, part.end - at))
            end = at + len(chunk)
            if end >= part.end and end < self.size and not chunk.endswith(b"\n"):
                chunk += self._line(whole, end)
            lines = rest + chunk
            start = at - len(rest)
            cut = len(lines) if end >= part.end else lines.rfind(b"\n") + 1
            rest, at = lines[cut:], end
            yield from self._parsed(lines[:cut], start)

    def _parsed(self, lines: bytes, at: int) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(lines, np.uint8)
        ends = np.flatnonzero(raw == 10)
        places = at + np.concatenate([[0], ends + 1])[: len(ends) + (len(lines) > 0 and raw[-1] != 10)]
        words = lines.split()
        if b"%" in lines or len(words) != self.words * len(places):  # comments or blank lines
            kept = [(p, w) for p, line in zip(places.tolist(), lines.split(b"\n"), strict=False) if (w := line.split()) and not w[0].startswith(b"%")]
            if any(len(w) != self.words for _, w in kept):
                raise ValueError("an entry has too few or too many words")
            places, words = np.array([p for p, _ in kept], np.int64), [x for _, w in kept for x in w]
        if not words:
            return
        row, col = (np.array(words[k :: self.words]).astype(np.int64) - 1 for k in (0, 1))
        value = np.array(words[2 :: self.words]).astype(np.float64) if self.words > 2 else np.ones(len(row))
        yield self._batch(row, col, value, places)
        if self.mirrored and (off := row != col).any():
            yield self._batch(col[off], row[off], value[off], places[off])


class BinaryReader(_Reader):
    """Entries of binary CSR; of rows that are not asked for, not even the bytes are read."""

    def __init__(self, path: str, split: int):
        super().__init__(path, split)
        whole = Joined(path)
        self.files, sizes = whole.files, _binary_sizes(whole)
        if sizes is None:
            raise ValueError(f"no binary CSR in {path}")
        self.rows, self.columns, self.nnz = sizes

    def _pointer(self, whole: Joined, row: int) -> int:
        return int(whole.numbers(_HEAD + _PTR * row, 1, "<i8")[0])

    def partitions(self) -> list[InputPartition]:
        low, high = (min(max(x, 0), self.rows) for x in (self.bounds["row_id"][0], self.bounds["row_id"][1] + 1))
        whole = Joined(self.path, files=self.files)
        first, last = self._pointer(whole, low), self._pointer(whole, high) if high > low else 0
        return self._ranges(first, max(first, last), max(1, self.split // (_COL + _VAL)))

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        whole = Joined(self.path, files=self.files)
        cols_at = _HEAD + _PTR * (self.rows + 1)
        low, high = 0, self.rows
        while high - low > 1 and part.end > part.start:  # the last row that begins no later
            mid = (low + high) // 2
            low, high = (mid, high) if self._pointer(whole, mid) <= part.start else (low, mid)
        row, at, step = low, part.start, HELD_BYTES // (_COL + _VAL)
        while at < part.end:
            ptr = whole.numbers(_HEAD + _PTR * row, min(step, self.rows - row) + 1, "<i8")
            end = min(part.end, at + step, int(ptr[-1]))
            if (np.diff(ptr) < 0).any() or end < at:
                raise ValueError("pointers decrease")
            if end > at:
                span = np.arange(at, end)
                cols, values = whole.numbers(cols_at + _COL * at, end - at, "<i4"), whole.numbers(cols_at + _COL * self.nnz + _VAL * at, end - at, "<f8")
                yield self._batch(row + np.searchsorted(ptr, span, "right") - 1, cols.astype(np.int64), values.astype(np.float64), span)
            at = end
            if at < part.end:
                row += max(int(np.searchsorted(ptr, at, "right")) - 1, 0)
                if row >= self.rows:
                    raise ValueError("the last pointer is not the number of entries")


class MatrixSource(DataSource):
    """Options: path, and split (bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "sparse_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path, split = self.options["path"], int(self.options.get("split", SPLIT_BYTES))
        kind = sniff(path)
        if kind not in (MARKET, BINARY):
            raise ValueError(f"no coordinate or binary CSR matrix in {path}")
        return (MarketReader if kind == MARKET else BinaryReader)(path, split)


def matrix_entries(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """Unmerged entries (row_id, col_id, value, place) of a MatrixMarket or binary CSR file or folder of parts.

    Comparisons of row_id and col_id with constants, such as ``algebra.principal``,
    are pushed into the reader.  Complex values keep their real part, symmetric
    entries are mirrored and share the place of their line.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
    return spark.read.format(MatrixSource.name()).option("split", split).load(path)
