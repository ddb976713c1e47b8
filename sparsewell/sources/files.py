"""Matrix files: MatrixMarket coordinate text, text CSR folders, binary CSR, Parquet."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.algebra import COLUMN_BLOCK, expand_symmetric, merge_duplicates, pointers, spmv, with_positions
from ..operators.validate import pointer_violations, require_clean, row_steps
from ..storage import discard, materialize, shuffles_go
from .ranges import BINARY, MARKET, PARQUET, matrix_entries, sniff, write_bytes

#: Numbers of one part of a binary file.
PART_NUMBERS = 1 << 20


def _market_parts(spark: SparkSession, path: str) -> tuple[list[str], list[str], DataFrame]:
    """Words of the banner, words of the size line, and the split entry lines (p, at) of a MatrixMarket file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    if head is None:
        raise ValueError("no MatrixMarket banner")
    parts = F.split(F.trim("value"), r"\s+")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(parts.alias("p"), "file", "at")
    first = body.where(F.col("file") == head.file).orderBy("at").first()  # the size line follows the banner
    if first is None:
        raise ValueError("no size line")
    return head[0].lower().split(), list(first.p), body.where(F.col("at") != first.at).select("p", "at")


def read_matrix_market(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    """Coordinate matrix as an edge table.

    Indices become 0-based, pattern entries 1.0, symmetric and hermitian ones are
    mirrored, complex ones keep their real part.  ``merged`` sums repeated
    entries and drops zeros.
    """
    banner, size, body = _market_parts(spark, path)
    _, kind, storage, field, symmetry = banner
    if kind != "matrix" or storage != "coordinate" or field not in ("real", "integer", "pattern", "complex"):
        raise ValueError(f"unsupported banner {' '.join(banner)}")
    if len(size) != 3:
        raise ValueError("no size line")
    value = F.lit(1.0) if field == "pattern" else F.col("p")[2].cast("double")
    out = body.select((F.col("p")[0].cast("long") - 1).alias("row_id"), (F.col("p")[1].cast("long") - 1).alias("col_id"), value.alias("value"))
    out = expand_symmetric(out) if symmetry in ("symmetric", "hermitian") else out
    return merge_duplicates(out) if merged else out


def read_matrix_market_vector(spark: SparkSession, path: str) -> DataFrame:
    """First column of a matrix file as a dense vector (idx, value).

    Coordinate storage leaves 0.0 where there is no entry; of repeated entries the last counts.
    """
    banner, size, body = _market_parts(spark, path)
    if banner[1] != "matrix" or banner[3] not in ("real", "integer"):
        raise ValueError(f"unsupported banner {' '.join(banner)}")
    n = int(size[0])
    if banner[2] == "array":  # the two sizes stand in front of the values
        numbers = read_numbers(spark, path, comment="%")
        return numbers.where((F.col("pos") >= 2) & (F.col("pos") < n + 2)).select((F.col("pos") - 2).alias("idx"), "value")
    entries = body.where(F.col("p")[1].cast("long") == 1).groupBy((F.col("p")[0].cast("long") - 1).alias("idx")).agg(F.max_by(F.col("p")[2].cast("double"), "at").alias("value"))
    return spark.range(n).withColumnRenamed("id", "idx").join(entries, "idx", "left").select("idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def write_matrix_market_vector(vector: DataFrame, path: str) -> None:
    """Parts of an array file with one column: banner and sizes first, then the values in order of idx."""
    head = vector.agg(F.count("*").alias("n")).select(F.concat(F.lit("%%MatrixMarket matrix array real general\n"), F.col("n").cast("string"), F.lit(" 1")).alias("value"))
    body = vector.select("idx", F.format_string("%.17g", "value").alias("value"))
    head.select(F.lit(-1).cast("long").alias("idx"), "value").unionAll(body).orderBy("idx").select("value").write.text(path)


def write_matrix_market(matrix: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Parts of a coordinate file: the banner in its own part, then the entries.  The matrix is read twice, to count and to write it."""
    head = matrix.agg(F.count("*").alias("n")).select(F.concat(F.lit(f"%%MatrixMarket matrix coordinate real general\n{n_rows} {n_cols} "), F.col("n").cast("string")).alias("value"))
    head.write.text(path)
    places = matrix.select((F.col("row_id") + 1).alias("r"), (F.col("col_id") + 1).alias("c"), "value")
    places.select(F.concat_ws(" ", _word("r", "bigint"), _word("c", "bigint"), _word("value", "double")).alias("value")).write.mode("append").text(path)


def words_of(line: str) -> Column:
    """Array of the words of a line; most lines are one word, which needs no splitting."""
    many = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    return F.when(F.col(line).rlike(r"\s"), many).when(F.col(line) != "", F.array(line)).otherwise(F.array().cast("array<string>"))


def read_numbers(spark: SparkSession, path: str, kind: str = "double", comment: str | None = None) -> DataFrame:
    """(pos, value) of a whitespace-separated number file or folder of parts; an empty one is an error.

    The words are written once, numbered as their task reads them; the position
    of a word is its number inside its file split behind the words of the splits
    before.  No words are shuffled or sorted.
    """
    lines = spark.read.text(path).select(words_of("value").alias("a"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(~F.coalesce(F.get("a", F.lit(0)), F.lit("")).startswith(comment)) if comment else lines
    each = lines.select("file", "block", F.explode("a").alias("value"))
    numbers = materialize(each.select("file", "block", F.monotonically_increasing_id().alias("at"), F.col("value").cast(kind).alias("value")), "numbers")
    totals = numbers.groupBy("file", "block").agg(F.count("*").alias("total"), F.min("at").alias("first"))
    # one row per file split
    before = totals.select("file", "block", (F.sum("total").over(Window.orderBy("file", "block")) - F.col("total") - F.col("first")).alias("before"))
    if numbers.limit(1).count() == 0:
        raise ValueError(f"empty number file {path}")
    return numbers.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("at")).cast("long").alias("pos"), "value")


def _word(value: str, kind: str) -> Column:
    """A number as text: the shortest that reads back as the same."""
    return F.coalesce(F.col(value).cast("string" if kind in ("int", "bigint", "double") else "double").cast("string"), F.lit("null"))


def write_numbers(numbers: DataFrame, path: str) -> None:
    """Write (pos, value) as ordered text parts, one number per line."""
    numbers.orderBy("pos").select(_word("value", dict(numbers.dtypes)["value"]).alias("value")).write.text(path)


def read_csr_folder(spark: SparkSession, folder: str, n_cols: int | None = None) -> DataFrame:
    """Edge table of row_ptr.txt, col_idx.txt and values.txt.

    Raises ValueError if the files do not agree: pointers that do not start at 0,
    decrease or do not end at the number of entries, unequal numbers of columns
    and values, or columns outside 0..n_cols-1 (a square matrix unless
    ``n_cols`` is given).
    """
    ptr = read_numbers(spark, f"{folder}/row_ptr.txt", "long").withColumnRenamed("value", "ptr")
    # a row of any length is cut into pieces, which are dealt over tasks
    pieces = row_steps(ptr).where("end > begin").select("row_id", "end", F.explode(F.sequence(F.col("begin"), F.col("end") - 1, F.lit(COLUMN_BLOCK))).alias("at")).repartition("row_id", "at")
    rows = pieces.select("row_id", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + COLUMN_BLOCK, "end") - 1)).alias("pos"))
    cols = read_numbers(spark, f"{folder}/col_idx.txt", "long").withColumnRenamed("value", "col_id")
    values = read_numbers(spark, f"{folder}/values.txt")
    n = n_cols if n_cols is not None else ptr.count() - 1
    broken = pointer_violations(ptr, cols, n).crossJoin(cols.agg(F.count_if(F.col("col_id").isNull()).alias("null_columns"), F.count("*").alias("_n")))
    sizes = values.agg(F.count_if(F.col("value").isNull()).alias("null_values"), F.count("*").alias("_m"))
    require_clean(broken.crossJoin(sizes).withColumn("unequal_lengths", F.abs(F.col("_n") - F.col("_m"))).drop("_n", "_m"))
    # rows are as many as entries, which their estimate before they are cut does not show: never broadcast
    return rows.hint("merge").join(cols.hint("merge"), "pos").join(values.hint("merge"), "pos").select("row_id", "col_id", "value")


def read_csr_vector(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """Vector (idx, value) of ``name``.txt in a CSR folder, such as b or x0; None if there is no such file.

    Raises ValueError unless it has one number for each row of the matrix.
    """
    path = f"{folder}/{name}.txt"
    if not _exists(spark, path):
        return None
    vector = read_numbers(spark, path).select(F.col("pos").alias("idx"), "value")
    n, have = read_numbers(spark, f"{folder}/row_ptr.txt", "long").count() - 1, vector.count()
    if have != n:
        raise ValueError(f"{name}.txt has {have} numbers for {n} rows")
    return vector


def read_rhs(spark: SparkSession, folder: str, matrix: DataFrame) -> DataFrame:
    """b of a CSR folder, or A times ones if there is no b.txt."""
    b = read_csr_vector(spark, folder, "b")
    if b is not None:
        return b
    rows = read_numbers(spark, f"{folder}/row_ptr.txt", "long").count() - 1
    ones = matrix.select(F.col("col_id").alias("idx")).distinct().withColumn("value", F.lit(1.0))
    return spmv(matrix, ones, spark.range(rows).withColumnRenamed("id", "idx"))


def read_csr_dataset(spark: SparkSession, folder: str, narrow: bool = False) -> DataFrame:
    """``read_csr_folder`` with the number of columns of ``n=`` in meta.txt, if it is there; ``narrow`` rounds values to single precision."""
    n = _read_if_there(spark, f"{folder}/meta.txt").get("n")
    matrix = read_csr_folder(spark, folder, int(n) if n else None)
    return matrix.withColumn("value", F.col("value").cast("float").cast("double")) if narrow else matrix


def read_csr_system(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Matrix, right-hand side b and start x0 of a CSR folder; a vector without a file is None."""
    return read_csr_folder(spark, folder), read_csr_vector(spark, folder, "b"), read_csr_vector(spark, folder, "x0")


def write_csr_folder(matrix: DataFrame, rows: DataFrame, folder: str, stored: bool = False) -> None:
    """Write the three number files in CSR order, each as a folder of ordered parts.

    The matrix is computed once, unless it is ``stored`` already, and sorted once;
    both files of its entries are written from the sorted copy on disk.
    """
    entries = matrix.select("row_id", "col_id", "value")
    copied = None if stored else materialize(entries, "csr-entries")
    entries = entries if stored else copied
    ptr = materialize(pointers(entries, rows), "csr-pointers")
    last = ptr.agg((F.max("row_id") + 1).alias("pos"), F.max("end").alias("value"))
    write_numbers(ptr.select(F.col("row_id").alias("pos"), F.col("begin").alias("value")).unionAll(last), f"{folder}/row_ptr.txt")
    known = entries
    if (last.first().value or 0) != entries.count():  # rows that are not asked for
        known = entries.join(ptr.select("row_id"), "row_id", "left_semi")
    kinds = dict(entries.dtypes)
    ordered = known.orderBy("row_id", "col_id", "value").select("col_id", "value").persist(StorageLevel.DISK_ONLY)
    try:
        for name, column in (("col_idx", "col_id"), ("values", "value")):
            ordered.select(_word(column, kinds[column]).alias("value")).write.text(f"{folder}/{name}.txt")
    finally:
        ordered.unpersist(True)
        discard(copied)
        discard(ptr)


def encode_binary_csr(ptr: np.ndarray, cols: np.ndarray, values: np.ndarray, n_cols: int) -> bytes:
    """A small matrix as one binary CSR file: int32 rows, int32 columns, int64 entries, int64 pointers, int32 columns, float64 values."""
    return struct.pack("<iiq", len(ptr) - 1, n_cols, len(cols)) + ptr.astype("<i8").tobytes() + cols.astype("<i4").tobytes() + values.astype("<f8").tobytes()


def write_binary_csr(matrix: DataFrame, n_rows: int, n_cols: int, path: str) -> None:
    """Write a matrix as binary CSR, a folder of ordered parts: head, pointers, columns, values.

    The places of entries are prefix sums over blocks of rows and columns, so every
    part follows from its places alone: tasks write parts of a fixed number of
    rows or entries, a lost task writes the same bytes again, and nothing passes
    through the driver.  Repeated entries stay, in order of their values.
    """
    spark = matrix.sparkSession
    entries = materialize(matrix.select("row_id", "col_id", F.col("value").cast("double").alias("value")), "binary-csr")
    ptr = pointers(entries, spark.range(n_rows).withColumnRenamed("id", "idx"))
    ptr = materialize(ptr.select(F.col("row_id").alias("pos"), F.col("end").alias("value")), "binary-csr-pointers")
    size = entries.agg(F.count("*").alias("nnz"), F.count_if((F.col("row_id") < 0) | (F.col("row_id") >= n_rows) | (F.col("col_id") < 0) | (F.col("col_id") >= n_cols)).alias("outside")).first()
    if size.outside or max(n_rows, n_cols) >= 1 << 31:
        raise ValueError(f"{size.outside} entries outside {n_rows} rows and {n_cols} columns")
    inside = with_positions(entries, ["row_id"], F.floor(F.col("col_id") / COLUMN_BLOCK), ["col_id", "value"], "inside")
    begin = ptr.select((F.col("pos") + 1).alias("row_id"), F.col("value").alias("begin"))
    placed = inside.join(begin, "row_id", "left").select((F.coalesce("begin", F.lit(0)) + F.col("inside")).alias("pos"), "col_id", "value")
    head = struct.pack("<iiq", n_rows, n_cols, size.nnz) + bytes(8)  # the first pointer is 0

    def parts(name: str, fields: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held = None, []

            def write() -> pa.RecordBatch:
                for k, (field, kind) in enumerate(fields.items()):
                    write_bytes(f"{path}/{name}{field}-{block:012d}", np.concatenate([h[k] for h in held]).astype(kind).tobytes())
                return pa.record_batch([pa.array([block], pa.int64())], names=["block"])

            for b in batches:
                blocks = b.column(0).to_numpy()
                change = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
                for start, end in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
                    if start < end:
                        if held and block != blocks[start]:
                            yield write()
                            held = []
                        block = int(blocks[start])
                        held.append([b.column(2 + k).to_numpy(zero_copy_only=False)[start:end] for k in range(len(fields))])
            if held:
                yield write()

        return run

    write_bytes(f"{path}/0-head", head)
    for table, name, fields in ((ptr, "1-", {"value": "<i8"}), (placed, "2-", {"col_id": "<i4", "value": "<f8"})):
        blocked = table.select(F.floor(F.col("pos") / PART_NUMBERS).alias("block"), "pos", *fields)
        blocked.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(parts(name, fields), "block long").agg(F.count("*")).collect()
    discard(entries)
    discard(ptr)


def read_binary_csr(spark: SparkSession, path: str) -> DataFrame:
    """Edge table of a binary CSR file or folder of parts; see ``ranges``."""
    return matrix_entries(spark, path).select("row_id", "col_id", "value")


def metadata_pairs(lines: DataFrame) -> DataFrame:
    """(key, value) of key=value lines (value); other lines are left out."""
    parts = F.split("value", "=", 2)
    return lines.where(F.col("value").contains("=")).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def read_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines of a small metadata file."""
    return {r.key: r.value for r in metadata_pairs(spark.read.text(path)).collect()}


def write_metadata(spark: SparkSession, pairs: dict[str, object], path: str) -> None:
    """Write key=value lines in one part."""
    spark.createDataFrame([(f"{k}={v}",) for k, v in pairs.items()], "value string").coalesce(1).write.text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def _read_if_there(spark: SparkSession, path: str) -> dict[str, str]:
    return read_metadata(spark, path) if _exists(spark, path) else {}


def is_csr_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds the three files of a CSR matrix."""
    return all(_exists(spark, f"{path}/{name}.txt") for name in ("row_ptr", "col_idx", "values"))


def select_datasets(asked: Iterable[str], known: dict[str, int], default: str) -> list[tuple[str, int]]:
    """(name, rows) of the data sets asked for.

    Items may be comma-separated.  ``all`` alone means every known name;
    ``name_nK`` is the leading K rows and columns of a known data set; nothing
    asked for means ``default``.  Raises ValueError for unknown names and for K
    beyond the data set.
    """
    names = [x.strip() for item in asked for x in item.split(",") if x.strip()] or [default]
    if names == ["all"]:
        return list(known.items())
    out, unknown = [], []
    for name in names:
        base, _, part = name.rpartition("_n")
        if name in known:
            out.append((name, known[name]))
        elif base in known and part.isdecimal():
            if not 0 < int(part) <= known[base]:
                raise ValueError(f"{name}: the size must be 1 to {known[base]}")
            out.append((name, int(part)))
        else:
            unknown.append(name)
    if unknown:
        raise ValueError(f"unknown data sets: {', '.join(sorted(set(unknown)))}")
    return out


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Reader by what is there, whatever its name: a CSR folder, or by their first bytes MatrixMarket, binary CSR or Parquet; ValueError for anything else."""
    if is_csr_folder(spark, path):
        return read_csr_dataset(spark, path)
    kind = sniff(path) if _exists(spark, path) else None
    readers = {MARKET: read_matrix_market, BINARY: read_binary_csr, PARQUET: lambda s, p: s.read.parquet(p)}
    if kind is None:
        raise ValueError(f"no matrix in {path}")
    return readers[kind](spark, path)


def read_through(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The matrix of ``path`` from its Parquet copy ``cache``, which the first call writes."""
    if not _exists(spark, f"{cache}/_SUCCESS"):
        with shuffles_go(spark):
            load_matrix(spark, path).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def inferred_size(matrix: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, nnz and square of a matrix without metadata."""
    size = matrix.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("n_rows"), F.coalesce(F.max("col_id") + 1, F.lit(0)).alias("n_cols"), F.count("*").alias("nnz"))
    return size.withColumn("square", F.col("n_rows") == F.col("n_cols"))


def report_records(lines: DataFrame) -> DataFrame:
    """(tag, key, value) of report lines such as ``[tag] key=value key=value``."""
    tagged = lines.select(F.regexp_extract("value", r"^\[([^\]]+)\]", 1).alias("tag"), F.explode(F.regexp_extract_all("value", F.lit(r"(\w+=[^\s]+)"), F.lit(1))).alias("kv"))
    return tagged.select("tag", F.split("kv", "=", 2)[0].alias("key"), F.split("kv", "=", 2)[1].alias("value"))
