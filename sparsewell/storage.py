"""Written intermediate tables on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _prefix(spark: SparkSession) -> str:
    """Beginning of the names of this application's tables: a metastore may be shared with others."""
    return "sparsewell_tmp_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId.lower()) + "__"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only local sessions without it get a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def run_folder(spark: SparkSession) -> str:
    """Folder of all intermediate tables of this application."""
    return f"{shared_dir(spark)}/sparsewell/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with it; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and return the table read back; cuts the lineage.

    Any executor can read the files again, so a lost executor costs its running tasks only.
    """
    path = new_path(df.sparkSession, tag)
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparsewell_path = path
    return out


def materialize_by(df: DataFrame, key: str, tag: str, buckets: int) -> DataFrame:
    """``materialize`` as a table bucketed by ``key``: joins and sums over that key read it where it lies.

    The catalog entry and the files go with ``discard``.
    """
    spark = df.sparkSession
    path, name = new_path(spark, tag), f"{_prefix(spark)}{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # nothing moves if ``df`` lies that way already
    with shuffles_go(spark):
        dealt.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out._sparsewell_path, out._sparsewell_table = path, name
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table made by ``materialize`` or ``materialize_by`` once nothing reads it any more."""
    path = getattr(df, "_sparsewell_path", None)
    if path:
        spark = df.sparkSession
        if name := getattr(df, "_sparsewell_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, path)


def discard_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application.

    Results are lazy and read these tables, so whoever owns the session calls
    this once the results are written.
    """
    for table in spark.catalog.listTables(pattern=f"{_prefix(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    _delete(spark, run_folder(spark))
