"""Reports of solver runs: one nested row, as JSON or as tagged text lines, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import gflops
from .solvers import CONVERGED, Result

#: The report's schema; ``config`` and ``errors`` are free of form.
REPORT = """config map<string,string>, dataset struct<n:bigint,nnz:bigint>,
  result struct<status:string,converged:boolean,iterations:bigint,initial_rr:double,final_rr:double,residual_norm:double,residual_rel:double>,
  errors map<string,double>, timing array<struct<stage:string,calls:bigint,seconds:double,mean:double>>, wall_seconds double, product_gflops double,
  trace array<struct<iteration:int,alpha:double,beta:double,rz:double,rr:double,residual:double>>"""


def run_report(result: Result, matrix: DataFrame, b: DataFrame, config: dict[str, object], errors: dict[str, float] | None = None) -> DataFrame:
    """One row (``REPORT``) of a finished solve: sizes, outcome, errors, times by stage with the throughput of products, and a row per iteration.

    ``errors`` holds what the caller has compared, such as the largest difference
    from another solution.  The trace has a row per iteration and is bounded by
    the iterations that the driver has run.
    """
    spark, clock = matrix.sparkSession, result.clock
    size = matrix.agg(F.count("*").alias("nnz"))
    norms = b.agg(F.count("*").alias("n"), F.sqrt(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).alias("b_norm"))
    rows = clock.rows() if clock else []
    product = next((r for r in rows if r[0] == "product"), ("product", 0, 0.0, 0.0))
    given = spark.createDataFrame(
        [({k: str(v) for k, v in config.items()}, result.status, result.status == CONVERGED, result.iterations, result.rr0, result.rr, {k: float(v) for k, v in (errors or {}).items()}, rows, clock.wall if clock else 0.0, product[1], product[2], result.trace)],
        "config map<string,string>, status string, converged boolean, iterations bigint, rr0 double, rr double, errors map<string,double>, timing array<struct<stage:string,calls:bigint,seconds:double,mean:double>>, wall double, calls bigint, seconds double, trace array<struct<iteration:int,alpha:double,beta:double,rz:double,rr:double,residual:double>>",
    )
    # three single rows
    one = given.crossJoin(size).crossJoin(norms)
    norm = F.sqrt(F.greatest(F.col("rr"), F.lit(0.0)))
    outcome = F.struct("status", "converged", "iterations", F.col("rr0").alias("initial_rr"), F.col("rr").alias("final_rr"), norm.alias("residual_norm"), F.when(F.col("b_norm") > 0, norm / F.col("b_norm")).otherwise(norm).alias("residual_rel"))
    return one.select("config", F.struct("n", "nnz").alias("dataset"), outcome.alias("result"), "errors", "timing", F.col("wall").alias("wall_seconds"), gflops(F.col("nnz"), F.col("calls"), F.col("seconds") * 1000).alias("product_gflops"), "trace")


def as_json(report: DataFrame) -> DataFrame:
    """(report) JSON text of each report."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def from_json(texts: DataFrame) -> DataFrame:
    """Reports of JSON texts (report); a text that is none gives nulls."""
    return texts.select(F.from_json("report", REPORT).alias("r")).select("r.*")


def _line(tag: str, fields: dict[str, Column]) -> Column:
    shown = [F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("none"))) for k, c in fields.items()]
    return F.concat(F.lit(f"[{tag}] "), F.concat_ws(" ", *shown))


def as_lines(report: DataFrame) -> DataFrame:
    """(at, value): lines ``[tag] key=value ...`` of each report in order, which ``files.report_records`` reads back."""
    pairs = lambda tag, name: F.transform(F.map_entries(name), lambda e: F.concat(F.lit(f"[{tag}] "), e.key, F.lit("="), F.regexp_replace(e.value.cast("string"), r"\s", "_")))
    stages = F.transform("timing", lambda t: _line("stage", {k: t[k] for k in ("stage", "calls", "seconds", "mean")}))
    steps = F.transform("trace", lambda t: _line("iteration", {k: t[k] for k in ("iteration", "alpha", "beta", "rz", "rr", "residual")}))
    fields = {k: F.col(f"result.{k}") for k in ("status", "converged", "iterations", "initial_rr", "final_rr", "residual_norm", "residual_rel")}
    total = _line("total", {"wall_seconds": F.col("wall_seconds"), "product_gflops": F.col("product_gflops")})
    lines = F.flatten(F.array(pairs("config", "config"), F.array(_line("dataset", {"n": F.col("dataset.n"), "nnz": F.col("dataset.nnz")}), _line("result", fields)), pairs("error", "errors"), stages, F.array(total), steps))
    return report.select(F.posexplode(lines).alias("at", "value"))
