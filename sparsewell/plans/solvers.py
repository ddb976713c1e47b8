"""Jacobi-preconditioned conjugate gradient and Jacobi iteration.

The matrix is written once, bucketed by column, and so is the state, by index:
a product joins the two where they lie, and only sums by row move.  State is
one wide table per half of an iteration on shared storage, so a lost executor
costs its tasks only.  Scalars are observed while these tables are written; the
stop rules live in a ``Policy``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.algebra import FP64, diagonal, off_diagonal, spmv
from ..operators.validate import diagonal_violations, outside
from ..storage import discard, materialize, materialize_by
from .clock import Clock

CONVERGED, MAX_ITER, BREAKDOWN = "converged", "max_iter", "breakdown"


@dataclass(frozen=True)
class Policy:
    """What differs between the solver variants.

    ``tau`` bounds the squared residual norm.  ``tiny`` is the least size of
    p.Ap and, if ``check_rz``, of r.z; ``inf_breaks`` counts infinities as
    breakdown besides NaN; ``raises`` turns breakdown into ArithmeticError;
    ``divide`` computes z as r / d instead of r * (1 / d).  ``rz_first`` tests
    r.z before the product, so that a NaN at the start is a breakdown;
    ``recheck_rz`` tests it after the update too, where the iteration counts.
    Without ``strict_arguments`` bad arguments are a breakdown, not a ValueError.
    A diagonal entry not above ``least_diagonal`` in size is an error.  The
    direction p is brought up to date when the next iteration reads it, so
    whether a variant updates it after the last one makes no difference.
    """

    tiny: float = 1e-30
    check_rz: bool = True
    inf_breaks: bool = True
    raises: bool = False
    divide: bool = False
    auto_max: bool = True
    rz_first: bool = False
    recheck_rz: bool = False
    strict_arguments: bool = True
    least_diagonal: float = 1e-30


# The limits of p.Ap, r.z and the diagonal.
GOLDEN = Policy(tiny=2.2250738585072014e-308, least_diagonal=2.2250738585072014e-308, check_rz=False, inf_breaks=False, raises=True, divide=True)
HOST = Policy()
KERNEL = Policy(inf_breaks=False, auto_max=False, rz_first=True, strict_arguments=False)
GRAPH = Policy(inf_breaks=False, strict_arguments=False)
SPLIT = Policy(inf_breaks=False, auto_max=False, recheck_rz=True, strict_arguments=False)
EXACT = Policy(check_rz=False, raises=True, auto_max=False)


@dataclass
class Result:
    """Outcome of a solve; ``rr0`` is the squared residual norm at the start and ``trace`` has a row per iteration."""

    status: str
    iterations: int
    rr: float
    solution: DataFrame
    trace: list[tuple[int, float, float, float, float, float]]
    rr0: float = 0.0
    clock: Clock | None = None

    def trace_table(self) -> DataFrame:
        spark = self.solution.sparkSession
        return spark.createDataFrame(self.trace, "iteration int, alpha double, beta double, rz double, rr double, residual double")

    def history_table(self) -> DataFrame:
        """Squared residual norm at the start (iteration 0) and after each iteration."""
        rows = [(0, self.rr0)] + [(t[0], t[4]) for t in self.trace]
        return self.solution.sparkSession.createDataFrame(rows, "iteration int, rr double")


def _broken(value: float, policy: Policy) -> bool:
    return math.isnan(value) or (policy.inf_breaks and math.isinf(value)) or abs(value) <= policy.tiny


def _ratio(a: float, b: float) -> float:
    """a / b with the infinities and NaN of floating-point arithmetic."""
    if b:
        return a / b
    return math.nan if not a or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1.0, b)


def _observed(df: DataFrame, tag: str, buckets: int, **sums: Column) -> tuple[DataFrame, list[float]]:
    """``df`` written by idx, and sums taken while it is written (0 for an empty one)."""
    seen = Observation()
    # observed behind the shuffle, in the tasks that write
    dealt = df.repartition(buckets, "idx").observe(seen, *(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()))
    out = materialize_by(dealt, "idx", tag, buckets)
    return out, [seen.get[n] for n in sums]


def _checked(matrix: DataFrame, b: DataFrame, least: float) -> tuple[DataFrame, int]:
    """(idx, b, d) and the number of rows; ValueError for a bad diagonal or entries outside the rows of ``b``."""
    bad = sum(diagonal_violations(matrix, b, least).first())
    if bad:
        raise ValueError(f"{bad} missing or too small diagonal entries")
    if outside(matrix, b).limit(1).count():
        raise ValueError("the matrix is not square over the rows of the right-hand side")
    return b.select("idx", F.col("value").alias("b")).join(diagonal(matrix).withColumnRenamed("value", "d"), "idx", "left"), b.count()


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def true_residual(matrix: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the norm of A x - b, computed anew."""
    gap = spmv(matrix, x, b).join(b.select("idx", F.col("value").alias("b")), "idx").select((F.col("value") - F.col("b")).alias("g"))
    return gap.agg(F.sqrt(F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0.0))).alias("norm"))


def pcg(
    matrix: DataFrame,
    b: DataFrame,
    x0: DataFrame | None = None,
    tau: float = 1e-10,
    max_iters: int = 0,
    policy: Policy = HOST,
    mode: str = FP64,
    multiply: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    stored: bool = False,
    clock: Clock | None = None,
) -> Result:
    """Solve A x = b; ``b`` holds every index.  max_iters 0 means max(4 n, 1000) unless the policy takes it as it is.

    ``multiply(x, rows)`` may replace the product of the edge table with x.  The
    matrix is written once by column, so that iterations read it where it lies;
    ``stored`` says that it is such a table already.  Repeated entries of a place
    count as their sum, on the diagonal too.  ``clock`` takes the time of the
    stages setup (the matrix is written and checked), init (the first residual),
    product (A p and p.Ap, once an iteration) and update (x, r and z, once an
    iteration that does not break down).
    """
    clock = clock or Clock()
    with clock.running():
        return _pcg(matrix, b, x0, tau, max_iters, policy, mode, multiply, stored, clock)


def _pcg(matrix: DataFrame, b: DataFrame, x0: DataFrame | None, tau: float, max_iters: int, policy: Policy, mode: str, multiply: Callable[[DataFrame, DataFrame], DataFrame] | None, stored: bool, clock: Clock) -> Result:
    if tau <= 0 or max_iters < 0 or not b.limit(1).count():
        if policy.strict_arguments:
            raise ValueError("tau must be positive, max_iters not negative and b not empty")
        return Result(BREAKDOWN, 0, 0.0, b.select("idx", F.lit(0.0).alias("value")), [], clock=clock)
    buckets = _buckets(b)
    copied = not stored
    with clock.stage("setup"):
        entries = matrix.select("row_id", "col_id", "value")
        if copied:  # another product has its own table, and only the checks read this one
            matrix = materialize_by(entries, "col_id", "matrix", buckets) if multiply is None else materialize(entries, "matrix")
    multiply = multiply or (lambda x, rows: spmv(matrix, x, rows, mode))
    tables: list[DataFrame] = [matrix] if copied else []

    def forget(*old: DataFrame) -> None:
        for t in old:
            discard(t)
            tables.remove(t)

    try:
        with clock.stage("setup"):
            start, n = _checked(matrix, b, policy.least_diagonal)
        limit = max(4 * n, 1000) if policy.auto_max and max_iters == 0 else max_iters
        start = start.join(x0.select("idx", F.col("value").alias("x")), "idx", "left") if x0 is not None else start.withColumn("x", F.lit(0.0))
        with clock.stage("setup"):
            start = materialize_by(start.withColumn("x", F.coalesce("x", F.lit(0.0))), "idx", "pcg", buckets)
        tables.append(start)
        precondition = lambda r: F.col(r) / F.col("d") if policy.divide else F.col(r) * (1 / F.col("d"))
        sums = {"rz": F.col("r") * F.col("z"), "rr": F.col("r") * F.col("r")}
        rows = start.select("idx")
        ax = multiply(start.select("idx", F.col("x").alias("value")), rows)
        state = start.join(ax.withColumnRenamed("value", "ax"), "idx").withColumn("r", F.col("b") - F.col("ax")).withColumn("z", precondition("r")).withColumn("p", F.lit(0.0))
        with clock.stage("init"):
            state, (rz, rr) = _observed(state.select("idx", "d", "x", "r", "z", "p"), "pcg", buckets, **sums)
        tables.append(state)
        trace: list[tuple[int, float, float, float, float, float]] = []
        done, status, rr0, beta = 0, None, rr, None
        while done < limit and (rr > tau or policy.rz_first and math.isnan(rr)):
            if policy.rz_first and _broken(rz, policy):
                status = BREAKDOWN
                break
            # the direction of the last iteration is brought up to date as it is read
            state_now = state.withColumn("p", F.col("z") if beta is None else F.col("z") + beta * F.col("p"))
            ap = multiply(state_now.select("idx", F.col("p").alias("value")), rows).withColumnRenamed("value", "ap")
            with clock.stage("product"):
                with_ap, (pap,) = _observed(state_now.join(ap, "idx"), "pcg", buckets, pap=F.col("p") * F.col("ap"))
            tables.append(with_ap)
            forget(state)
            state = with_ap
            if _broken(pap, policy) or policy.check_rz and _broken(rz, policy):
                status = BREAKDOWN
                if policy.raises:
                    raise ArithmeticError(f"breakdown in iteration {done + 1}: p.Ap = {pap}")
                break
            alpha = _ratio(rz, pap)
            stepped = with_ap.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ap")).withColumn("z", precondition("r"))
            with clock.stage("update"):
                state, (new_rz, rr) = _observed(stepped.select("idx", "d", "x", "r", "z", "p"), "pcg", buckets, **sums)
            tables.append(state)
            forget(with_ap)
            beta = _ratio(new_rz, rz)
            done += 1
            trace.append((done, alpha, beta, new_rz, rr, math.sqrt(rr) if rr >= 0 else math.nan))
            rz = new_rz
            if policy.recheck_rz and not rr <= tau and _broken(new_rz, policy):
                status = BREAKDOWN
                break
        tables.remove(state)  # the solution reads it
        return Result(status or (CONVERGED if rr <= tau else MAX_ITER), done, rr, state.select("idx", F.col("x").alias("value")), trace, rr0, clock)
    finally:
        forget(*list(tables))


def jacobi(matrix: DataFrame, b: DataFrame, iterations: int, stored: bool = False) -> tuple[DataFrame, float]:
    """A fixed number of Jacobi steps from x = 0: (solution, largest change of the last step).  ``stored`` as in ``pcg``.

    Raises ValueError for a negative number of steps, an empty ``b``, a missing or
    zero diagonal entry and a matrix with entries outside the rows of ``b``.
    """
    if iterations < 0 or not b.limit(1).count():
        raise ValueError("iterations must not be negative and b not empty")
    buckets = _buckets(b)
    matrix = matrix if stored else materialize_by(matrix.select("row_id", "col_id", "value"), "col_id", "matrix", buckets)
    tables: list[DataFrame] = [] if stored else [matrix]
    try:
        rest = off_diagonal(matrix)
        fixed, _ = _checked(matrix, b, 0.0)
        state, change = materialize_by(fixed.withColumn("x", F.lit(0.0)), "idx", "jacobi", buckets), 0.0
        tables.append(state)
        for _ in range(iterations):
            rx = spmv(rest, state.select("idx", F.col("x").alias("value")), state.select("idx")).withColumnRenamed("value", "rx")
            stepped = state.join(rx, "idx").withColumn("new", (F.col("b") - F.col("rx")) * (1 / F.col("d")))
            seen = Observation()
            stepped = stepped.repartition(buckets, "idx").observe(seen, F.coalesce(F.max(F.abs(F.col("new") - F.col("x"))), F.lit(0.0)).alias("change"))
            new = materialize_by(stepped.select("idx", "b", "d", F.col("new").alias("x")), "idx", "jacobi", buckets)
            tables.append(new)
            change = seen.get["change"]
            discard(state)
            tables.remove(state)
            state = new
        tables.remove(state)  # the solution reads it
        return state.select("idx", F.col("x").alias("value")), change
    finally:
        for t in tables:
            discard(t)
