"""Stage times add up to the wall time; reports go to JSON and text and back."""

import json

import pytest

from sparsewell import storage
from sparsewell.plans import report, solvers
from sparsewell.plans.clock import Clock
from sparsewell.sources import files


def test_clock_adds_up():
    at = iter([0.0, 1.0, 3.0, 4.0, 9.0, 10.0])
    clock = Clock(lambda: next(at))
    with clock.running():
        with clock.stage("a"):
            pass
        with clock.stage("a"):
            pass
    assert clock.rows() == [("a", 2, 7.0, 3.5), ("other", 1, 3.0, 3.0)] and clock.wall == 10.0 and clock.calls("b") == 0


@pytest.fixture(scope="module")
def solved(spark):
    a = spark.createDataFrame([(i, j, 3.0 if i == j else -1.0) for i in range(12) for j in (i - 1, i, i + 1) if 0 <= j < 12], "row_id long, col_id long, value double")
    b = spark.createDataFrame([(i, float(i)) for i in range(12)], "idx long, value double")
    return a, b, solvers.pcg(a, b)


def test_calls_follow_the_iterations(solved):
    _, _, result = solved
    calls = {stage: n for stage, n, _, _ in result.clock.rows()}
    assert calls == {"setup": 3, "init": 1, "product": result.iterations, "update": result.iterations, "other": 1}
    assert abs(sum(r[2] for r in result.clock.rows()) - result.clock.wall) < 1e-6


def test_breakdown_has_no_update(spark):
    a = spark.createDataFrame([(i, j, 1.0) for i in range(2) for j in range(2)], "row_id long, col_id long, value double")
    b = spark.createDataFrame([(0, 1.0), (1, -1.0)], "idx long, value double")
    result = solvers.pcg(a, b)
    assert (result.status, result.clock.calls("product"), result.clock.calls("update")) == ("breakdown", 1, 0)


def test_report_round_trip(spark, solved):
    a, b, result = solved
    made = report.run_report(result, a, b, {"tau": 1e-10, "note": "two words"}, {"max_abs_diff": 0.25})
    text = report.as_json(made).first().report
    raw = json.loads(text)
    assert raw["dataset"] == {"n": 12, "nnz": 34} and raw["errors"] == {"max_abs_diff": 0.25} and len(raw["trace"]) == result.iterations
    assert raw["result"]["status"] == "converged" and raw["result"]["final_rr"] == result.rr
    back = report.from_json(spark.createDataFrame([(text,)], "report string")).first()
    assert back == made.first()
    assert [tuple(t) for t in back.trace] == result.trace
    lines = [r.value for r in report.as_lines(made).orderBy("at").collect()]
    assert lines[0].startswith("[config] ") and lines[-1].startswith(f"[iteration] iteration={result.iterations} ")
    records = files.report_records(spark.createDataFrame([(x,) for x in lines], "value string"))
    found = {(r.tag, r.key): r.value for r in records.where("tag in ('result', 'config', 'error', 'dataset')").collect()}
    assert found["result", "iterations"] == str(result.iterations) and float(found["result", "final_rr"]) == result.rr
    assert found["config", "note"] == "two_words" and found["error", "max_abs_diff"] == "0.25" and found["dataset", "nnz"] == "34"


def test_report_of_a_run_without_iterations(spark, solved):
    a, b, _ = solved
    stopped = solvers.pcg(a, b, tau=-1.0, policy=solvers.KERNEL)
    row = report.run_report(stopped, a, b, {}).first()
    assert (row.result.status, row.result.converged, row.trace, row.product_gflops) == ("breakdown", False, [], 0.0)


def test_tables_of_other_applications_stay(spark, monkeypatch):
    df = spark.range(5).withColumnRenamed("id", "idx")
    mine = storage.materialize_by(df, "idx", "t", 2)
    monkeypatch.setattr(storage, "_prefix", lambda s: "sparsewell_tmp_other_app__")
    other = storage.materialize_by(df, "idx", "t", 2)
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("sparsewell_tmp_")}
    monkeypatch.undo()
    assert mine._sparsewell_table in names() and other._sparsewell_table in names()
    storage.discard_all(spark)
    assert mine._sparsewell_table not in names() and other._sparsewell_table in names()
    spark.sql(f"DROP TABLE {other._sparsewell_table}")


def test_prefixes_differ_by_application(spark):
    class Other:
        class sparkContext:  # noqa: N801
            applicationId = "application_17_0001"

    assert storage._prefix(Other) == "sparsewell_tmp_application_17_0001__" != storage._prefix(spark)
