import numpy as np
import pytest

from holdfast.functions import distributions as D
from holdfast.operators import profiling
from tests.conftest import as_set


@pytest.fixture
def numbers(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=400), np.full(250, 3.0), rng.integers(0, 9, 100)])
    rng.shuffle(values)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    return frame.repartition(5), values


@pytest.mark.parametrize("method, numpy_method", [("linear", "linear"), ("midpoint", "hazen")])
def test_quantiles(numbers, method, numpy_method):
    frame, values = numbers
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.77, "high": 1.0}
    counts = D.value_counts(frame, ["x"])
    row = D.quantiles(counts, ["column"], shares, method).first()
    for name, share in shares.items():
        assert row[name] == pytest.approx(np.quantile(values, share, method=numpy_method))


def test_unknown_method(numbers):
    with pytest.raises(ValueError):
        D.quantiles(D.value_counts(numbers[0], ["x"]), ["column"], {"m": .5}, "nearest")


def summed(rows, keys):
    """Plain running totals of ``{(key, value): n}`` rows."""
    out = set()
    for row in rows:
        own = [r for r in rows if all(r[k] == row[k] for k in keys)]
        before = sum(r["n"] for r in own if r["value"] < row["value"])
        out.add((*[row[k] for k in keys], row["value"], row["n"], before, sum(r["n"] for r in own)))
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_totals(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.range(600).selectExpr("id % 3 AS k", "double(id * id % (17 + 40 * (id % 3))) AS x")
        counts = D.value_counts(frame, ["x"], ["k"])
        keys = ["k", "column"]
        got = D.running_totals(counts, keys, "value", ["n"]).select(*keys, "value", "n", "n_before", "n_total")
        assert {tuple(r) for r in got.collect()} == summed(counts.collect(), keys)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_running_totals_keep_a_column_out_of_one_task(numbers):
    counts = D.value_counts(numbers[0], ["x"])
    plan = D.running_totals(counts, ["column"], "value", ["n"])._jdf.queryExecution()
    windows = [line for line in plan.optimizedPlan().toString().splitlines() if "Window" in line]
    assert windows and all("_part" in line for line in windows)


def test_numeric_summary_equals_pandas(numbers, spark):
    frame, values = numbers
    got = {r["stat"]: r["value"] for r in profiling.numeric_summary(frame).collect()}
    import pandas as pd
    want = pd.Series(values).describe().round(2)
    assert got == pytest.approx(want.to_dict(), abs=0.011)


def test_correlation_edges(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 7.0, 5.0, 3.0), (None, 1.0, 5.0, 9.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {
        (r["column_a"], r["column_b"]): r["correlation"]
        for r in profiling.correlation_matrix(frame, ["a", "b", "c", "d"], 6).collect()
    }
    want = frame.toPandas().corr().round(6)
    for (a, b), value in got.items():
        expected = want.loc[a, b]
        assert value is None if np.isnan(expected) else value == pytest.approx(expected, abs=2e-6)
    assert len(got) == 16


def test_correlation_of_large_values_with_small_spread(spark):
    rows = [(1e9 + i, 1e9 - i % 7) for i in range(100)]
    frame = spark.createDataFrame(rows, "a double, b double")
    got = profiling.correlation_matrix(frame, ["a", "b"], 6).where("column_a < column_b").first()
    assert got["correlation"] == pytest.approx(frame.toPandas().corr().iloc[0, 1], abs=2e-6)


def test_box_of_empty_and_single(spark):
    schema = "Dropped_Out int, Number_of_Absences double"
    assert profiling.absence_box(spark.createDataFrame([], schema)).count() == 0
    row = profiling.absence_box(spark.createDataFrame([(1, 4.0)], schema)).first()
    assert (row["q1"], row["median"], row["q3"], row["outliers"]) == (4.0, 4.0, 4.0, 0)


def test_histogram_of_constant_risk(spark):
    frame = spark.createDataFrame([(0, 0.3), (1, 0.3)], "Dropped_Out int, combined_risk_score double")
    assert {r["bin"] for r in profiling.risk_histogram(frame).collect()} == {0}


def test_insights_without_columns(spark):
    frame = spark.createDataFrame([(1,), (0,)], "Dropped_Out int")
    assert {r["insight"]: r["value"] for r in profiling.insights(frame).collect()} == {
        "dropout_rate_pct": 50.0}
    assert profiling.insights(frame.withColumnRenamed("Dropped_Out", "other")).count() == 0


def test_approximate_summary_with_full_accuracy(numbers):
    frame, values = numbers
    got = {r["stat"]: r["value"]
           for r in profiling.numeric_summary(frame, accuracy=1_000_000).collect()}
    assert got["count"] == len(values)
    assert got["mean"] == pytest.approx(values.mean(), abs=0.01)
    for stat, share in (("25%", .25), ("50%", .5), ("75%", .75)):
        low = np.quantile(values, share, method="lower") - 0.01
        high = np.quantile(values, share, method="higher") + 0.01
        assert low <= got[stat] <= high
