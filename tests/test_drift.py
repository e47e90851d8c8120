"""Shift between tables, and between periods of stored counts."""

import pytest

from holdfast.operators import drift
from holdfast.workspace import new_path
from tests.conftest import as_set

COLUMNS = ["a", "b c"]


def table(spark, rows):
    return spark.createDataFrame(rows, "period string, a double, `b c` long, extra string")


@pytest.fixture
def rows():
    made = [(f"2024-{1 + i % 4:02d}", float(i % 17), i * i % 23, "x") for i in range(400)]
    return [*made, ("2024-01", None, None, "x"), ("2024-02", float("nan"), 10**6, None), (None, -50.0, 3, "y")]


def pick(rows, *periods):
    return [r for r in rows if r[0] in periods]


def test_stored_counts_give_the_report_of_two_frames(spark, rows):
    first = table(spark, pick(rows, "2024-01", "2024-02"))
    store = drift.DriftCounts(spark, new_path(spark, "drift")).create(first, COLUMNS)
    store.add(table(spark, rows[:150]), "period", "one")
    store.add(table(spark, rows[150:]), "period", "two/2 %")
    later = table(spark, pick(rows, "2024-03", "2024-04"))
    got = store.report(["2024-01", "2024-02"], ["2024-03", "2024-04"])
    assert as_set(got) == as_set(drift.drift_report(first, later, COLUMNS))
    assert [r.period for r in store.periods().collect()] == [f"2024-{m:02d}" for m in range(1, 5)]


def test_a_batch_added_again_replaces_itself_also_where_it_lost_a_period(spark, rows):
    folder = new_path(spark, "drift")
    store = drift.DriftCounts(spark, folder).create(table(spark, rows), COLUMNS)
    store.add(table(spark, rows[:100]), "period", "one")
    store.add(table(spark, rows), "period", "two")
    store.add(table(spark, rows), "period", "two")
    store.add(table(spark, pick(rows[:100], "2024-01")), "period", "one")
    again = drift.DriftCounts(spark, folder)
    want = drift.count_bins(table(spark, [*rows, *pick(rows[:100], "2024-01")]), again.bins())
    assert as_set(again.counts()) == as_set(want)
    store.add(table(spark, []), "period", "two")
    assert {r.period for r in again.periods().collect()} == {"2024-01"}


def test_bins_stay_as_they_were_fixed(spark, rows):
    folder = new_path(spark, "drift")
    first = drift.DriftCounts(spark, folder).create(table(spark, rows), COLUMNS).bins()
    assert drift.DriftCounts(spark, folder).create(table(spark, rows[:3]), COLUMNS).bins() == first
    with pytest.raises(LookupError):
        drift.DriftCounts(spark, new_path(spark, "none")).bins()


def test_empty_and_constant_columns(spark):
    flat = table(spark, [("p", 5.0, None, None)] * 3)
    report = {r["column"]: (r["psi"], r["level"]) for r in drift.drift_report(flat, flat, COLUMNS).collect()}
    assert report == {"a": (0.0, "stable")}
    assert drift.drift_report(table(spark, []), table(spark, []), COLUMNS).collect() == []
