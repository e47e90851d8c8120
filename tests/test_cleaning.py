import pytest
from pyspark.sql import functions as F

from holdfast.config import BINARY_COLUMNS, NUMERIC_COLUMNS, SOURCE_COLUMNS, TARGET, VALUE_RANGES
from holdfast.functions.numbers import clamp, half_even, to_number
from holdfast.operators import cleaning
from tests.conftest import as_set, by_id


@pytest.mark.parametrize("text, number", [
    ("3", 3.0), (" 3 ", 3.0), ("-1", -1.0), ("1e2", 100.0), (".5", 0.5), ("inf", float("inf")),
    ("-Infinity", float("-inf")), ("1d", None), ("1f", None), ("0x1p3", None), ("NaN", None),
    ("n/a", None), ("", None), ("1,5", None), (None, None),
])
def test_numbers(spark, text, number):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.selectExpr(f"{to_number('t')} AS x").first()["x"] == number


@pytest.mark.parametrize("value, places, rounded", [
    (0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (-0.001, 2, 0.0), (None, 2, None),
])
def test_rounding(spark, value, places, rounded):
    frame = spark.createDataFrame([(value,)], "x double")
    got = frame.selectExpr(f"{half_even('x', places)} AS x").first()["x"]
    assert repr(got) == repr(rounded)


def test_clamp_keeps_null(spark):
    frame = spark.createDataFrame([(None,), (-5.0,), (7.0,), (50.0,)], "x double")
    assert [r[0] for r in frame.selectExpr(clamp("x", 0, 32)).collect()] == [None, 0.0, 7.0, 32.0]


def test_clean_types_and_values(learners):
    table = cleaning.clean(learners(
        {"Number_of_Absences": "50", "Grade_1": "25", "Grade_2": "-1", TARGET: "True"},
        {"Age": "18", "Internet_Access": "maybe", "School_Support": None, "Gender": "M"},
        {"Age": "19", "Grade_1": None, "Study_Time": "bad", "Mother_Job": None},
    ))
    kinds = dict(table.dtypes)
    assert all(kinds[c] == "double" for c in NUMERIC_COLUMNS)
    assert all(kinds[c] == "int" for c in (*BINARY_COLUMNS, TARGET))
    rows = by_id(table)
    assert (rows[1].Number_of_Absences, rows[1].Grade_1, rows[1].Grade_2) == (32.0, 20.0, 0.0)
    assert (rows[1][TARGET], rows[2][TARGET]) == (1, 0)
    assert (rows[2].Internet_Access, rows[2].School_Support) == (0, 0)
    # Medians are taken before clipping: of 25 and 12, of 2 and 2.
    assert (rows[3].Grade_1, rows[3].Study_Time, rows[3].Mother_Job) == (18.5, 2.0, "teacher")
    nulls = table.select([F.count_if(F.col(c).isNull()) for c in table.columns]).first()
    assert not any(nulls)


@pytest.mark.parametrize("text, value", [
    ("True", 1), (" yes ", 1), ("1", 1), ("TRUE", 1), ("1.0", 0), ("False", 0), (None, 0),
])
def test_target(learners, text, value):
    assert cleaning.normalise_target(learners({TARGET: text})).first()[TARGET] == value


def test_duplicates_keep_smallest_id_and_compare_raw_text(learners):
    table = cleaning.drop_duplicates(learners(
        {"student_id": 9}, {"student_id": 4}, {"student_id": 6, "Grade_1": "12.0"},
        {"student_id": 8, "Mother_Job": None}, {"student_id": 7, "Mother_Job": None},
    ))
    assert sorted(by_id(table)) == [4, 6, 7]


def test_mode_tie_takes_smallest_and_absent_columns_are_skipped(learners):
    rows = cleaning.typed(learners(
        {"Mother_Job": "other"}, {"Mother_Job": "health", "Age": "18"}, {"Mother_Job": None},
    ))
    assert cleaning.fit_cleaning(rows).modes == {"Mother_Job": "health"}
    assert cleaning.fit_cleaning(rows.drop("Mother_Job")).modes == {}


def test_all_null_column_stays_null(learners):
    table = cleaning.clean(learners({"Grade_1": None}, {"Grade_1": "x", "Age": "18"}))
    assert set(by_id(table, "Grade_1").values()) == {None}


def test_empty_table(learners):
    empty = learners({}).limit(0)
    assert cleaning.clean(empty).count() == 0
    assert {r["n"] for r in cleaning.clean_audit(empty).collect()} == {0}


def test_missing_numeric_column_is_an_error(learners):
    with pytest.raises(Exception, match="Grade_1"):
        cleaning.clean(learners({}).drop("Grade_1"))


def test_every_column_fit_covers_columns_without_nulls(learners):
    rows = cleaning.typed(learners({}, {"Age": "18"}))
    stats = cleaning.fit_cleaning(rows, every_column=True)
    assert set(stats.medians) == set(NUMERIC_COLUMNS)
    assert "School" in stats.modes


def test_audit_counts(learners):
    audit = cleaning.clean_audit(learners(
        {}, {}, {"Age": "30"}, {"Grade_1": "bad", "Age": "16"},
        {"Internet_Access": "maybe", "Grade_1": "0", "Grade_2": "0"},
        {"Mother_Job": None, "Age": "18"},
    ))
    counts = {(r["check"], r["column"]): r["n"] for r in audit.collect() if r["n"]}
    assert counts == {
        ("duplicates", "*"): 1, ("out_of_range", "Age"): 1, ("imputed_median", "Grade_1"): 1,
        ("unexpected_binary", "Internet_Access"): 1, ("zero_grades", "Grade_1"): 1,
        ("imputed_mode", "Mother_Job"): 1,
    }


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_clean_does_not_depend_on_partitioning(learners, parts):
    raw = learners(*[
        {"student_id": i, "Age": str(15 + i % 11), "Grade_1": None if i % 7 == 0 else str(i % 21),
         "Mother_Job": None if i % 5 == 0 else ("health" if i % 2 else "other")}
        for i in range(200)
    ])
    assert as_set(cleaning.clean(raw.repartition(parts))) == as_set(cleaning.clean(raw))


def test_one_row_with_a_third_of_all_copies(learners):
    raw = learners(*[{"student_id": i, "Age": str(15 + (i % 3 and i % 6))} for i in range(300)])
    assert cleaning.drop_duplicates(raw).count() == raw.drop("student_id").distinct().count()


def test_whole_rows_move_only_where_a_hash_repeats(learners):
    rows = [{"student_id": i, "Age": str(i // 2 if i < 20 else i)} for i in range(2000)]
    raw = learners(*rows)
    marked = cleaning.with_repeat_mark(raw, raw.drop("student_id").columns, "_repeated")
    assert {r.student_id for r in marked.where("_repeated").collect()} == set(range(20))
    assert sorted(by_id(cleaning.drop_duplicates(raw))) == [*range(0, 20, 2), *range(20, 2000)]


def test_rows_that_share_a_bit_or_a_hash_are_compared_in_full(learners, monkeypatch):
    # Nulls leave a hash as it is, so these two rows have the same; with 64 bits nearly all rows share one.
    odd = [{"student_id": 1, "Guardian": None, "Mother_Job": "x"}, {"student_id": 2, "Guardian": "x", "Mother_Job": None}]
    raw = learners(*odd, *[{"student_id": i, "Age": str(i % 300)} for i in range(3, 900)])
    want = as_set(raw.groupBy(*raw.drop("student_id").columns).agg(F.min("student_id").alias("student_id")).select(*raw.columns))
    assert as_set(cleaning.drop_duplicates(raw)) == want
    monkeypatch.setattr(cleaning, "FILTER_BITS", 64)
    assert as_set(cleaning.drop_duplicates(raw)) == want


def test_duplicates_of_empty_tables_odd_names_and_bare_ids(spark):
    odd = spark.createDataFrame([(2, "a", None), (1, "a", None), (3, None, "a")], "student_id long, `x y` string, `p.q` string")
    assert sorted(r.student_id for r in cleaning.drop_duplicates(odd).collect()) == [1, 3]
    assert cleaning.drop_duplicates(odd.where("false")).collect() == []
    assert [r.student_id for r in cleaning.drop_duplicates(odd.select("student_id")).collect()] == [1]
    assert cleaning.drop_duplicates(odd.select("student_id").where("false")).collect() == []


def test_ranges_cover_named_columns():
    assert set(VALUE_RANGES) < set(NUMERIC_COLUMNS) < set(SOURCE_COLUMNS)


def test_target_with_any_white_space(learners):
    table = learners(*[{"Dropped_Out": t} for t in ("True\t", "\r\ntrue\n", " TRUE ", "False\t", "tr ue")])
    assert by_id(cleaning.normalise_target(table), "Dropped_Out") == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
