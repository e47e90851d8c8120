import json

from holdfast.operators import cleaning, features, quality


def report_of(df, **options):
    return {r["rule"]: r for r in quality.quality_report(df, **options).collect()}


def test_clean_table_passes_all_critical_rules_but_size(learners):
    table = features.build_feature_set(cleaning.clean(learners(
        {}, {"Dropped_Out": "True"}, {"Going_Out": "5"})))
    report = report_of(table)
    assert len(report) == 9
    assert {rule for rule, r in report.items() if not r["passed"]} == {"dq_min_rows"}
    assert report_of(table, min_rows=3)["dq_min_rows"]["passed"]


def test_each_rule_can_fail(learners):
    rows = cleaning.typed(learners(
        {}, {}, {"Grade_1": "0", "Grade_2": "0"}, {"Age": "40"}, {"Study_Time": "?"}))
    report = report_of(rows.drop("Final_Grade", "Grade_2").withColumn("Health_Status", rows.School))
    details = {rule: json.loads(r["details"]) for rule, r in report.items()}
    assert details["dq_required_columns"] == {"missing_columns": ["Grade_2", "Final_Grade"]}
    assert details["dq_no_missing"] == {"columns_with_missing": {"Study_Time": 1}}
    assert details["dq_no_duplicates"]["duplicate_count"] == 1
    assert details["dq_column_types"] == {
        "type_errors": {"Health_Status": {"expected": "numeric", "found": "string"}}}
    assert details["dq_value_ranges"]["violations"]["Age"] == {
        "expected_range": [15, 22], "n_violations": 1, "min_found": 17.0, "max_found": 40.0}
    assert details["dq_target_balance"] == {"class_counts": {"0": 5}}
    assert "dq_grade_consistency" not in report
    assert not any(r["passed"] for r in report.values())


def test_target_rule_left_out_without_target(learners):
    assert "dq_target_balance" not in report_of(cleaning.typed(learners({})).drop("Dropped_Out"))


def test_warnings_do_not_decide(learners):
    rows = cleaning.typed(learners({}, {}, {"Dropped_Out": "True"}))
    summary = quality.quality_summary(quality.quality_report(rows, min_rows=1)).first()
    assert summary["overall_passed"] and summary["failed"] == 2


def test_duplicates_compare_every_column_but_the_id(spark):
    from holdfast.operators import profiling

    rows = [(i, 1.0, None, "x", float(i % 3)) for i in range(6)] + [(9, None, 1.0, "x", 0.0)]
    frame = spark.createDataFrame(
        rows, "student_id long, Age double, Grade_1 double, School string, family_support_score double")
    assert tuple(profiling.duplicate_count(frame).first()) == (3, 7)
