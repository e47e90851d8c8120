import pytest

from holdfast.config import REQUEST_FIELDS
from holdfast.operators import cleaning, models, scoring
from holdfast.sources import readers, writers
from holdfast.streaming.scoring import rejected_uploads, score_stream, score_uploads, scored_uploads
from holdfast.workspace import new_path
from tests.conftest import LEARNER, as_set, by_id

FOREST = {"kind": "forest", "trees": 5, "depth": 4, "min_split": 5, "balanced": True}


@pytest.fixture(scope="module")
def served(spark):
    from catalog.registry import served_rows
    from tests.conftest import SMALL
    return models.train_raw_balanced(served_rows(spark, SMALL), FOREST)


@pytest.mark.parametrize("score, prediction, band", [
    (0.0, 0, "Faible"), (0.39, 0, "Faible"), (0.4, 0, "Moyenne"), (0.5, 0, "Moyenne"),
    (0.51, 1, "Moyenne"), (0.6, 1, "Forte"), (0.8, 1, "Tres forte"), (1.0, 1, "Tres forte"),
])
def test_decision_and_band(spark, score, prediction, band):
    row = scoring.decide(spark.createDataFrame([(7, score)], "student_id bigint, score double")).first()
    assert (row["student_id"], row["prediction"], row["probability"], row["confidence"]) == (
        "7", prediction, score, band)


def test_default_fields(learners):
    upload = scoring.rename_for_scoring(
        learners({"Age": "n/a", "Mother_Education": "3"}).drop("Travel_Time", "Mother_Job"))
    row = scoring.default_fields(upload).first()
    assert row["age"] is None and row["mother_edu"] == 3
    assert (row["travel_time"], row["mother_job"]) == (2, "services")
    assert len(row) == 1 + len(REQUEST_FIELDS)


def test_own_name_before_source_name(learners):
    upload = learners({"Health_Status": "1"}).withColumn("health", cleaning.F.lit("5"))
    assert scoring.default_fields(upload).first()["health"] == 5


def test_missing_columns(learners, served):
    upload = learners({}).drop("Grade_1")
    assert scoring.require_columns(scoring.rename_for_scoring(upload)) == ["grade_1"]
    with pytest.raises(ValueError, match="grade_1"):
        scoring.score_batch(served, upload)


def test_align(learners):
    aligned = scoring.align_columns(learners({}), ["Age", "Nowhere"])
    assert aligned.columns == ["student_id", "Age", "Nowhere"]
    assert aligned.first()["Nowhere"] == 0


def test_served_model_reads_raw_columns_only(served):
    inputs = scoring.served_inputs(served)
    assert "Dropped_Out" not in inputs and len(inputs) == 33


def test_score_batch(learners, served):
    upload = learners({}, {"Mother_Job": "astronaut"}, {"Grade_1": None, "Grade_2": "x"})
    rows = by_id(scoring.score_batch(served, upload))
    assert sorted(rows) == ["1", "2", "3"]
    assert all(0 <= r["probability"] <= 1 for r in rows.values())
    assert scoring.score_batch(served, upload.limit(0)).count() == 0


def test_target_must_not_be_an_input(learners):
    assert "Dropped_Out" not in (*models.SERVED_NUMERIC, *models.SERVED_TEXT)


def scored_rows(spark):
    rows = [(1, "GP", "F", 17, 0.905), (2, "MS", "F", 18, 0.55), (3, "GP", "M", 25, 0.75),
            (4, "GP", "F", 16, 0.5), (5, "GP", "F", 16, 0.5996)]
    frame = spark.createDataFrame(
        rows, "student_id bigint, school string, sex string, age int, score double")
    return frame.selectExpr("*", *[
        f"10 AS {c}" for c in ("absences", "grade_1", "grade_2", "final_grade")])


def test_at_risk(spark):
    def ids(**filters):
        return sorted(by_id(scoring.at_risk_filter(scored_rows(spark), **filters)))

    assert ids() == [1, 2, 3, 5]
    assert ids(max_age=20) == [1, 2, 5]
    assert ids(school="GP", sex="F") == [1, 5]
    # 0.5996 is displayed as 60.0%.
    assert ids(min_probability=0.6) == [1, 3, 5]


def test_display_and_limit(spark):
    shown = by_id(scoring.score_display(scoring.score_limit(scored_rows(spark), 2)))
    assert sorted(shown) == [1, 2]
    assert (shown[1].prediction, shown[1].probability, shown[1].confidence) == (
        "Dropout", "90.5%", "Tres forte")


def test_stream_equals_batch_and_resumes(spark, learners, served):
    uploads, sink, checkpoint = (new_path(spark, n) for n in ("in", "out", "ck"))
    order = readers.RAW_SCHEMA.names
    first = learners({}, {"Grade_1": "n/a", "student_id": 2})
    second = learners({"student_id": 3, "Final_Grade": "0"})
    for batch in (first, second):
        batch.select(order).write.mode("append").option("header", True).csv(uploads)
        score_stream(served, readers.stream_uploads(spark, uploads), sink, checkpoint).awaitTermination()
    assert as_set(spark.read.parquet(sink)) == as_set(
        scoring.score_batch(served, first.union(second)))


def save(table, folder):
    table.coalesce(1).write.mode("append").option("header", True).csv(folder)


def test_uploads_with_other_headers_equal_the_batch_and_resume(spark, learners, served):
    uploads, folder = new_path(spark, "in"), new_path(spark, "out")
    first = learners({}, {"Grade_1": "n/a", "student_id": 2})
    second = learners({"student_id": 3, "Final_Grade": "0", "Mother_Job": "a, b"}).select(*reversed(first.columns))
    for batch in (first, second):
        save(batch, uploads)
        score_uploads(served, spark, uploads, folder, files_per_batch=1).awaitTermination()
    got = scored_uploads(spark, folder)
    assert as_set(got) == as_set(scoring.score_batch(served, readers.load_upload(spark, uploads)))
    assert as_set(got) == as_set(scoring.score_batch(served, first.unionByName(second)))
    assert rejected_uploads(spark, folder).count() == 0


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_defaults_hold_for_files_without_a_column(spark, learners, served, files_per_batch):
    uploads, folder = new_path(spark, "in"), new_path(spark, "out")
    whole, bare = learners({}), learners({"student_id": 2}).drop("Mother_Job")
    named = scoring.rename_for_scoring(learners({"student_id": 3}))
    for table in (whole, bare, named):
        save(table, uploads)
    score_uploads(served, spark, uploads, folder, files_per_batch).awaitTermination()
    want = [as_set(scoring.score_batch(served, t)) for t in (whole, bare, learners({"student_id": 3}))]
    assert as_set(scored_uploads(spark, folder)) == sorted(sum(want, []))


def test_unreadable_files_and_rows_go_to_a_side_table(spark, learners, served, tmp_path):
    uploads, folder = tmp_path / "in", new_path(spark, "out")
    uploads.mkdir()
    names = readers.RAW_SCHEMA.names
    good = ["7", *[LEARNER[c] for c in names[1:]]]
    lines = [good, ["n/a", *good[1:]], ["seven", *good[1:]], good[:-1], [*good, "more"]]
    (uploads / "rows [1] 50%+{a}.csv").write_text("\n".join(",".join(x) for x in [names, *lines]) + "\n")
    (uploads / "empty.csv").write_text("\n")
    (uploads / "twice.csv").write_text("Age,age\n1,2\n")
    (uploads / "short.csv").write_text(",".join(c for c in names if c != "Age") + "\n")
    score_uploads(served, spark, str(uploads), folder).awaitTermination()
    assert {r.student_id for r in scored_uploads(spark, folder).collect()} == {"7", None}
    found = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejected_uploads(spark, folder).collect())
    assert found == [
        ("empty.csv", "no header"), ("rows [1] 50%+{a}.csv", "cells do not fit the header"),
        ("rows [1] 50%+{a}.csv", "cells do not fit the header"), ("rows [1] 50%+{a}.csv", "the id is no number"),
        ("short.csv", "no column Age"), ("twice.csv", "a column name is used twice")]


def test_export(spark):
    report = scoring.at_risk_filter(scored_rows(spark))
    path = writers.export_results(report, new_path(spark, "export"))
    back = spark.read.schema(report.schema).option("header", True).csv(path)
    assert as_set(back) == as_set(report)
