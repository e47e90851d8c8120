import pytest
from pyspark.sql import functions as F

from catalog.students import student_table
from holdfast.config import ID, MODELS, TARGET
from holdfast.operators import fitted
from holdfast.plans import data_pipeline, ml_pipeline
from holdfast.sources import writers
from holdfast.workspace import new_path
from tests.conftest import SMALL

FEW = {name: MODELS[name] for name in ("baseline_majority", "logistic_regression")}


@pytest.fixture(scope="module")
def folder(spark):
    path = new_path(spark, "fitted")
    results = data_pipeline.run_data_pipeline(student_table(spark, SMALL), path)
    ml_pipeline.run_ml_pipeline(spark, f"{path}/ml", path, FEW, state=results["state"])
    return path


def test_state_survives_writing(spark, folder):
    state = data_pipeline.stored_state(spark, folder)
    assert fitted.Prepared.from_entry(state.to_entry()) == state
    assert set(state.split.cuts) == {0, 1}
    with pytest.raises(LookupError):
        data_pipeline.stored_state(spark, folder + "-absent")


def test_prepared_rows_are_those_of_training(spark, folder):
    """The rows of the data set, prepared again from raw text, have the same inputs."""
    stored = spark.read.parquet(f"{folder}/ml").drop("split", TARGET)
    raw = student_table(spark, SMALL).dropDuplicates([ID])
    again = fitted.prepare(raw, data_pipeline.stored_state(spark, folder)).join(stored.select(ID), ID, "left_semi")
    assert again.columns == stored.columns
    assert again.exceptAll(stored).count() == 0 and again.count() == stored.count()


def test_later_session_scores_alike(spark, folder):
    raw = student_table(spark, SMALL)
    now = ml_pipeline.score_registered(spark, folder, raw)
    later = spark.newSession()
    again = ml_pipeline.score_registered(later, folder, student_table(later, SMALL))
    assert now.count() == raw.count()
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, again.collect()))


def test_rows_that_lack_columns_or_have_new_values(spark, folder, learners):
    state = data_pipeline.stored_state(spark, folder)
    rows = learners({}, {"Mother_Job": "astronaut", "Age": "n/a", "Grade_1": None, "Going_Out": "99"}, {})
    full = fitted.prepare(rows.drop("Free_Time", TARGET), state)
    assert tuple(full.columns[1:]) == state.inputs and TARGET not in full.columns
    by = {r[ID]: r for r in full.collect()}
    assert len(by) == 3 and by[1][1:] == by[3][1:]
    assert sum(by[2][c] for c in full.columns if c.startswith("Mother_Job_")) == 0
    assert all(v is not None for v in by[2])


def test_preparing_runs_no_shuffle(spark, folder, learners):
    plan = fitted.prepare(learners({}), data_pipeline.stored_state(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_summary_and_report_are_stored(spark, folder):
    summary = spark.read.json(f"{folder}/summary").first()
    assert summary["models_trained"] == 2 and summary["version"] == 1
    report = spark.read.json(f"{folder}/validation")
    assert {r["section"]: r["count"] for r in report.groupBy("section").count().collect()} == {
        "check": 7, "class_report": 20, "confusion_matrix": 4}
    cells = report.where("section = 'confusion_matrix'").agg(F.sum("value")).first()[0]
    assert cells == spark.read.parquet(f"{folder}/ml").where("split = 'test'").count()


def test_responses_are_stored_by_compiled_methods(spark, folder, learners, monkeypatch):
    """Preparing and scoring in one step make a method that the JVM would interpret for every row."""
    seen, writer = [], type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *args, **named: seen.append(
        int(spark.conf.get(writers.METHOD_LIMIT))) or parquet(self, *args, **named))
    scored = ml_pipeline.score_registered(spark, folder, learners({}, {}))
    assert seen == [writers.COMPILED_METHOD]
    assert sorted(r[ID] for r in scored.collect()) == ["1", "2"]
