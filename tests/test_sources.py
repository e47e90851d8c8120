import pytest
from pyspark.errors import AnalysisException

from holdfast import workspace
from holdfast.operators import activity
from holdfast.plans import data_pipeline
from holdfast.sources import readers, writers
from holdfast.workspace import new_path
from tests.conftest import as_set, by_id


def test_missing_marks_become_null(learners, spark):
    raw = learners({"Grade_1": "NA", "Mother_Job": "None", "Age": ""}, {"School": None})
    path = writers.save_csv(raw, new_path(spark, "csv"))
    rows = by_id(readers.load_raw(spark, path))
    assert (rows[1].Grade_1, rows[1].Mother_Job, rows[1].Age, rows[2].School) == (None,) * 4


def test_missing_path(spark):
    with pytest.raises(AnalysisException):
        readers.load_raw(spark, new_path(spark, "nowhere"))


def test_padded_names_and_content_ids(learners, spark):
    raw = learners({}, {}, {"Age": "20"}).drop("student_id")
    path = writers.save_csv(raw.toDF(*[f" {c} " for c in raw.columns]), new_path(spark, "csv"))
    table = readers.load_raw(spark, path)
    assert table.columns[1:] == raw.columns
    assert table.select("student_id").distinct().count() == 2
    assert as_set(table) == as_set(readers.load_raw(spark, path))


def test_files_with_other_headers(learners, spark):
    rows = learners({"Grade_1": "3"}, {"Grade_1": "NA", "Mother_Job": "a, b"}, {"School": "MS"}, {"Age": "20"})
    clean, mixed = new_path(spark, "clean"), new_path(spark, "mixed")
    rows.coalesce(1).write.option("header", True).csv(clean)
    backwards = rows.select(*reversed(rows.columns))
    for part, table in (("student_id = 1", rows), ("student_id IN (2, 3)", backwards), ("student_id = 4", rows.drop("Age"))):
        table.where(part).coalesce(1).write.mode("append").option("header", True).csv(mixed)
    want, got = by_id(readers.load_raw(spark, clean)), by_id(readers.load_upload(spark, mixed))
    assert set(got) == {1, 2, 3, 4} and got[4].Age is None
    for i in (1, 2, 3):
        assert got[i].asDict() == want[i].asDict()
    assert as_set(readers.load_upload(spark, clean)) == as_set(readers.load_raw(spark, clean))
    with pytest.raises(Exception, match="(?i)header"):
        readers.load_raw(spark, mixed).collect()


def test_ids_of_files_without_them(learners, spark):
    rows = learners({"Age": "16"}, {"Age": "18"}, {"Age": "20"})
    mixed, alone = new_path(spark, "mixed"), new_path(spark, "alone")
    rows.where("student_id = 1").write.option("header", True).csv(mixed)
    for path in (mixed, alone):
        rows.where("student_id > 1").drop("student_id").write.mode("append").option("header", True).csv(path)
    got = {r.Age: r.student_id for r in readers.load_upload(spark, mixed).collect()}
    assert got["16"] == 1
    assert {r.Age: r.student_id for r in readers.load_raw(spark, alone).collect()} == {a: got[a] for a in ("18", "20")}


def test_parts_are_read_alone(spark):
    frame = spark.range(20).selectExpr(
        "id AS student_id", "int(id % 2) AS Dropped_Out", "if(id < 15, 'train', 'test') AS split")
    path = writers.save_ml_datasets(frame, new_path(spark, "ml"))
    train, test = readers.load_ml_datasets(spark, path)
    assert (train.count(), test.count()) == (15, 5)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert writers.inputs_of(train).columns == ["student_id"]
    assert writers.targets_of(train).columns == ["student_id", "Dropped_Out"]


def test_pipeline_strictness(learners, spark):
    raw = learners(*[
        {"student_id": i, "Age": str(15 + i % 8), "Going_Out": str(1 + i % 5),
         "Dropped_Out": str(i % 4 == 0)} for i in range(60)])
    results = data_pipeline.run_data_pipeline(raw, new_path(spark, "run"))
    assert not results["verdict"]["overall_passed"]  # fewer than 100 rows
    assert results["ml"].rows.count() == results["features"].count()
    with pytest.raises(data_pipeline.QualityError):
        data_pipeline.run_data_pipeline(raw, new_path(spark, "run"), strict=True)


def test_shared_folder_is_the_named_one(spark):
    assert new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_cluster_without_shared_folder_is_an_error():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Session())


def test_user_activity(spark):
    rows = [(1, "2024-01-01 10:00:05"), (1, "2024-01-01 10:00:50"), (1, "2024-01-02 09:00:00"),
            (2, "2024-01-01 10:00:05"), (None, "2024-01-01 10:00:05")]
    events = spark.createDataFrame(rows, "user_id bigint, t string").selectExpr(
        "user_id", "timestamp(t) AS ts")
    got = {r[0]: tuple(r)[1:] for r in activity.user_activity(events).collect()}
    assert got == {1: (3, 2, 2), 2: (1, 1, 1)}
