import pytest
from pyspark.sql import functions as F

from holdfast.config import ID, TARGET
from holdfast.operators import models, registry, validation
from holdfast.plans import ml_pipeline
from holdfast.sources import writers
from holdfast.workspace import new_path

SMALL_MODELS = {
    "baseline_majority": {"kind": "majority"},
    "logistic_regression": {"kind": "logistic", "iterations": 50, "balanced": True},
    "forest": {"kind": "forest", "trees": 5, "depth": 4, "min_split": 5, "balanced": True},
    "boosting": {"kind": "boosting", "rounds": 3, "depth": 3, "rate": 0.1,
                 "row_share": 0.8, "column_share": 0.8},
}


@pytest.fixture(scope="module")
def parts(spark):
    table = spark.range(400).select(
        F.col("id").alias(ID),
        ((F.rand(1) - 0.5) * 4).alias("Age"),
        ((F.rand(2) - 0.5) * 4).alias("Grade_1"),
        (F.col("id") % 5).cast("double").alias("Travel_Time"),
    ).withColumn(TARGET, F.when(F.col("Age") + F.col("Grade_1") > 0.8, 1).otherwise(0))
    path = new_path(spark, "models")
    table.write.parquet(path)
    table = spark.read.parquet(path)
    return table.where("student_id % 5 > 0"), table.where("student_id % 5 = 0")


@pytest.fixture(scope="module")
def forest(parts):
    return models.train_single("forest", *parts, settings=SMALL_MODELS["forest"])


@pytest.mark.parametrize("name", SMALL_MODELS)
def test_training(parts, name):
    train, test = parts
    run = models.train_single(name, train, test, SMALL_MODELS[name])
    scored = models.predict(run.model, test).collect()
    assert len(scored) == test.count()
    assert all(0 <= r["score"] <= 1 and r["prediction"] in (0, 1) for r in scored)
    if name == "baseline_majority":
        share = test.where(f"{TARGET} = 0").count() / test.count()
        assert run.metrics["accuracy"] == pytest.approx(share, abs=1e-4)
        assert run.importance is None
    else:
        assert run.metrics["roc_auc"] > 0.8
        assert set(run.importance) == {"Age", "Grade_1", "Travel_Time"}


def test_same_seed_same_result(parts, forest):
    again = models.train_single("forest", *parts, settings=SMALL_MODELS["forest"])
    assert again.metrics["roc_auc"] == forest.metrics["roc_auc"]
    assert again.run_id != forest.run_id


def test_failing_model_is_an_error_or_shown(spark, parts):
    table = {"bad": {"kind": "unknown"}, "baseline_majority": SMALL_MODELS["baseline_majority"]}
    with pytest.raises(RuntimeError, match="bad"):
        models.train_all(*parts, table)
    runs = models.train_all(*parts, table, strict=False)
    assert [run.name for run in runs] == ["baseline_majority"]
    states = {r["model"]: r["status"] for r in models.run_states(spark, runs, table).collect()}
    assert states == {"bad": "failed", "baseline_majority": "trained"}


def test_model_does_not_depend_on_partitions(parts):
    train, test = parts
    scores = []
    for n in (1, 7, 64):
        model = models.fit_model(SMALL_MODELS["forest"], train.repartition(n))
        scores.append(sorted((r[ID], r["score"]) for r in models.predict(model, test).collect()))
    assert scores[0] == scores[1] == scores[2]


def test_names_with_dots(parts):
    train, test = (p.withColumnRenamed("Grade_1", "Mother_Job_a.b") for p in parts)
    model = models.fit_model(SMALL_MODELS["forest"], train)
    assert set(models.feature_importance(model)) == {"Age", "Mother_Job_a.b", "Travel_Time"}
    assert models.predict(model, test).count() == test.count()


def test_many_text_values_train(spark):
    rows = [(i, f"job{i % 40}", float(i % 9), int(i % 40 < 8)) for i in range(800)]
    train = spark.createDataFrame(rows, f"{ID} long, Mother_Job string, Age double, {TARGET} int")
    model = models.train_raw_balanced(train, {**models.SERVED, "trees": 5})
    right = model.transform(train).where(f"prediction = {TARGET}").count()
    assert right > 700


def test_fit_rows_are_bounded_and_spread(spark):
    frame = spark.range(20_000).selectExpr(f"id AS {ID}", f"int(id % 2) AS {TARGET}")
    kept = models.fit_rows(frame, 20_000, 2_000)
    assert 1_700 < kept.count() < 2_300
    assert models.fit_rows(frame, 20_000).count() == 20_000


def test_balanced_weights(spark):
    frame = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, f"{TARGET} int")
    weights = {r[TARGET]: r["class_weight"] for r in models.balanced_weights(frame).collect()}
    assert weights == {0: 8 / 12, 1: 2.0}


def test_majority_tie_takes_smaller_class(spark):
    assert models.majority_class(spark.createDataFrame([(1,), (0,)], f"{TARGET} int")) == 0


def test_validation(parts, forest):
    checks = {r["check"]: r for r in validation.validate_model(forest.model, parts[1]).collect()}
    assert len(checks) == 7 and all(r["passed"] for r in checks.values())


def test_constant_model_is_not_sensitive(parts):
    model = models.baseline_majority(parts[0])
    checks = {r["check"]: r["passed"] for r in validation.validate_model(model, parts[1]).collect()}
    assert [name for name, passed in checks.items() if not passed] == ["sensitivity"]
    summary = validation.validation_summary(validation.validate_model(model, parts[1])).first()
    assert (summary["n_passed"], summary["n_total"], summary["all_passed"]) == (6, 7, False)


def test_registry(spark, parts, forest):
    folder = new_path(spark, "registry")
    with pytest.raises(LookupError):
        registry.production_model(spark, folder)
    base = models.train_single("baseline_majority", *parts, SMALL_MODELS["baseline_majority"])
    assert registry.register_model(spark, folder, base)["version"] == 1
    entry = registry.register_model(spark, folder, forest, "because")
    assert (entry["version"], entry["stage"]) == (2, "Production")
    rows = {r["version"]: r for r in registry.registry_table(spark, folder).collect()}
    assert (rows[1]["stage"], rows[2]["stage"]) == ("Archived", "Production")
    loaded = registry.production_model(spark, folder)
    same = models.predict(loaded, parts[1]).exceptAll(models.predict(forest.model, parts[1]))
    assert same.count() == 0


def test_ml_pipeline(spark, parts):
    train, test = parts
    dataset = new_path(spark, "dataset")
    writers.save_ml_datasets(
        train.withColumn("split", F.lit("train")).union(test.withColumn("split", F.lit("test"))),
        dataset)
    folder = new_path(spark, "ml")
    results = ml_pipeline.run_ml_pipeline(spark, dataset, folder, SMALL_MODELS)
    summary = ml_pipeline.pipeline_summary(spark, results).first()
    assert summary["models_trained"] == 4
    assert summary["best_model"] != "baseline_majority"
    assert (summary["version"], summary["stage"]) == (1, "Production")
    assert spark.read.option("header", True).csv(f"{folder}/comparison").count() == 4
    with pytest.raises(ml_pipeline.ValidationError):
        ml_pipeline.run_ml_pipeline(
            spark, dataset, folder, {"baseline_majority": {"kind": "majority"}}, strict=True)


def test_broken_run_goes_on(spark, parts, monkeypatch):
    """After two models the run breaks off; the next one trains only the others."""
    folder = new_path(spark, "runs")
    trained = []
    train_single = models.train_single

    def counted(name, *args):
        if len(trained) == 2:
            raise OSError("lost")
        trained.append(name)
        return train_single(name, *args)

    monkeypatch.setattr(models, "train_single", counted)
    with pytest.raises(RuntimeError, match="training failed"):
        models.train_all(*parts, SMALL_MODELS, folder=folder, side_by_side=1)
    first = list(trained)
    assert len(first) == 2

    monkeypatch.setattr(models, "train_single", lambda name, *args: trained.append(name) or train_single(name, *args))
    runs = models.train_all(*parts, SMALL_MODELS, folder=folder)
    assert [run.name for run in runs] == list(SMALL_MODELS)
    assert sorted(trained) == sorted(SMALL_MODELS)
    assert all(models.predict(run.model, parts[1]).count() == parts[1].count() for run in runs)

    # Other rows or other settings are trained anew.
    again = {**SMALL_MODELS, "forest": {**SMALL_MODELS["forest"], "trees": 6}}
    models.train_all(*parts, again, folder=folder)
    assert sorted(trained) == sorted([*SMALL_MODELS, "forest"])
    models.train_all(parts[0].where("student_id > 20"), parts[1], {"forest": again["forest"]}, folder=folder)
    assert trained.count("forest") == 3


def test_models_side_by_side_are_those_trained_alone(parts):
    train, test = parts
    for run in models.train_all(train, test, SMALL_MODELS):
        alone = models.predict(models.fit_model(SMALL_MODELS[run.name], train), test)
        assert alone.exceptAll(models.predict(run.model, test)).count() == 0


def test_number_of_parts(parts):
    assert [models.fit_parts(n) for n in (0, 1, models.PART_ROWS, models.PART_ROWS + 1)] == [1, 1, 1, 2]
    assert models.fit_parts(10**9) == models.fit_parts(models.FIT_ROWS)
    ordered = models.fit_rows(parts[0], 320, parts=3)
    assert ordered.rdd.getNumPartitions() == 3


def test_forests_keep_the_node_of_each_row(spark):
    """Without it every level of a deep forest walks all rows from the roots."""
    from holdfast.config import MODELS

    for name in ("random_forest_v1", "random_forest_v2"):
        assert models.estimator(MODELS[name], 1000).getCacheNodeIds()


def test_test_rows_are_scored_once(parts, monkeypatch):
    seen, predictions = [], models.predictions
    monkeypatch.setattr(models, "predictions", lambda *args: seen.append(args[1]) or predictions(*args))
    run = models.train_single("logistic_regression", *parts, SMALL_MODELS["logistic_regression"])
    assert seen == ["logistic_regression"]
    assert run.scored.inputFiles()
    assert sorted(run.scored.collect()) == sorted(predictions(run.model, run.name, parts[1]).collect())
    plan = run.scored._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan


def test_pipeline_validates_once(spark, parts, monkeypatch):
    train, test = parts
    rows = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    dataset = writers.save_ml_datasets(rows, new_path(spark, "validated_once"))
    made, validate = [], validation.validate_model
    monkeypatch.setattr(validation, "validate_model", lambda *args: made.append(1) or validate(*args))
    few = {name: SMALL_MODELS[name] for name in ("baseline_majority", "logistic_regression")}
    folder = new_path(spark, "validated_once_run")
    results = ml_pipeline.run_ml_pipeline(spark, dataset, folder, few)
    assert made == [1]
    stored = spark.read.json(f"{folder}/validation").where("section = 'check'")
    assert sorted(stored.select("item", "passed").collect()) == sorted(results["checks"].select("check", "passed").collect())


def test_parts_are_few_and_large():
    """Every part sends counts for every node of a level: 49 parts for 720,000 rows took twice the time of 12."""
    assert models.fit_parts(720_000) == 12
    assert models.fit_parts(10**9) == 16


def test_large_forests_are_fitted_in_groups(parts, monkeypatch, tmp_path):
    """Groups of trees side by side, each on all rows; the forest has all their trees."""
    train, test = parts
    monkeypatch.setattr(models, "PART_ROWS", 100)
    monkeypatch.setattr(models, "TREES_TOGETHER", 2)
    settings = {**SMALL_MODELS["forest"], "trees": 5}
    assert models.tree_groups(settings, 320) == [2, 2, 1]
    fitted, rows_of = [], models.fit_rows
    monkeypatch.setattr(models, "fit_rows", lambda df, *a, **k: fitted.append(rows_of(df, *a, **k)) or fitted[-1])
    run = models.train_single("forest", train, test, settings)
    assert [df.count() for df in fitted[1:]] == [320] * 3  # the first is the table of vectors
    assert all(df.rdd.getNumPartitions() == 2 for df in fitted[1:])
    forest = run.model.stages[-1]
    assert forest.getNumTrees == forest.getOrDefault("numTrees") == len({t.toDebugString for t in forest.trees}) == 5
    assert run.metrics["roc_auc"] > 0.8
    assert sum(run.importance.values()) == pytest.approx(1, abs=1e-4)
    run.model.write().save(f"{tmp_path}/forest")
    before, again = models.predict(run.model, test), models.fit_model(settings, train)
    for other in (models.PipelineModel.load(f"{tmp_path}/forest"), again):
        assert sorted(models.predict(other, test).collect()) == sorted(before.collect())


def test_served_forest_in_groups(spark, monkeypatch, tmp_path):
    """Columns with different numbers of texts, of which PySpark makes lists of one length."""
    rows = [(i, f"job{i % 40}", "FM"[i % 2], None if i % 7 == 0 else float(i % 9), int(i % 40 < 8)) for i in range(800)]
    train = spark.createDataFrame(rows, f"{ID} long, Mother_Job string, Gender string, Age double, {TARGET} int")
    monkeypatch.setattr(models, "PART_ROWS", 200)
    monkeypatch.setattr(models, "TREES_TOGETHER", 3)
    model = models.train_raw_balanced(train, {**models.SERVED, "trees": 7})
    assert model.stages[-1].getNumTrees == 7
    assert model.transform(train).where(f"prediction = {TARGET}").count() > 700
    assert set(models.served_inputs(model)) == {"Age", "Mother_Job", "Gender"}
    model.write().save(f"{tmp_path}/served")
    loaded = models.PipelineModel.load(f"{tmp_path}/served")
    assert sorted(models.predict(loaded, train).collect()) == sorted(models.predict(model, train).collect())


def test_groups_hold_every_tree_and_no_part_all_rows():
    from holdfast.config import MODELS

    forest = MODELS["random_forest_v2"]
    assert models.tree_groups(forest, models.PART_ROWS) == [200]
    assert models.tree_groups(forest, models.PART_ROWS + 1) == [25] * 8
    assert sum(models.tree_groups({**forest, "trees": 83}, 10**7)) == 83
    assert [models.group_parts(n) for n in (models.PART_ROWS + 1, 720_000, 10**9)] == [2, 3, 4]


def test_served_rows_are_stored_once(spark):
    from catalog import registry as queries
    from tests.conftest import SMALL

    first, again = (queries.served_rows(spark, SMALL) for _ in range(2))
    assert set(first.inputFiles()) == set(again.inputFiles())
