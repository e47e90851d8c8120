"""Registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.students import student_table
from holdfast.config import (
    BINARY_COLUMNS,
    CATEGORICAL_COLUMNS,
    FEATURE_COLUMNS,
    ID,
    MODELS,
    NUMERIC_COLUMNS,
    QUALITY_RULES,
    SCALED_COLUMNS,
    TARGET,
    UPLOAD_FIELDS,
)
from holdfast.functions.numbers import half_even
from holdfast.operators import (
    activity,
    cleaning,
    cohorts,
    comparison,
    dictionary,
    drift,
    encoding,
    features,
    fitted,
    metrics,
    models,
    profiling,
    quality,
    scoring,
    segments,
    splitting,
    validation,
)
from holdfast.operators import registry as model_versions
from holdfast.plans import data_pipeline, ml_pipeline
from holdfast.sources import readers, writers
from holdfast.streaming import activity as activity_streamed
from holdfast.streaming import scoring as streamed
from holdfast.workspace import materialise, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def raw(spark, sf_dir):
    return student_table(spark, sf_dir)


def typed_unique(spark, sf_dir):
    return cleaning.unique_typed_rows(raw(spark, sf_dir))


def cleaned(spark, sf_dir):
    return cleaning.clean(raw(spark, sf_dir))


def featured(spark, sf_dir):
    return features.build_feature_set(cleaned(spark, sf_dir))


@register
def trim_columns(spark, sf_dir):
    table = raw(spark, sf_dir)
    return cleaning.trim_columns(table.toDF(*[f"  {c} " for c in table.columns]))


@register
def drop_duplicates(spark, sf_dir):
    return cleaning.drop_duplicates(raw(spark, sf_dir))


@register
def normalise_target(spark, sf_dir):
    return cleaning.normalise_target(raw(spark, sf_dir)).select(ID, TARGET)


@register
def map_binary(spark, sf_dir):
    return cleaning.map_binary(raw(spark, sf_dir)).select(ID, *BINARY_COLUMNS)


@register
def coerce_numeric(spark, sf_dir):
    return cleaning.coerce_numeric(raw(spark, sf_dir)).select(ID, *NUMERIC_COLUMNS)


@register
def impute_median(spark, sf_dir):
    rows = typed_unique(spark, sf_dir).select(ID, *NUMERIC_COLUMNS)
    return cleaning.impute_median(rows, cleaning.fit_cleaning(rows))


@register
def impute_mode(spark, sf_dir):
    rows = typed_unique(spark, sf_dir).select(ID, *CATEGORICAL_COLUMNS)
    return cleaning.impute_mode(rows, cleaning.fit_cleaning(rows))


@register
def flag_zero_grades(spark, sf_dir):
    rows = typed_unique(spark, sf_dir)
    return cleaning.flag_zero_grades(cleaning.impute(rows, cleaning.fit_cleaning(rows)))


@register
def clip_ranges(spark, sf_dir):
    return cleaning.clip_ranges(typed_unique(spark, sf_dir)).select(ID, *NUMERIC_COLUMNS)


@register
def clean(spark, sf_dir):
    return cleaned(spark, sf_dir)


@register
def clean_audit(spark, sf_dir):
    return cleaning.clean_audit(raw(spark, sf_dir))


def _feature(name):
    def query(spark, sf_dir):
        table = cleaned(spark, sf_dir)
        full = features.build_feature_set(table)
        return full.select(ID, name)

    query.__name__ = name
    return register(query)


for _name in FEATURE_COLUMNS:
    _feature(_name)


@register
def build_feature_set(spark, sf_dir):
    return featured(spark, sf_dir)


# Profiles, cohorts and quality rules.


_feature_paths: dict[tuple[str, str], str] = {}


def stored_features(spark, sf_dir):
    """The feature table as the pipeline stores it: written once per application and folder.

    Operators that follow feature building read this table; cleaning and feature queries build
    theirs anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _feature_paths:
        path = new_path(spark, "features")
        _feature_paths[key] = writers.save_features(featured(spark, sf_dir), path)
    return spark.read.parquet(_feature_paths[key])


def typed_raw(spark, sf_dir):
    """Typed rows before de-duplication, imputation and clipping: what the raw-file reports read."""
    return cleaning.typed(raw(spark, sf_dir))


def encoded(spark, sf_dir):
    return encoding.one_hot(stored_features(spark, sf_dir))


@register
def low_grade_cohort(spark, sf_dir):
    return cohorts.cohort_rate(cohorts.low_grades(typed_raw(spark, sf_dir)))


@register
def low_grade_sample(spark, sf_dir):
    return cohorts.cohort_sample(cohorts.low_grades(typed_raw(spark, sf_dir)))


@register
def zero_final_cohort(spark, sf_dir):
    return cohorts.cohort_rate(cohorts.zero_final(typed_raw(spark, sf_dir)))


@register
def high_absence_cohort(spark, sf_dir):
    return cohorts.cohort_rate(cohorts.many_absences(typed_raw(spark, sf_dir)))


@register
def table_stats(spark, sf_dir):
    return profiling.table_stats(stored_features(spark, sf_dir))


@register
def numeric_summary(spark, sf_dir):
    return profiling.numeric_summary(stored_features(spark, sf_dir))


@register
def numeric_summary_lineitem(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return profiling.numeric_summary(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register
def target_distribution(spark, sf_dir):
    return profiling.target_distribution(stored_features(spark, sf_dir))


@register
def grade_histogram(spark, sf_dir):
    return profiling.grade_histogram(stored_features(spark, sf_dir))


@register
def correlation_matrix(spark, sf_dir):
    return profiling.correlation_matrix(stored_features(spark, sf_dir))


@register
def correlation_matrix_with_nulls(spark, sf_dir):
    return profiling.correlation_matrix(typed_unique(spark, sf_dir))


@register
def absence_box(spark, sf_dir):
    return profiling.absence_box(stored_features(spark, sf_dir))


@register
def study_time_by_status(spark, sf_dir):
    return profiling.study_time_by_status(stored_features(spark, sf_dir))


@register
def risk_histogram(spark, sf_dir):
    return profiling.risk_histogram(stored_features(spark, sf_dir))


@register
def insights(spark, sf_dir):
    return profiling.insights(stored_features(spark, sf_dir))


@register
def run_eda(spark, sf_dir):
    return profiling.eda_long(stored_features(spark, sf_dir))


def _rule(name):
    def query(spark, sf_dir):
        return quality.quality_report(typed_raw(spark, sf_dir)).where(F.col("rule") == name)

    query.__name__ = name
    return register(query)


for _name in QUALITY_RULES:
    _rule(_name)


@register
def quality_report(spark, sf_dir):
    return quality.quality_report(materialise(encoded(spark, sf_dir), "encoded"))


@register
def quality_summary(spark, sf_dir):
    return quality.quality_summary(quality.quality_report(typed_raw(spark, sf_dir)))


# Encoding, split and scaling.


@register
def one_hot(spark, sf_dir):
    return encoding.one_hot(cleaned(spark, sf_dir))


def _coded(df, values):
    return dictionary.label_encode(df, values).withColumns({c: F.col(c).cast("int") for c in values.sizes})


@register
def label_encode(spark, sf_dir):
    unique = cleaning.drop_duplicates(raw(spark, sf_dir))
    table = materialise(unique.select(ID, *CATEGORICAL_COLUMNS, *BINARY_COLUMNS), "unique-texts")
    return _coded(table, dictionary.fit_values(table))


@register
def label_encode_apply(spark, sf_dir):
    """Codes fitted on learners younger than 20, applied to all of them."""
    table = raw(spark, sf_dir).select(ID, "Age", *CATEGORICAL_COLUMNS, *BINARY_COLUMNS)
    return _coded(table, dictionary.fit_values(table.where("Age < '20'").drop("Age")))


def order_texts(spark, sf_dir):
    """Two columns of all orders with nearly as many values as rows, and two with a few."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey", "CAST(o_custkey AS STRING) AS customer",
        "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) AS price",
        "o_orderstatus AS status", "o_orderpriority AS priority")


def order_values(table):
    return dictionary.fit_values(table.where("priority <> '1-URGENT'").drop("o_orderkey"))


@register
def label_encode_orders(spark, sf_dir):
    """Codes fitted on the orders that are not urgent, applied to all of them."""
    table = order_texts(spark, sf_dir)
    return dictionary.label_encode(table, order_values(table))


@register
def one_hot_sparse(spark, sf_dir):
    """A row for each order and one-hot place that it holds."""
    table = order_texts(spark, sf_dir)
    places = dictionary.one_hot_places(table, order_values(table))
    return places.select("o_orderkey", F.explode("places").alias("place"))


@register
def select_features(spark, sf_dir):
    return encoding.select_features(encoded(spark, sf_dir))


def split_features(spark, sf_dir):
    table = encoding.select_features(encoded(spark, sf_dir))
    return splitting.stratified_split(table)


@register
def stratified_split(spark, sf_dir):
    return split_features(spark, sf_dir).select(ID, TARGET, "split")


@register
def standard_scale(spark, sf_dir):
    table = split_features(spark, sf_dir)
    scaling = encoding.fit_scaling(table.where("split = 'train'"))
    scaled = encoding.standard_scale(table, scaling)
    return scaled.selectExpr(
        ID, "split", *[f"{half_even(c, 6)} AS {c}" for c in scaling.mean]
    )


# Sources, sinks and the data pipeline: write, read back, compare.


@register
def load_raw(spark, sf_dir):
    path = writers.save_csv(raw(spark, sf_dir), new_path(spark, "raw_csv"))
    return readers.load_raw(spark, path)


@register
def load_upload(spark, sf_dir):
    """Two kinds of files in one folder: columns in their order, and in reverse."""
    path, table = new_path(spark, "upload_csv"), raw(spark, sf_dir)
    writers.save_csv(table.where(f"{ID} % 2 = 0"), f"{path}/forward")
    writers.save_csv(table.where(f"{ID} % 2 = 1").select(*reversed(table.columns)), f"{path}/reverse")
    return scoring.rename_for_scoring(readers.load_upload(spark, f"{path}/*"))


@register
def save_processed(spark, sf_dir):
    path = writers.save_processed(encoded(spark, sf_dir), new_path(spark, "processed"))
    return spark.read.parquet(path)


@register
def save_features(spark, sf_dir):
    path = writers.save_features(featured(spark, sf_dir), new_path(spark, "feature_table"))
    return spark.read.parquet(path)


def ml_dataset(spark, sf_dir):
    path = new_path(spark, "ml_dataset")
    return data_pipeline.build_ml_dataset(encoded(spark, sf_dir), path), path


def _rounded(df):
    """Scaled columns to six decimals, as engines add up floats in different orders."""
    return df.withColumns({c: F.expr(half_even(c, 6)) for c in SCALED_COLUMNS})


@register
def save_ml_datasets(spark, sf_dir):
    _, path = ml_dataset(spark, sf_dir)
    return _rounded(spark.read.parquet(path))


@register
def build_ml_dataset(spark, sf_dir):
    dataset, _ = ml_dataset(spark, sf_dir)
    return _rounded(dataset.rows).groupBy("split", TARGET).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(half_even(f"avg({c})", 4)).alias(f"avg_{c}") for c in FEATURE_COLUMNS],
    )


@register
def load_ml_datasets(spark, sf_dir):
    _, path = ml_dataset(spark, sf_dir)
    train, test = readers.load_ml_datasets(spark, path)
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return _rounded(parts)


@register
def save_quality_report(spark, sf_dir):
    report = quality.quality_report(typed_raw(spark, sf_dir))
    return spark.read.json(writers.save_quality_report(report, new_path(spark, "quality_json")))


@register
def save_eda_report(spark, sf_dir):
    report = profiling.eda_report(stored_features(spark, sf_dir))
    return spark.read.json(writers.save_eda_report(report, new_path(spark, "eda_json")))


@register
def run_etl(spark, sf_dir):
    return data_pipeline.run_etl(raw(spark, sf_dir), new_path(spark, "etl"))


@register
def data_pipeline_summary(spark, sf_dir):
    table = raw(spark, sf_dir)
    results = data_pipeline.run_data_pipeline(table, new_path(spark, "data_pipeline"))
    return data_pipeline.pipeline_summary(table, results)


QUERIES["data_pipeline"] = QUERIES.pop("data_pipeline_summary")


# Metrics and comparison, on predictions made by plain rules so that SQL can check them.


def rule_predictions(spark, sf_dir):
    """Four rules as models: always the majority, and three scores against one half."""
    table = stored_features(spark, sf_dir)
    majority = models.majority_class(table)
    rules = {
        "baseline_majority": f"double({majority})",
        "combined_risk": "combined_risk_score",
        "final_grade": half_even("(20 - Final_Grade) / 20", 3),
        "absences": half_even("Number_of_Absences / 32", 3),
    }
    cells = ", ".join(f"'{name}', {text}" for name, text in rules.items())
    return table.selectExpr(
        ID, f"{TARGET} AS label", f"stack({len(rules)}, {cells}) AS (model, score)"
    ).withColumn("prediction", F.expr(scoring.score_decision()))


def rule_runs(spark, sf_dir):
    measured = metrics.classification_metrics(rule_predictions(spark, sf_dir))
    return measured.selectExpr(
        "*", "CAST(NULL AS DOUBLE) AS train_time_s", "CAST(NULL AS DOUBLE) AS inference_time_ms",
        "model AS run_id",
    )


def compared(spark, sf_dir):
    return comparison.composite_score(comparison.comparison_table(rule_runs(spark, sf_dir)))


@register
def baseline_majority(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    return models.predict(models.baseline_majority(table), table)


@register
def balanced_weights(spark, sf_dir):
    return models.balanced_weights(stored_features(spark, sf_dir)).select(ID, TARGET, models.WEIGHT)


@register
def classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(rule_predictions(spark, sf_dir))


@register
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(rule_predictions(spark, sf_dir))


@register
def class_report(spark, sf_dir):
    return metrics.class_report(rule_predictions(spark, sf_dir))


@register
def comparison_table(spark, sf_dir):
    return comparison.comparison_table(rule_runs(spark, sf_dir))


@register
def composite_score(spark, sf_dir):
    return compared(spark, sf_dir)


@register
def select_best(spark, sf_dir):
    return comparison.select_best(compared(spark, sf_dir))


@register
def save_comparison_report(spark, sf_dir):
    table = compared(spark, sf_dir)
    best = comparison.select_best(table).select("model", "justification")
    report = table.join(F.broadcast(best), "model", "left")
    path = writers.save_comparison_report(report, new_path(spark, "comparison_csv"))
    return spark.read.schema(report.schema).option("header", True).csv(path)


# Scoring steps, on the combined risk as the probability.


@register
def rename_for_scoring(spark, sf_dir):
    return scoring.rename_for_scoring(raw(spark, sf_dir))


@register
def require_columns(spark, sf_dir):
    upload = scoring.rename_for_scoring(raw(spark, sf_dir).drop("Travel_Time", "Grade_2"))
    return scoring.required_columns_report(upload)


def narrow_upload(spark, sf_dir):
    """An upload with the required columns and a few optional ones only."""
    optional = ("Family_Relationship", "Mother_Job", "Internet_Access", "Health_Status")
    needed = [scoring._BY_FIELD[f][0] for f in UPLOAD_FIELDS]
    return raw(spark, sf_dir).select(ID, *needed, *optional)


@register
def default_fields(spark, sf_dir):
    upload = scoring.rename_for_scoring(narrow_upload(spark, sf_dir))
    return scoring.default_fields(upload)


@register
def to_model_columns(spark, sf_dir):
    upload = scoring.rename_for_scoring(raw(spark, sf_dir))
    return scoring.to_model_columns(scoring.default_fields(upload))


@register
def align_columns(spark, sf_dir):
    wanted = ["Final_Grade", "Age", "Dropped_Out", "Attendance", "School_GP"]
    return scoring.align_columns(cleaned(spark, sf_dir), wanted)


def risk_scored(spark, sf_dir):
    upload = scoring.rename_for_scoring(stored_features(spark, sf_dir))
    return upload.withColumn("score", F.col("combined_risk_score"))


@register
def score_decision(spark, sf_dir):
    return risk_scored(spark, sf_dir).selectExpr(
        ID, "score", f"{scoring.score_decision()} AS prediction")


@register
def confidence_band(spark, sf_dir):
    return risk_scored(spark, sf_dir).selectExpr(
        ID, "score", f"{scoring.confidence_band()} AS confidence")


@register
def score_display(spark, sf_dir):
    return scoring.score_display(risk_scored(spark, sf_dir))


@register
def score_limit(spark, sf_dir):
    return scoring.score_display(scoring.score_limit(risk_scored(spark, sf_dir), 100))


@register
def at_risk_filter(spark, sf_dir):
    return scoring.at_risk_filter(
        risk_scored(spark, sf_dir), min_age=16, max_age=21, school="GP", min_probability=0.6)


@register
def export_results(spark, sf_dir):
    report = scoring.at_risk_filter(risk_scored(spark, sf_dir))
    path = writers.export_results(report, new_path(spark, "at_risk_csv"))
    return spark.read.schema(report.schema).option("header", True).csv(path)


# Trained models. Each model is trained once per application and data folder.

_datasets: dict[tuple[str, str], str] = {}
_runs: dict[tuple[str, str, str], models.Run] = {}
_served: dict[tuple[str, str], PipelineModel] = {}
_summaries: dict[tuple[str, str], DataFrame] = {}


def _key(spark, sf_dir):
    return spark.sparkContext.applicationId, sf_dir


def stored_dataset(spark, sf_dir):
    key = _key(spark, sf_dir)
    if key not in _datasets:
        _datasets[key] = ml_dataset(spark, sf_dir)[1]
    return _datasets[key]


def trained(spark, sf_dir, name):
    key = (*_key(spark, sf_dir), name)
    if key not in _runs:
        train, test = readers.load_ml_datasets(spark, stored_dataset(spark, sf_dir))
        _runs[key] = models.train_single(name, train, test)
    return _runs[key]


def all_trained(spark, sf_dir):
    """Those that no query has trained yet, side by side."""
    key = _key(spark, sf_dir)
    missing = {name: settings for name, settings in MODELS.items() if (*key, name) not in _runs}
    if missing:
        train, test = readers.load_ml_datasets(spark, stored_dataset(spark, sf_dir))
        _runs.update({(*key, run.name): run for run in models.train_all(train, test, missing)})
    return [_runs[(*key, name)] for name in MODELS]


def test_predictions(spark, sf_dir, name):
    return trained(spark, sf_dir, name).scored


@register
def train_logreg(spark, sf_dir):
    return test_predictions(spark, sf_dir, "logistic_regression")


@register
def train_rf_v1(spark, sf_dir):
    return test_predictions(spark, sf_dir, "random_forest_v1")


@register
def train_rf_v2(spark, sf_dir):
    return test_predictions(spark, sf_dir, "random_forest_v2")


@register
def train_gbt(spark, sf_dir):
    return test_predictions(spark, sf_dir, "gradient_boosting")


@register
def train_gbt_subsampled(spark, sf_dir):
    return test_predictions(spark, sf_dir, "xgboost")


@register
def train_single(spark, sf_dir):
    return models.runs_table(spark, [trained(spark, sf_dir, "random_forest_v1")])


@register
def train_all(spark, sf_dir):
    return models.runs_table(spark, all_trained(spark, sf_dir))


@register
def feature_importance(spark, sf_dir):
    return models.importance_table(spark, all_trained(spark, sf_dir))


@register
def validate_model(spark, sf_dir):
    _, test = readers.load_ml_datasets(spark, stored_dataset(spark, sf_dir))
    return validation.validation_report(trained(spark, sf_dir, "random_forest_v1").model, test)


@register
def save_validation_report(spark, sf_dir):
    report = validate_model(spark, sf_dir)
    return spark.read.schema(report.schema).json(
        writers.save_validation_report(report, new_path(spark, "validation_json")))


@register
def model_registry(spark, sf_dir):
    folder = new_path(spark, "registry")
    for run in all_trained(spark, sf_dir):
        model_versions.register_model(spark, folder, run)
    model_versions.production_model(spark, folder)
    return model_versions.registry_table(spark, folder)


@register
def ml_pipeline_summary(spark, sf_dir):
    results = ml_pipeline.run_ml_pipeline(
        spark, stored_dataset(spark, sf_dir), new_path(spark, "ml_pipeline"))
    summary = materialise(ml_pipeline.pipeline_summary(spark, results), "ml_summary")
    _summaries[_key(spark, sf_dir)] = summary
    return summary


QUERIES["ml_pipeline"] = QUERIES.pop("ml_pipeline_summary")


_served_rows: dict[tuple[str, str], DataFrame] = {}


def served_rows(spark, sf_dir):
    """Training input of the served model: unique rows, numbers and target read, text kept; stored once per application."""
    key = _key(spark, sf_dir)
    if key not in _served_rows:
        unique = cleaning.drop_duplicates(cleaning.trim_columns(raw(spark, sf_dir)))
        rows = unique.transform(cleaning.normalise_target).transform(cleaning.coerce_numeric)
        _served_rows[key] = splitting.stratified_split(materialise(rows, "served_rows"))
    return _served_rows[key]


def served_model(spark, sf_dir):
    key = _key(spark, sf_dir)
    if key not in _served:
        train = served_rows(spark, sf_dir).where("split = 'train'")
        path = new_path(spark, "served_model")
        models.train_raw_balanced(train).write().save(path)
        _served[key] = PipelineModel.load(path)
    return _served[key]


_prepared: dict[tuple[str, str], str] = {}


def prepared_folder(spark, sf_dir):
    """A run of the data pipeline, and a logistic model of its rows in production: once per application."""
    key = _key(spark, sf_dir)
    if key not in _prepared:
        folder = new_path(spark, "prepared")
        results = data_pipeline.run_data_pipeline(raw(spark, sf_dir), folder)
        few = {name: MODELS[name] for name in ("baseline_majority", "logistic_regression")}
        ml_pipeline.run_ml_pipeline(spark, f"{folder}/ml", folder, few, state=results["state"])
        _prepared[key] = folder
    return _prepared[key]


@register
def prepare_registered(spark, sf_dir):
    """All raw rows, copies as well, as the inputs of the model in production."""
    _, state = model_versions.production_state(spark, f"{prepared_folder(spark, sf_dir)}/registry")
    return _rounded(fitted.prepare(raw(spark, sf_dir), state))


@register
def score_registered(spark, sf_dir):
    return ml_pipeline.score_registered(spark, prepared_folder(spark, sf_dir), raw(spark, sf_dir))


@register
def train_raw_balanced(spark, sf_dir):
    test = served_rows(spark, sf_dir).where("split = 'test'")
    return models.predictions(served_model(spark, sf_dir), "raw_balanced", test)


@register
def score_batch(spark, sf_dir):
    return scoring.score_batch(served_model(spark, sf_dir), raw(spark, sf_dir))


@register
def score_stream(spark, sf_dir):
    uploads = new_path(spark, "upload_folder")
    writers.save_csv(raw(spark, sf_dir).select(*readers.RAW_SCHEMA.names), uploads)
    sink = new_path(spark, "scored")
    query = streamed.score_stream(
        served_model(spark, sf_dir), readers.stream_uploads(spark, uploads), sink,
        new_path(spark, "scored_checkpoint"))
    query.awaitTermination()
    return spark.read.parquet(sink)


def uploads_scored(spark, sf_dir):
    """Uploads of two kinds in one stream: columns in their order, and in reverse."""
    table, path, folder = raw(spark, sf_dir).select(*readers.RAW_SCHEMA.names), new_path(spark, "uploads"), new_path(spark, "uploads_scored")
    writers.save_csv(table.where(f"{ID} % 2 = 0"), f"{path}/forward")
    writers.save_csv(table.where(f"{ID} % 2 = 1").select(*reversed(table.columns)), f"{path}/reverse")
    streamed.score_uploads(served_model(spark, sf_dir), spark, f"{path}/*", folder).awaitTermination()
    return folder


@register
def score_uploads(spark, sf_dir):
    return streamed.scored_uploads(spark, uploads_scored(spark, sf_dir))


# What can be said of trained results beforehand, for a comparison with SQL.


FLOOR = 0.7


def _flags(scored: DataFrame) -> DataFrame:
    return scored.selectExpr(
        ID, "label", "prediction = int(score > 0.5D) AS consistent", "score BETWEEN 0 AND 1 AS bounded")


def _checked(name: str) -> None:
    query = QUERIES[name]
    QUERIES[f"{name}_checked"] = lambda spark, sf_dir: _flags(query(spark, sf_dir))


for _name in ("train_logreg", "train_rf_v1", "train_rf_v2", "train_gbt", "train_gbt_subsampled", "train_raw_balanced"):
    _checked(_name)


def _responses(scored: DataFrame) -> DataFrame:
    return scored.selectExpr(
        ID, "prediction = int(probability > 0.5D) AS consistent", "probability BETWEEN 0 AND 1 AS bounded")


@register
def score_batch_checked(spark, sf_dir):
    return _responses(score_batch(spark, sf_dir))


@register
def score_registered_checked(spark, sf_dir):
    return _responses(score_registered(spark, sf_dir))


@register
def score_stream_checked(spark, sf_dir):
    return _responses(score_stream(spark, sf_dir))


@register
def score_uploads_checked(spark, sf_dir):
    return _responses(score_uploads(spark, sf_dir))


@register
def train_single_checked(spark, sf_dir):
    return train_single(spark, sf_dir).selectExpr("model", f"roc_auc > {FLOOR}D AS above_floor")


@register
def train_all_checked(spark, sf_dir):
    return train_all(spark, sf_dir).selectExpr(
        "model", f"roc_auc > {FLOOR}D AS above_floor", "accuracy BETWEEN 0 AND 1 AS bounded")


@register
def feature_importance_checked(spark, sf_dir):
    """The importances of trees add up to one; coefficients have no fixed sum."""
    return feature_importance(spark, sf_dir).selectExpr(
        "model", "feature", "importance >= 0 AS bounded",
        "model = 'logistic_regression' OR abs(sum(importance) OVER (PARTITION BY model) - 1) < 0.001D AS adds_up")


def _outcomes(checks: DataFrame) -> DataFrame:
    """Whether fifty shifted rows change a prediction depends on the data; the other outcomes do not."""
    return checks.selectExpr(
        "section", "item", "stat", "CASE WHEN item <> 'sensitivity' THEN passed END AS passed",
        "CASE WHEN stat = 'support' THEN value END AS support")


@register
def validate_model_checked(spark, sf_dir):
    return _outcomes(validate_model(spark, sf_dir))


@register
def save_validation_report_checked(spark, sf_dir):
    return _outcomes(save_validation_report(spark, sf_dir))


@register
def model_registry_checked(spark, sf_dir):
    return model_registry(spark, sf_dir).select("registry_name", "version", "model_name", "stage")


@register
def ml_pipeline_checked(spark, sf_dir):
    """The summary of this application's run, where there was one: a run trains every model."""
    summary = _summaries.get(_key(spark, sf_dir))
    if summary is None:
        summary = QUERIES["ml_pipeline"](spark, sf_dir)
    return summary.selectExpr(
        "models_trained", "best_model <> 'baseline_majority' AS beats_majority", f"roc_auc > {FLOOR}D AS above_floor",
        "checks_total", "registry_name", "version", "stage")


# Segments, drift, activity and cohort comparison.


def segmented(spark, sf_dir):
    rows = spark.read.parquet(stored_dataset(spark, sf_dir))
    return segments.assign_segments(segments.fit_segments(rows.where("split = 'train'")), rows)


@register
def learner_segments(spark, sf_dir):
    return segments.segment_profile(segmented(spark, sf_dir))


@register
def segment_quality(spark, sf_dir):
    return segments.segment_quality(spark.read.parquet(stored_dataset(spark, sf_dir)))


@register
def learner_segments_checked(spark, sf_dir):
    """What does not depend on the segments: every learner is in one of them, and their means add up to those of all rows."""
    whole = segmented(spark, sf_dir)
    parts = whole.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("left"), *[F.avg(c).alias(c) for c in FEATURE_COLUMNS])
    return parts.agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("n_students"), F.sum("left").alias("n_dropped_out"),
        *[F.expr(half_even(f"sum({c} * n) / sum(n)", 4)).alias(f"avg_{c}") for c in FEATURE_COLUMNS])


@register
def segment_quality_checked(spark, sf_dir):
    """More segments lie closer to their rows; a silhouette has bounds."""
    return segment_quality(spark, sf_dir).selectExpr(
        "k", "n_segments", "silhouette BETWEEN -1 AND 1 AS bounded",
        "inertia <= first(inertia) OVER (ORDER BY k) AS no_worse_than_two")


@register
def drift_report(spark, sf_dir):
    table = stored_features(spark, sf_dir)
    return drift.drift_report(
        table.where("School = 'GP'"), table.where("School = 'MS'"),
        [*NUMERIC_COLUMNS, *FEATURE_COLUMNS])


@register
def drift_periods(spark, sf_dir):
    """The same from stored counts: a period for each school and age, in batches by gender, one of them added twice."""
    table = stored_features(spark, sf_dir)
    counts = drift.DriftCounts(spark, new_path(spark, "drift")).create(
        table.where("School = 'GP'"), [*NUMERIC_COLUMNS, *FEATURE_COLUMNS])
    for gender in ("F", "M", "F"):
        counts.add(table.where(f"Gender = '{gender}'"), "concat(School, ' ', Age)", gender)
    counts.add(table.where("Gender IS NULL OR Gender NOT IN ('F', 'M')"), "concat(School, ' ', Age)", "other")
    periods = [r["period"] for r in counts.periods().collect()]
    return counts.report(*[[p for p in periods if p.startswith(school)] for school in ("GP", "MS")])


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@register
def user_activity(spark, sf_dir):
    return activity.user_activity(events(spark, sf_dir))


@register
def activity_kpis(spark, sf_dir):
    return activity.activity_kpis(events(spark, sf_dir))


@register
def learner_kpis(spark, sf_dir):
    return activity.learner_kpis(risk_scored(spark, sf_dir).withColumnRenamed(
        "final_grade", "Final_Grade"))


@register
def activity_windows(spark, sf_dir):
    return activity.activity_windows(events(spark, sf_dir))


@register
def activity_stream(spark, sf_dir):
    """The events in files that each reach over the whole time, so that all but the first are full of late ones."""
    table, source = events(spark, sf_dir), new_path(spark, "event_files")
    table.repartition(3, "event_id").write.parquet(source)
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = new_path(spark, "activity")
    activity_streamed.activity_stream(
        arriving, sink, new_path(spark, "activity_checkpoint")).awaitTermination()
    return activity_streamed.stored_activity(spark, sink)


@register
def compare_cohorts(spark, sf_dir):
    return cohorts.compare_cohorts(stored_features(spark, sf_dir), ["School", "Gender"])
