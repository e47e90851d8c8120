"""Checks a model must pass before it is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import ID, MODEL_CHECKS, SENSITIVITY_ROWS, TARGET
from holdfast.operators.encoding import feature_names
from holdfast.operators.metrics import class_report, confusion_matrix
from holdfast.operators.models import predictions
from holdfast.workspace import materialise


def _scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``id, prediction, chances``: the predicted class and the probability of each class."""
    scored = model.transform(rows)
    if "probability" in scored.columns:
        chances = vector_to_array("probability")
    else:
        chances = F.array(F.lit(1.0) - F.col("score"), F.col("score"))
    return scored.select(ID, "prediction", chances.alias("chances"))


def validate_model(model: PipelineModel, test: DataFrame) -> DataFrame:
    """``check, test, passed, details``: one row for each of the seven checks.

    Reading the test rows twice and comparing a checksum over id and prediction tells whether
    predictions repeat, without joining the two results.
    """
    spark = test.sparkSession
    checksum = F.expr("sum(CAST(xxhash64(student_id, prediction) AS DECIMAL(20, 0)))")

    def summary() -> tuple:
        scored = _scored(model, test)
        return scored.select(
            F.count(F.lit(1)).alias("n"),
            checksum.alias("checksum"),
            F.expr("count_if(prediction IS NULL OR isnan(prediction))").alias("nan"),
            F.expr("count_if(abs(prediction) = double('Infinity'))").alias("inf"),
            F.expr("sort_array(collect_set(CASE WHEN prediction NOT IN (0, 1) THEN -1 "
                   "ELSE int(prediction) END))").alias("classes"),
            F.expr("count_if(exists(chances, c -> c IS NULL OR isnan(c) OR c < 0 OR c > 1) "
                   "OR abs(aggregate(chances, 0D, (s, c) -> s + c) - 1D) > 1e-5D)").alias("odd"),
        ).first()

    first, second, size = summary(), summary(), test.count()
    classes = list(first["classes"])
    results = {
        "finite": (not first["nan"] and not first["inf"],
                   f"nan={bool(first['nan'])}, inf={bool(first['inf'])}"),
        "repeatable": (first["checksum"] == second["checksum"], ""),
        "classes": (-1 not in classes, f"classes={classes}"),
        "single_row": _attempt(lambda: _single_row(model, test)),
        "size": (first["n"] == size, f"{first['n']} vs {size}"),
        "probability": (first["odd"] == 0, f"{first['odd']}"),
        "sensitivity": _sensitivity(model, test),
    }
    rows = [(name, MODEL_CHECKS[name], *results[name]) for name in MODEL_CHECKS]
    return spark.createDataFrame(rows, "check string, test string, passed boolean, details string")


def validation_report(model: PipelineModel, test: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """``section, item, stat, value, passed, details``: the checks, the figures per class, and the confusion matrix.

    ``checks`` already made of this model on these rows are taken instead of making them again.
    """
    if checks is None:
        checks = validate_model(model, test)
    checks = checks.selectExpr(
        "'check' AS section", "check AS item", "test AS stat", "CAST(NULL AS DOUBLE) AS value", "passed", "details")
    scored = materialise(predictions(model, "model", test), "validated")
    figures = ", ".join(f"'{c}', double({c})" for c in ("precision", "recall", "f1", "support"))
    unjudged = ("CAST(NULL AS BOOLEAN) AS passed", "CAST(NULL AS STRING) AS details")
    classes = class_report(scored).selectExpr(
        "'class_report' AS section", "class AS item", f"stack(4, {figures}) AS (stat, value)").selectExpr("*", *unjudged)
    cells = confusion_matrix(scored).selectExpr(
        "'confusion_matrix' AS section", "concat_ws('|', label, prediction) AS item", "'count' AS stat",
        "double(count) AS value", *unjudged)
    return checks.unionByName(classes).unionByName(cells)


def _attempt(check: Callable[[], tuple[bool, str]]) -> tuple[bool, str]:
    try:
        return check()
    except Exception as error:  # a model that cannot score one row fails the check, not the run
        return False, str(error)


def _single_row(model: PipelineModel, test: DataFrame) -> tuple[bool, str]:
    return _scored(model, test.orderBy(ID).limit(1)).count() == 1, ""


def _sensitivity(model: PipelineModel, test: DataFrame) -> tuple[bool, str]:
    """Whether moving the first numeric input by two deviations changes a prediction.

    Looks at the first fifty rows by id, which is what the check is defined on.
    """
    kinds = {f.name: f.dataType for f in test.schema.fields}
    numeric = [
        c for c in feature_names(test) if isinstance(kinds[c], T.NumericType) and c != TARGET
    ]
    if not numeric:
        return True, "no numeric input"
    moved = numeric[0]
    sample = test.orderBy(ID).limit(SENSITIVITY_ROWS)
    spread = sample.select(F.stddev_samp(moved)).first()[0] or 0.0
    shifted = sample.withColumn(moved, F.col(moved) + F.lit(2 * spread))
    before = _scored(model, sample).select(ID, F.col("prediction").alias("before"))
    after = _scored(model, shifted).select(ID, F.col("prediction").alias("after"))
    changed = before.join(after, ID).where("before <> after").count()
    return changed > 0, f"{changed}/{SENSITIVITY_ROWS}"


def validation_summary(checks: DataFrame) -> DataFrame:
    """``n_passed, n_total, all_passed``."""
    return checks.selectExpr(
        "count_if(passed) AS n_passed", "count(1) AS n_total", "count_if(NOT passed) = 0 AS all_passed"
    )
