"""From stored training rows to a registered production model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import MODELS
from holdfast.operators import comparison, fitted, models, registry, scoring, validation
from holdfast.operators.fitted import Prepared
from holdfast.sources import readers, writers
from holdfast.workspace import materialise


class ValidationError(RuntimeError):
    """The selected model failed a check and the run was asked to be strict."""


def run_ml_pipeline(
    spark: SparkSession,
    dataset: str,
    folder: str,
    model_table: Mapping[str, Mapping] = MODELS,
    strict: bool = False,
    runs: Sequence[models.Run] | None = None,
    state: Prepared | None = None,
) -> dict[str, object]:
    """Train, compare, validate and register. Failed checks only show, unless ``strict``.

    Finished models are recorded below ``folder``: a run that broke off goes on from there. ``runs`` already trained
    on this data set are taken instead of training again. ``state``, what the data set was prepared by, is
    registered with the model, so that later rows can be scored. The summary is stored as well.
    """
    train, test = readers.load_ml_datasets(spark, dataset)
    if runs is None:
        runs = models.train_all(train, test, model_table, folder=f"{folder}/runs")
    if not runs:
        raise RuntimeError("no model could be trained")
    table = comparison.composite_score(
        comparison.comparison_table(models.runs_table(spark, runs))
    )
    best = comparison.select_best(table).first()
    chosen = next(run for run in runs if run.name == best["model"])
    writers.save_comparison_report(
        table.withColumn(
            "justification",
            F.when(F.col("model") == best["model"], F.lit(best["justification"])),
        ),
        f"{folder}/comparison",
    )
    checks = validation.validate_model(chosen.model, test)
    writers.save_validation_report(validation.validation_report(chosen.model, test, checks), f"{folder}/validation")
    verdict = validation.validation_summary(checks).first()
    if strict and not verdict["all_passed"]:
        raise ValidationError(f"{chosen.name} failed checks, see {folder}/validation")
    entry = registry.register_model(
        spark, f"{folder}/registry", chosen, best["justification"], state=state
    )
    results = {
        "runs": runs, "comparison": table, "best": chosen, "checks": checks,
        "verdict": verdict, "registered": entry,
    }
    writers.save_report(pipeline_summary(spark, results), f"{folder}/summary")
    return results


def score_registered(spark: SparkSession, folder: str, raw: DataFrame) -> DataFrame:
    """Raw rows to one response each, by the model in production below ``folder`` and by what it was prepared with.

    Nothing but the folder is needed, so a later session scores alike. The responses of a table are stored, as preparing
    and scoring in one step make a method too long for the JVM to compile; those of a stream are not.
    """
    model, state = registry.production_state(spark, f"{folder}/registry")
    scored = scoring.decide(models.predict(model, fitted.prepare(raw, state)))
    if raw.isStreaming:
        return scored
    with writers.wide_steps_compiled(scored.sparkSession):
        return materialise(scored, "registered_scores")


def pipeline_summary(spark: SparkSession, results: dict[str, object]) -> DataFrame:
    """One row: models trained, the best one with its figures, checks passed, version."""
    best, verdict, entry = results["best"], results["verdict"], results["registered"]
    row = (
        len(results["runs"]), best.name, best.metrics["f1"], best.metrics["roc_auc"],
        best.metrics["accuracy"], verdict["n_passed"], verdict["n_total"],
        entry["registry_name"], entry["version"], entry["stage"],
    )
    return spark.createDataFrame(
        [row],
        "models_trained int, best_model string, f1 double, roc_auc double, accuracy double, "
        "checks_passed long, checks_total long, registry_name string, version int, stage string",
    )
