"""Registered models: saved pipelines and a log of versions.

A writer claims the next number by creating a file that must not exist, and tries the one after it where another
writer was faster. The record of the version is written last, so a version is listed only once its model is there;
a number whose writer was lost stays unused.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.ledger import Ledger, claim
from holdfast.operators.fitted import Prepared
from holdfast.operators.metrics import METRICS
from holdfast.operators.models import Run

REGISTRY_NAME = "learner_dropout_classifier"
_SCHEMA = T.StructType([
    T.StructField("registry_name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    *[T.StructField(m, T.DoubleType()) for m in METRICS],
    T.StructField("justification", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("model_uri", T.StringType()),
])


def _log(spark: SparkSession, folder: str, name: str) -> Ledger:
    return Ledger(spark, f"{folder}/versions/{name}")


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).json(f"{folder}/versions/*/*.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def description_of(run: Run) -> str:
    """The kind of model with its settings, and its figures."""
    settings = ", ".join(f"{k}={v}" for k, v in run.settings.items() if k != "kind")
    figures = ", ".join(f"{m}={run.metrics[m]:.4f}" for m in METRICS if run.metrics.get(m) is not None)
    return f"{run.settings['kind']}({settings}): {figures}"


def register_model(
    spark: SparkSession,
    folder: str,
    run: Run,
    justification: str = "",
    name: str = REGISTRY_NAME,
    state: Prepared | None = None,
) -> dict:
    """Save the model, then record its version, which thereby becomes the production version.

    The record holds settings, importances, and with ``state`` all that new rows are prepared by.
    """
    uri = f"{folder}/models/{name}/{run.run_id}"
    run.model.write().overwrite().save(uri)
    log = _log(spark, folder, name)
    version = max([int(n) for n in log.names()], default=0) + 1
    while not claim(spark, f"{folder}/claims/{name}/{version}"):
        version += 1
    metrics = [run.metrics.get(m) for m in METRICS]
    row = (name, version, run.run_id, run.name, *metrics, justification, description_of(run), uri)
    entry = dict(zip(_SCHEMA.names, row))
    log.put(str(version), {
        **entry, "settings": run.settings, "importance": run.importance, "registered_at": time.time(),
        "train_time_s": run.metrics.get("train_time_s"), "state": state.to_entry() if state else None,
    })
    return dict(entry, stage="Production")


def registry_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every version with its stage: the latest of a name is in production, others archived."""
    latest = Window.partitionBy("registry_name")
    return _versions(spark, folder).withColumn("latest", F.max("version").over(latest)).selectExpr(
        *_SCHEMA.names,
        "CASE WHEN version = latest THEN 'Production' ELSE 'Archived' END AS stage",
    )


def version_record(
    spark: SparkSession, folder: str, name: str = REGISTRY_NAME, version: int | None = None
) -> Mapping:
    """The whole record of a version, the one in production if none is given."""
    log = _log(spark, folder, name)
    version = version or max([int(n) for n in log.names()], default=None)
    record = log.get(str(version)) if version else None
    if record is None:
        raise LookupError(f"no version {version or 'in production'} of {name} in {folder}")
    return record


def production_model(
    spark: SparkSession, folder: str, name: str = REGISTRY_NAME
) -> PipelineModel:
    """The model of the latest version."""
    return PipelineModel.load(version_record(spark, folder, name)["model_uri"])


def production_state(spark: SparkSession, folder: str, name: str = REGISTRY_NAME) -> tuple[PipelineModel, Prepared]:
    """The model of the latest version, and what its rows are prepared by."""
    record = version_record(spark, folder, name)
    if not record.get("state"):
        raise LookupError(f"version {record['version']} of {name} was registered without fitted state")
    return PipelineModel.load(record["model_uri"]), Prepared.from_entry(record["state"])
