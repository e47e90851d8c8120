"""From raw table to encoded, validated, split and scaled rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from holdfast.config import ID, SPLIT_SEED, TARGET, TEST_SHARE
from holdfast.ledger import Ledger
from holdfast.operators import cleaning, encoding, features, fitted, profiling, quality, splitting
from holdfast.sources import writers


class QualityError(RuntimeError):
    """A rule of severity "error" failed and the run was asked to be strict."""


@dataclass(frozen=True)
class MlDataset:
    """Split and scaled rows with what is needed to treat new rows alike."""

    rows: DataFrame
    split: splitting.SplitRule
    scaling: encoding.Scaling
    inputs: tuple[str, ...]


def run_etl(raw: DataFrame, path: str) -> DataFrame:
    """Clean, encode and store; no features."""
    table = encoding.one_hot(cleaning.clean(raw))
    return raw.sparkSession.read.parquet(writers.save_processed(table, path))


def build_ml_dataset(
    encoded: DataFrame, path: str, share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> MlDataset:
    """Select, split, scale on the training part's statistics, store by part."""
    table = encoding.select_features(encoded)
    rule = splitting.fit_split(table, share, seed)
    parts = splitting.stratified_split(table, rule)
    scaling = encoding.fit_scaling(parts.where("split = 'train'"))
    scaled = encoding.standard_scale(parts, scaling)
    path = writers.save_ml_datasets(scaled, path)
    return MlDataset(encoded.sparkSession.read.parquet(path), rule, scaling, tuple(encoding.feature_names(table)))


def run_data_pipeline(raw: DataFrame, folder: str, strict: bool = False) -> dict[str, object]:
    """All six stages. Each stage reads the table the one before has stored.

    A failed quality rule is only reported, unless ``strict``. What was fitted on the way is stored below
    ``folder``, for rows that come later: :func:`stored_state` reads it.
    """
    spark = raw.sparkSession
    rows = cleaning.unique_typed_rows(raw)
    # All columns, as rows to come may lack values where these do not.
    fill = cleaning.fit_cleaning(rows, every_column=True)
    clean = cleaning.apply_cleaning(rows, fill)
    extremes = features.fit_features(clean)
    table = features.apply_features(clean, extremes)
    stored = spark.read.parquet(writers.save_features(table, f"{folder}/features"))
    writers.save_eda_report(profiling.eda_report(stored), f"{folder}/eda_report")

    dictionary = encoding.fit_dictionary(stored)
    encoded = spark.read.parquet(
        writers.save_processed(encoding.one_hot(stored, dictionary), f"{folder}/encoded")
    )
    report = spark.read.json(
        writers.save_quality_report(quality.quality_report(encoded), f"{folder}/quality_report")
    )
    verdict = quality.quality_summary(report).first()
    if strict and not verdict["overall_passed"]:
        raise QualityError(f"{verdict['failed']} quality rules failed, see {folder}/quality_report")
    dataset = build_ml_dataset(encoded, f"{folder}/ml")
    state = fitted.Prepared(fill, extremes, dictionary, dataset.split, dataset.scaling, dataset.inputs)
    Ledger(spark, f"{folder}/fitted").put("state", state.to_entry())
    return {
        "features": stored, "encoded": encoded, "quality": report, "ml": dataset,
        "verdict": verdict, "state": state,
    }


def stored_state(spark: SparkSession, folder: str) -> fitted.Prepared:
    """What the data pipeline fitted when it wrote ``folder``."""
    entry = Ledger(spark, f"{folder}/fitted").get("state")
    if entry is None:
        raise LookupError(f"no fitted state in {folder}")
    return fitted.Prepared.from_entry(entry)


def pipeline_summary(raw: DataFrame, results: dict[str, object]) -> DataFrame:
    """``stage, rows, columns``: what each stage read or stored (the id not counted)."""
    parts = {
        "raw": raw,
        "features": results["features"],
        "encoded": results["encoded"],
        "train": results["ml"].rows.where("split = 'train'").drop("split", TARGET),
        "test": results["ml"].rows.where("split = 'test'").drop("split", TARGET),
    }
    counted = [
        df.selectExpr(
            f"'{name}' AS stage", "count(1) AS rows",
            f"{len([c for c in df.columns if c != ID])} AS columns",
        )
        for name, df in parts.items()
    ]
    table = counted[0]
    for more in counted[1:]:
        table = table.unionByName(more)
    return table
