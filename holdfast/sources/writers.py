"""Writing tables, data sets and reports. Every writer overwrites its folder and returns it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from holdfast.config import ID, TARGET

#: Longest generated method, in bytes, that the JVM compiles; a longer one is interpreted for every row.
COMPILED_METHOD = 8000
METHOD_LIMIT, METHOD_LIMIT_UNSET = "spark.sql.codegen.hugeMethodLimit", "65535"


@contextmanager
def wide_steps_compiled(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, steps whose one generated method would not be compiled run operator by operator.

    A limit that the session's owner has chosen stays.
    """
    if spark.conf.get(METHOD_LIMIT, METHOD_LIMIT_UNSET) != METHOD_LIMIT_UNSET:
        yield
        return
    spark.conf.set(METHOD_LIMIT, str(COMPILED_METHOD))
    try:
        yield
    finally:
        spark.conf.unset(METHOD_LIMIT)


def save_table(df: DataFrame, path: str) -> str:
    """Parquet, for cleaned, encoded and feature tables."""
    with wide_steps_compiled(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return path


save_processed = save_features = save_table


def save_ml_datasets(df: DataFrame, path: str) -> str:
    """Split rows as one table with a folder per part; inputs and targets are selections of it."""
    with wide_steps_compiled(df.sparkSession):
        df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def inputs_of(df: DataFrame) -> DataFrame:
    return df.drop(TARGET)


def targets_of(df: DataFrame) -> DataFrame:
    return df.select(ID, TARGET)


def save_report(df: DataFrame, path: str) -> str:
    """JSON lines, for quality, profile and validation reports."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


save_quality_report = save_report
save_eda_report = save_report
save_validation_report = save_report


def save_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, for comparison tables and exported scores."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


save_comparison_report = save_csv
export_results = save_csv
