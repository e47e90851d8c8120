"""Scoring of requests as they arrive in a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from holdfast.operators.scoring import (
    decide,
    default_fields,
    rename_for_scoring,
    score_requests,
    upload_spellings,
)
from holdfast.sources.readers import REJECTED, read_files, stream_files


def scored_stream(model: PipelineModel, uploads: DataFrame) -> DataFrame:
    """A stream of uploaded rows to a stream of responses; keeps no state."""
    return decide(
        score_requests(model, uploads.transform(rename_for_scoring).transform(default_fields))
    )


def score_stream(
    model: PipelineModel, uploads: DataFrame, sink: str, checkpoint: str
) -> StreamingQuery:
    """Score everything that is there now, each file exactly once across restarts."""
    return (
        scored_stream(model, uploads)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_uploads(
    model: PipelineModel, spark: SparkSession, uploads: str, folder: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Score the files that have arrived in ``uploads`` and not been scored into ``folder`` before.

    Every file goes by its own header, whatever the others have: columns in any order, source or request names, optional ones absent (then
    the request's defaults hold). Files and rows that cannot be read do not stop the stream; :func:`rejected_uploads`
    tells them with the reason. A batch that is repeated after a failure replaces what it wrote.
    """
    def score(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # At most files_per_batch paths. Spark lists a file twice where another one has a name like a pattern.
        paths = sorted({r["path"] for r in batch.collect()})
        tables, rejected = read_files(session, paths, upload_spellings())
        rejected.write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        if tables:
            requests = reduce(DataFrame.unionByName, [default_fields(rename_for_scoring(t)) for t in tables])
            decide(score_requests(model, requests)).write.mode("overwrite").parquet(f"{folder}/scored/batch={number}")

    return (
        stream_files(spark, uploads, files_per_batch)
        .writeStream.foreachBatch(score)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def scored_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """The responses that are stored in ``folder``; there must be some."""
    return spark.read.parquet(f"{folder}/scored").drop("batch")


def rejected_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """``file, reason, record, batch`` of what could not be read."""
    return spark.read.schema(f"{REJECTED}, batch bigint").parquet(f"{folder}/rejected")
