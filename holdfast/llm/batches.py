"""Small helpers for functions that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of an Arrow batch where rows may be long: Spark's 10,000 are held several times over by every task.
ROWS_SETTING, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, tasks hand over at most ``ROWS`` rows at a time; a smaller number chosen by the session's owner stays."""
    before = spark.conf.get(ROWS_SETTING)
    if 0 < int(before) <= ROWS:
        yield
        return
    spark.conf.set(ROWS_SETTING, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(ROWS_SETTING, before)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of ``column``; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, length in enumerate(lengths):
            if held and held + length > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if len(lengths) > start:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python texts; null counts as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


def extended(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch with columns added or replaced, cast to ``schema``."""
    arrays = []
    for field in schema:
        if field.name in columns:
            arrays.append(pa.array(columns[field.name], type=field.type))
        else:
            arrays.append(batch.column(field.name).cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
