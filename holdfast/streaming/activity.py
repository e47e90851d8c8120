"""Activity per time window as events arrive in a folder.

Counts of open windows are the state of the stream: each batch adds its own counts to them. The watermark is the latest
event time of the batches before, less an allowed delay. Windows that end at or before it are closed: they move to a table
that only grows by closed windows, and the state keeps the others, so it is bounded by the delay and not by how long the stream has
run. Events of closed windows are late; their counts go to a side table, and reading adds them back. Nothing is
dropped, and reading costs a row per window, type and batch with late events instead of a row per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.ledger import Ledger
from holdfast.operators.activity import window_bounds

DELAY_SECONDS = 6 * 3600
_COUNTS = "start bigint, end bigint, event_type string, n bigint"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, folder: str) -> DataFrame:
    """A repeated batch writes the same folder again."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _add_batch(events: DataFrame, batch: int, sink: str, delay: int) -> None:
    spark = events.sparkSession
    ledger = Ledger(spark, f"{sink}/ledger")
    state = ledger.get("state") or {"batch": -1, "watermark": None, "highest": None}
    if batch <= state["batch"]:
        return
    counts = _write(
        events.groupBy("start", "end", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")),
        f"{sink}/counts/batch={batch}")
    watermark = state["watermark"]
    late = F.col("end") <= F.lit(watermark) if watermark is not None else F.lit(False)
    _write(counts.where(late).drop("last"), f"{sink}/late/batch={batch}")
    held = counts.where(~late).drop("last")
    if state["batch"] >= 0:
        held = held.unionByName(spark.read.schema(_COUNTS).parquet(f"{sink}/open/batch={state['batch']}"))
    held = held.groupBy("start", "end", "event_type").agg(F.sum("n").alias("n"))
    highest = max((x for x in (state["highest"], counts.agg(F.max("last")).first()[0]) if x is not None), default=None)
    passed = highest - delay * 1_000_000 if highest is not None else None
    closes = F.col("end") <= F.lit(passed) if passed is not None else F.lit(False)
    _write(held.where(closes), f"{sink}/closed/batch={batch}")
    _write(held.where(~closes), f"{sink}/open/batch={batch}")
    ledger.put("state", {"batch": batch, "watermark": passed, "highest": highest})
    _remove(spark, f"{sink}/counts/batch={batch}")
    if state["batch"] >= 0:
        _remove(spark, f"{sink}/open/batch={state['batch']}")


def activity_stream(
    events: DataFrame, sink: str, checkpoint: str, width: str = "1 hour", delay_seconds: int = DELAY_SECONDS
) -> StreamingQuery:
    """Add every event that is there now to the windows below ``sink``.

    A batch counts once: the ledger names the last one that was added, and a repeated batch overwrites what the first
    attempt left.
    """
    return (
        window_bounds(events, width)
        .writeStream.foreachBatch(lambda batch, number: _add_batch(batch, number, sink, delay_seconds))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_windows(spark: SparkSession, sink: str) -> DataFrame:
    """``part, start, end, event_type, n``: rows of the closed and open windows and of late events."""
    state = Ledger(spark, f"{sink}/ledger").get("state")
    empty = spark.createDataFrame([], f"part string, {_COUNTS}")
    if state is None:
        return empty
    parts = [spark.read.schema(_COUNTS).parquet(f"{sink}/open/batch={state['batch']}").selectExpr("'open' AS part", "*")]
    for part in ("closed", "late"):
        rows = spark.read.schema(f"{_COUNTS}, batch bigint").parquet(f"{sink}/{part}").where(F.col("batch") <= state["batch"])
        parts.append(rows.drop("batch").selectExpr(f"'{part}' AS part", "*"))
    for rows in parts:
        empty = empty.unionByName(rows)
    return empty


def stored_activity(spark: SparkSession, sink: str) -> DataFrame:
    """Events per type and window over all that the stream has added so far."""
    return stored_windows(spark, sink).groupBy(
        F.date_format(F.timestamp_micros("start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type"
    ).agg(F.sum("n").alias("n_events"))
