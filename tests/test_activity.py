"""Windows of events that arrive in any order."""

import random

from pyspark.sql import functions as F

from holdfast.ledger import Ledger
from holdfast.operators.activity import activity_windows
from holdfast.streaming import activity as streamed

SCHEMA = "ts timestamp, user_id long, event_type string"


def files_of(spark, source, hours, draw):
    """A file of events for each hour; all events as a frame."""
    everything = []
    for hour in hours:
        rows = [(f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:{draw.randint(0, 59):02d}:00", draw.randint(1, 3), draw.choice(("view", "quiz")))
                for _ in range(draw.randint(1, 6))] + [(None, 1, "view")]
        frame = spark.createDataFrame(rows, "ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(source)
        everything.append(frame)
    return everything


def run(spark, source, sink, log, **settings):
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    streamed.activity_stream(arriving, sink, log, **settings).awaitTermination()


def test_files_out_of_order(spark, tmp_path):
    draw = random.Random(2)
    source, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    assert streamed.stored_activity(spark, sink).count() == 0
    everything = files_of(spark, source, [4, 1, 30], draw)
    run(spark, source, sink, log)
    everything += files_of(spark, source, [5, 31, 2, 33], draw)
    run(spark, source, sink, log)
    whole = everything[0]
    for frame in everything[1:]:
        whole = whole.union(frame)
    got = sorted(map(tuple, streamed.stored_activity(spark, sink).collect()))
    assert got == sorted(map(tuple, activity_windows(whole).collect()))
    parts = {r["part"] for r in streamed.stored_windows(spark, sink).collect()}
    assert parts == {"open", "closed", "late"}


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    """However long the stream has run, only windows within the delay are open."""
    source, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    files_of(spark, source, range(0, 12), random.Random(3))
    run(spark, source, sink, log, delay_seconds=2 * 3600)
    windows = streamed.stored_windows(spark, sink)
    assert windows.where("part = 'open'").select("start").distinct().count() <= 4
    assert windows.where("part = 'closed'").select("start").distinct().count() >= 8


def test_repeated_batch_counts_once(spark, tmp_path):
    """The batch was added but the stream's own log did not get to know, or it broke off half way."""
    sink = str(tmp_path / "out")
    events = spark.createDataFrame([("2024-01-01 01:00:00", "view")] * 3, "ts string, event_type string")
    batch = streamed.window_bounds(events)
    streamed._add_batch(batch, 0, sink, 60)
    streamed._add_batch(batch, 0, sink, 60)
    streamed._write(batch.groupBy("start", "end", "event_type").count().withColumnRenamed("count", "n"), f"{sink}/closed/batch=1")
    assert [r["n_events"] for r in streamed.stored_activity(spark, sink).collect()] == [3]
    streamed._add_batch(batch, 1, sink, 60)
    assert [r["n_events"] for r in streamed.stored_activity(spark, sink).collect()] == [6]
    assert Ledger(spark, f"{sink}/ledger").get("state")["batch"] == 1
