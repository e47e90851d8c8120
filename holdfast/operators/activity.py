"""Key figures of platform activity and of the learner table.

Events carry ``ts``, ``user_id``, ``event_type`` and ``value``. Time on the platform is counted in
minutes with at least one event, which needs no ordering of a user's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import TARGET
from holdfast.functions.numbers import half_even


def user_activity(events: DataFrame) -> DataFrame:
    """Events, active minutes and active days per user.

    Grouping by user and minute first splits a very active user over many tasks; the second
    grouping then sees one row per active minute and combines those before the shuffle.
    """
    minutes = events.where("user_id IS NOT NULL").groupBy(
        "user_id", F.date_trunc("minute", "ts").alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"))
    days = minutes.groupBy("user_id", F.to_date("minute").alias("day")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("minutes")
    )
    return days.groupBy("user_id").agg(
        F.sum("n").alias("n_events"),
        F.sum("minutes").alias("active_minutes"),
        F.count(F.lit(1)).alias("active_days"),
    )


def activity_kpis(events: DataFrame) -> DataFrame:
    """Users, and mean events, active minutes and active days per user."""
    return user_activity(events).selectExpr(
        "count(1) AS n_users",
        *[f"{half_even(f'avg({c})', 4)} AS mean_{c}"
          for c in ("n_events", "active_minutes", "active_days")],
    )


def learner_kpis(scored: DataFrame) -> DataFrame:
    """Learners, mean final grade, share that dropped out and share at risk, in percent."""
    return scored.selectExpr(
        "count(1) AS n_students",
        f"{half_even('avg(Final_Grade)', 2)} AS mean_final_grade",
        f"{half_even(f'avg({TARGET}) * 100', 2)} AS dropout_rate_pct",
        f"{half_even('avg(CASE WHEN score > 0.5D THEN 1 ELSE 0 END) * 100', 2)} AS at_risk_pct",
    )


def windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """``window_start, event_type`` of each event that has a time."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL").select(
        F.date_format(F.window("ts", width)["start"], "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "event_type",
    )


def window_bounds(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """``at, start, end, event_type`` of each event that has a time, in microseconds since 1970."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    window = F.window("ts", width)
    return timed.select(
        F.unix_micros("ts").alias("at"), F.unix_micros(window["start"]).alias("start"),
        F.unix_micros(window["end"]).alias("end"), "event_type")


def activity_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per type in tumbling windows."""
    return windowed(events, width).groupBy("window_start", "event_type").agg(
        F.count(F.lit(1)).alias("n_events"))
