"""Exact ranks and quantiles from pre-aggregated value counts.

Rows are first collapsed to one row per distinct value (map-side partial aggregation, so a value
that fills a third of the table costs one row per task) and that small table is written once.
Order-based results are computed on it in range-partitioned parts, at every size alike, so no task
needs to hold a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import quoted, without_nan
from holdfast.workspace import materialise

def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by…, column, value, n``, written: how often each non-null number occurs."""
    numbers = [f"{without_nan(quoted(c))} AS {quoted(c)}" for c in columns]
    counts = (
        df.selectExpr(*by, *numbers)
        .unpivot(list(by), list(columns), "column", "value")
        .where("value IS NOT NULL")
        .groupBy(*by, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return materialise(counts, "value_counts")


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n``: how often each non-null text occurs."""
    return (
        df.select(*columns)
        .unpivot([], list(columns), "column", "value")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def running_totals(
    counts: DataFrame, keys: Sequence[str], order: str, totals: Sequence[str]
) -> DataFrame:
    """Add ``<t>_before`` (sum over smaller ``order``) and ``<t>_total`` for each of ``totals``.

    ``order`` is unique within ``keys``. The counts are range-partitioned by keys and order, so a
    part holds a slice of one key or several whole keys, and written with the number of their part.
    Sums per key and part give what lies before each part; the rest is a running sum within it.
    The sums have at most a row per key and one per part, and are written as well, so that Spark
    knows their size when it plans the join.
    """
    parts = materialise(
        counts.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()),
        "ordered_counts",
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        parts.groupBy(*keys, "_part").agg(*[F.sum(t).alias(t) for t in totals]).select(
            *keys,
            "_part",
            *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_{t}_offset") for t in totals],
            *[F.sum(t).over(whole).alias(f"{t}_total") for t in totals],
        ),
        "part_offsets",
    )
    smaller = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return parts.join(offsets, [*keys, "_part"]).select(
        *counts.columns,
        *[
            (F.coalesce(F.sum(t).over(smaller), F.lit(0)) + F.col(f"_{t}_offset"))
            .alias(f"{t}_before")
            for t in totals
        ],
        *[f"{t}_total" for t in totals],
    )


def quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    shares: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """Interpolated quantiles of counted values: ``keys…`` and one column per entry of ``shares``.

    ``linear`` puts share p at position p·(n−1); ``midpoint`` at p·n−½, as box plots do.
    """
    positions = {
        "linear": "{p}D * (n_total - 1)",
        "midpoint": "least(greatest({p}D * n_total - 0.5D, 0D), double(n_total - 1))",
    }
    if method not in positions:
        raise ValueError(f"unknown quantile method: {method}")
    ranked = running_totals(counts, keys, "value", ["n"])
    at = {name: positions[method].format(p=float(p)) for name, p in shares.items()}
    bounds, values = [], []
    for name, place in at.items():
        for end, rank in (("low", f"floor({place})"), ("high", f"ceil({place})")):
            bounds.append(F.expr(
                f"max(CASE WHEN n_before <= {rank} AND {rank} < n_before + n THEN value END)"
            ).alias(f"_{name}_{end}"))
        bounds.append(F.expr(f"max({place} - floor({place}))").alias(f"_{name}_part"))
        values.append(f"_{name}_low + (_{name}_high - _{name}_low) * _{name}_part AS {name}")
    return ranked.groupBy(*keys).agg(*bounds).selectExpr(*keys, *values)


def most_frequent(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys…, value``: the most frequent value, the smallest one on a tie."""
    return counts.groupBy(*keys).agg(F.expr("min_by(value, struct(-n, value))").alias("value"))
