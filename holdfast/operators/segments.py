"""Groups of similar learners.

Fitting sees all rows, in an order and in parts that follow from their ids; segments are numbered by their centres. So
neither the layout of a table nor the order of its rows changes the result. Assigning and judging cover all rows as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import ID, MODEL_SEED, SCALED_COLUMNS, TARGET
from holdfast.functions.numbers import half_even, quoted
from holdfast.operators.models import fit_rows
from holdfast.workspace import materialise

SEGMENTS = 4
TRIED = (2, 3, 4, 5, 6)
#: Digits of the centres that are kept: sums in another order differ behind them.
DIGITS = 9


@dataclass(frozen=True)
class Segments:
    """Centres of the segments, in their order, over scaled columns."""

    columns: tuple[str, ...]
    centres: tuple[tuple[float, ...], ...]

    def distances(self) -> str:
        """SQL text of an array: the squared distance of a row to each centre; null counts as 0, the mean."""
        each = [
            " + ".join(f"pow(coalesce({quoted(c)}, 0D) - double('{x!r}'), 2)" for c, x in zip(self.columns, centre))
            for centre in self.centres
        ]
        return f"array({', '.join(each)})"


def fit_segments(
    scaled: DataFrame, k: int = SEGMENTS, columns: Sequence[str] = SCALED_COLUMNS, most: int | None = None
) -> Segments:
    """K-means on scaled columns of rows with ids; ``k`` centres at most reach the driver."""
    filled = _filled(scaled, columns)
    return _fit(fit_rows(filled, filled.count(), most), k, columns)


def _filled(scaled: DataFrame, columns: Sequence[str]) -> DataFrame:
    return scaled.select(ID, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def _fit(ordered: DataFrame, k: int, columns: Sequence[str]) -> Segments:
    rows = VectorAssembler(inputCols=list(columns), outputCol="inputs").transform(ordered)
    model = KMeans(k=k, seed=MODEL_SEED, featuresCol="inputs").fit(rows)
    centres = sorted(tuple(np.round(c, DIGITS).tolist()) for c in model.clusterCenters())
    return Segments(tuple(columns), tuple(centres))


def assign_segments(segments: Segments, scaled: DataFrame) -> DataFrame:
    """Adds ``segment``, the number of the nearest centre, the first one on a tie; a projection, also for streams."""
    near = segments.distances()
    return scaled.withColumn("_near", F.expr(near)).withColumn(
        "segment", F.expr("int(array_position(_near, array_min(_near))) - 1")).drop("_near")


def segment_quality(
    scaled: DataFrame, tried: Sequence[int] = TRIED, columns: Sequence[str] = SCALED_COLUMNS, most: int | None = None
) -> DataFrame:
    """``k, n_segments, inertia, silhouette`` for each number of segments, over all rows.

    ``inertia`` is the mean squared distance to the own centre; ``silhouette`` compares it with that to the nearest
    other centre, from -1 to 1. Centres stand for the rows of their segments, so one pass does for all numbers, and no pair
    of rows is formed.
    """
    filled = _filled(scaled, columns)
    total = filled.count()
    # Stored once for all numbers; order and parts do not outlive storing.
    drawn = materialise(fit_rows(filled, total, most), "segment_rows")
    kept = total if most is None else min(total, most)
    found = {k: _fit(fit_rows(drawn, kept, most), k, columns) for k in tried}
    near = scaled.select(*[F.expr(f"array_sort({s.distances()})").alias(f"near_{k}") for k, s in found.items()])
    pairs = near.selectExpr(*[text for k in found for text in (f"near_{k}[0] AS own_{k}", f"get(near_{k}, 1) AS other_{k}")])
    judged = pairs.agg(F.count(F.lit(1)).alias("n"), *[expr for k in found for expr in (
        F.expr(half_even(f"avg(own_{k})", 4)).alias(f"inertia_{k}"),
        F.expr(half_even(
            f"avg(CASE WHEN other_{k} > 0 THEN (sqrt(other_{k}) - sqrt(own_{k})) / sqrt(other_{k}) ELSE 0 END)", 4
        )).alias(f"silhouette_{k}"))])
    cells = ", ".join(f"{k}, {len(s.centres)}, inertia_{k}, silhouette_{k}" for k, s in found.items())
    return judged.where("n > 0").selectExpr(f"stack({len(found)}, {cells}) AS (k, n_segments, inertia, silhouette)")


def best_number(quality: DataFrame) -> int:
    """The number of segments with the best silhouette, the smaller one on a tie."""
    return quality.orderBy(F.desc("silhouette"), "k").first()["k"]


def segment_profile(
    segmented: DataFrame, columns: Sequence[str] = SCALED_COLUMNS
) -> DataFrame:
    """Size, dropout rate and mean of each column per segment."""
    return segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_students"),
        F.expr(half_even(f"avg({TARGET}) * 100", 2)).alias("dropout_rate_pct"),
        *[F.expr(half_even(f"avg({c})", 4)).alias(f"avg_{c}") for c in columns],
    )
