"""Shift of column distributions between two tables, or between periods whose counts are stored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import half_even, quoted, without_nan
from holdfast.ledger import Ledger

BINS = 10
# Share that stands in for an empty bin, so that its logarithm exists.
EMPTY_SHARE = 0.0001
# Usual reading of the index: below 0.1 stable, below 0.25 moderate.
LEVELS = "CASE WHEN psi < 0.1D THEN 'stable' WHEN psi < 0.25D THEN 'moderate' ELSE 'strong' END"


@dataclass(frozen=True)
class Bins:
    """Equal bins: lowest edge and width per column."""

    edges: dict[str, tuple[float, float]]
    number: int = BINS


def fit_bins(baseline: DataFrame, columns: Sequence[str], bins: int = BINS) -> Bins:
    """Bins over the range of each column, in one pass; a column without range or values gets bins of width 1."""
    found = baseline.selectExpr(*[
        f"{f}({without_nan(quoted(c))}) AS {f}{i}"
        for i, c in enumerate(columns) for f in ("min", "max")
    ]).first()
    edges = {}
    for i, c in enumerate(columns):
        low, high = found[f"min{i}"], found[f"max{i}"]
        edges[c] = (float(low or 0.0), float(((high or 0.0) - (low or 0.0)) / bins or 1.0))
    return Bins(edges, bins)


def count_bins(df: DataFrame, bins: Bins, by: Sequence[str] = ()) -> DataFrame:
    """The columns ``by`` and ``column, bin, n``. Values outside the range count in the outer bins, nulls and NaN in none.

    One pass that collapses to at most a row per bin, column and value of ``by`` before anything is shuffled.
    """
    places = []
    for c, (low, width) in bins.edges.items():
        value = without_nan(quoted(c))
        place = f"floor(({value} - double('{low!r}')) / double('{width!r}'))"
        # The outer functions ignore nulls, so nulls are kept apart first.
        places.append(f"if({value} IS NULL, NULL, int(least(greatest({place}, 0L), {bins.number - 1}L))) AS {quoted(c)}")
    keys = [quoted(c) for c in by]
    return (
        df.selectExpr(*keys, *places)
        .unpivot([F.col(k) for k in keys], [quoted(c) for c in bins.edges], "column", "bin")
        .where("bin IS NOT NULL")
        .groupBy(*keys, "column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def compare_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column, psi, level`` of two tables ``column, bin, n``: the population stability index."""
    def shares(counts: DataFrame, name: str) -> DataFrame:
        return counts.selectExpr("column", "bin", f"n / sum(n) OVER (PARTITION BY column) AS {name}")

    both = shares(before, "before").join(shares(after, "after"), ["column", "bin"], "full")
    old, new = (f"coalesce({side}, {EMPTY_SHARE}D)" for side in ("before", "after"))
    index = both.groupBy("column").agg(
        F.expr(half_even(f"sum(({new} - {old}) * ln({new} / {old}))", 6)).alias("psi")
    )
    return index.selectExpr("column", "psi", f"{LEVELS} AS level")


def drift_report(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = BINS
) -> DataFrame:
    """``column, psi, level``: population stability index over equal bins of the baseline's range.

    Each table is read once and collapsed to at most ``bins`` rows per column before anything is joined.
    """
    fitted = fit_bins(baseline, columns, bins)
    return compare_counts(count_bins(baseline, fitted), count_bins(current, fitted))


class DriftCounts:
    """Counts per period, batch, column and bin in a shared folder, from which the shift between any periods is read
    without their rows.

    The bins are fixed when the folder is made, so that counts add up: over periods, and over the batches in which the
    rows of a period arrive. A batch that is added again replaces itself, so one that broke off is simply repeated.
    Periods and batches are text; rows without a period belong to none that can be named, but count where all are asked for.
    """

    SCHEMA = "period string, column string, bin int, n bigint, batch string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/counts"
        self.ledger = Ledger(spark, f"{folder}/bins")

    def create(self, baseline: DataFrame, columns: Sequence[str], bins: int = BINS) -> DriftCounts:
        """Fix the bins by the range of ``baseline``; its rows are not counted yet. Bins that are there stay."""
        if self.ledger.get("bins") is None:
            fitted = fit_bins(baseline, columns, bins)
            self.ledger.put("bins", {"edges": {c: list(e) for c, e in fitted.edges.items()}, "number": fitted.number})
        return self

    def bins(self) -> Bins:
        entry = self.ledger.get("bins")
        if entry is None:
            raise LookupError(f"no bins for {self.path}")
        return Bins({c: tuple(e) for c, e in entry["edges"].items()}, entry["number"])

    def add(self, rows: DataFrame, period: str, batch: str) -> None:
        """Count ``rows`` by the column or SQL expression ``period``, as the batch of that name, in one pass."""
        fitted = self.bins()
        named = rows.selectExpr(f"CAST({period} AS STRING) AS _period", *[quoted(c) for c in fitted.edges])
        counts = count_bins(named, fitted, ["_period"]).withColumnRenamed("_period", "period")
        counts.write.mode("overwrite").parquet(f"{self.path}/batch={quote(batch, safe='')}")

    def periods(self) -> DataFrame:
        """``period, n``: what is stored, with the number of counted values."""
        stored = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return stored.groupBy("period").agg(F.sum("n").alias("n")).where("period IS NOT NULL").orderBy("period")

    def counts(self, periods: Sequence[str] | None = None) -> DataFrame:
        """``column, bin, n`` added up over the named periods, or over all rows."""
        stored = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        if periods is not None:
            stored = stored.where(F.col("period").isin(list(periods)))
        return stored.groupBy("column", "bin").agg(F.sum("n").alias("n"))

    def report(self, before: Sequence[str] | None, after: Sequence[str] | None) -> DataFrame:
        """``column, psi, level`` between two sets of periods."""
        return compare_counts(self.counts(before), self.counts(after))
