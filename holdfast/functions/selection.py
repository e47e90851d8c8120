"""Exact order statistics of many columns by counting, without a table of their values.

For each wanted rank there is an interval of values that holds it. A pass over the rows counts, for all columns at
once, how many values lie in each of ``BUCKETS`` parts of every interval, with the least and the largest value of the
part; the part that holds the rank is the next interval. A rank is found when its interval holds one value. What
moves is a row per interval, part and task, whatever the number of distinct values.

Parts are equally wide. Where that hardly narrows an interval, because values are spread over many magnitudes, the next
pass divides it by magnitude instead, so few passes are enough for any numbers: about one for each seven bits.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import quoted, without_nan

BUCKETS = 128
#: Columns that a step works on. The JVM interprets the method of a step for many columns, as it is too long to compile.
TOGETHER = 8
#: More than the exponents of all doubles, so that magnitudes keep their sign.
SPAN = 1100
POSITIONS = {
    "linear": lambda p, n: p * (n - 1),
    "midpoint": lambda p, n: min(max(p * n - 0.5, 0.0), n - 1.0),
}


@dataclass(frozen=True)
class Moments:
    """Count, mean, deviation (n−1) and extremes of a column's numbers."""

    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


@dataclass(frozen=True)
class Interval:
    """Values of a column from ``low`` to ``high``, both finite; ``n`` of them, ``below`` smaller ones."""

    column: str
    low: float
    high: float
    n: int
    below: int
    by_magnitude: bool = False


def _double(value: float) -> str:
    return f"double('{value!r}')"


def _magnitude(value: str) -> str:
    return f"CASE WHEN {value} = 0 THEN 0D ELSE signum({value}) * (log2(abs({value})) + {SPAN}D) END"


def _python_magnitude(value: float) -> float:
    return 0.0 if value == 0 else math.copysign(math.log2(abs(value)) + SPAN, value)


def _part(interval: Interval, value: str) -> str:
    low, high = interval.low, interval.high
    if interval.by_magnitude:
        low, high, value = _python_magnitude(low), _python_magnitude(high), _magnitude(value)
    return f"width_bucket({value}, {_double(low)}, {_double(high)}, {BUCKETS})"


def _numbers(df: DataFrame, columns: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns as numbers under short names."""
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    return df.selectExpr(*[f"{without_nan(text)} AS {names[c]}" for c, text in columns.items()]), names


def moments(df: DataFrame, columns: Mapping[str, str]) -> dict[str, Moments]:
    """One pass; ``columns`` maps names to SQL text."""
    return {c: found for c, (found, *_) in _first_pass(*_numbers(df, columns)).items()}


def _first_pass(rows: DataFrame, names: Mapping[str, str]) -> dict[str, tuple]:
    """Moments, and finite extremes with the number of values below and above all finite ones."""
    if not names:
        return {}
    finite = "CASE WHEN abs({0}) < double('Infinity') THEN {0} END"
    texts = ("count({0})", "avg({0})", "stddev_samp({0})", "min({0})", "max({0})",
             f"min({finite})", f"max({finite})", "count_if({0} = double('-Infinity'))", "count_if({0} = double('Infinity'))")
    k, found = len(texts), {}
    for group in _groups(list(names)):
        row = rows.selectExpr(*[text.format(names[c]) for c in group for text in texts]).first()
        found |= {c: (Moments(*row[i * k : i * k + 5]), *row[i * k + 5 : (i + 1) * k]) for i, c in enumerate(group)}
    return found


def _groups(columns: Sequence[str]) -> list[Sequence[str]]:
    return [columns[at : at + TOGETHER] for at in range(0, len(columns), TOGETHER)]


def order_statistics(df: DataFrame, columns: Mapping[str, str], shares: Mapping[str, float], method: str = "linear"
                     ) -> tuple[dict[str, Moments], dict[str, dict[str, float | None]]]:
    """Moments and interpolated quantiles of each column; nulls and NaN do not count, an empty column has None.

    ``linear`` puts share p at position p·(n−1); ``midpoint`` at p·n−½, as box plots do. The driver holds a few
    numbers per column, rank and part.
    """
    if method not in POSITIONS:
        raise ValueError(f"unknown quantile method: {method}")
    rows, names = _numbers(df, columns)
    first = _first_pass(rows, names)
    places = {c: {s: POSITIONS[method](float(p), found[0].count) for s, p in shares.items()}
              for c, found in first.items() if found[0].count}
    values: dict[tuple[str, int], float] = {}
    waiting: dict[tuple[str, int], Interval] = {}
    for c, at in places.items():
        whole, low, high, under, over = first[c]
        for rank in {r for place in at.values() for r in (math.floor(place), math.ceil(place))}:
            if rank < under:
                values[c, rank] = -math.inf
            elif rank >= whole.count - over:
                values[c, rank] = math.inf
            else:
                waiting[c, rank] = Interval(c, low, high, whole.count - under - over, under, math.isinf(high - low))
    while waiting:
        waiting = {key: found for key, found in waiting.items() if not _settled(values, key, found)}
        if waiting:
            counted = _count(rows, names, list(dict.fromkeys(waiting.values())))
            waiting = {key: _narrowed(found, counted[found], key[1]) for key, found in waiting.items()}

    def between(c: str, place: float) -> float:
        low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    found = {c: {s: between(c, places[c][s]) if c in places else None for s in shares} for c in columns}
    return {c: first[c][0] for c in columns}, found


def _settled(values: dict, key: tuple[str, int], interval: Interval) -> bool:
    if interval.low != interval.high:
        return False
    values[key] = interval.low
    return True


def _count(rows: DataFrame, names: Mapping[str, str], intervals: list[Interval]) -> dict[Interval, list[tuple]]:
    """Per interval its parts in order: number of values, least and largest."""
    width = BUCKETS + 2
    cells = []
    columns = list(dict.fromkeys(i.column for i in intervals))
    for c in columns:
        x = names[c]
        # Intervals of a column do not overlap, so a value lies in one at most.
        cases = " ".join(
            f"WHEN {x} BETWEEN {_double(i.low)} AND {_double(i.high)} THEN {k * width} + {_part(i, x)}"
            for k, i in enumerate(intervals) if i.column == c)
        cells.append(f"CASE {cases} END, {x}")
    placed = [
        rows.selectExpr(f"stack({len(group)}, {', '.join(group)}) AS (part, value)") for group in _groups(cells)]
    parts = (
        reduce(DataFrame.unionByName, placed).where("part IS NOT NULL")
        .groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    found: dict[Interval, list[tuple]] = {i: [] for i in intervals}
    for row in sorted(parts.collect()):
        found[intervals[row["part"] // width]].append((row["n"], row["low"], row["high"]))
    return found


def _narrowed(interval: Interval, parts: list[tuple], rank: int) -> Interval:
    below = interval.below
    for n, low, high in parts:
        if rank < below + n:
            # Parts that leave most values together are divided the other way next time.
            crowded = n > interval.n / 2
            by_magnitude = crowded != interval.by_magnitude and _python_magnitude(low) < _python_magnitude(high)
            return Interval(interval.column, low, high, n, below, by_magnitude or math.isinf(high - low))
        below += n
    raise RuntimeError(f"rows of {interval.column} changed between passes")


def quantiles(df: DataFrame, columns: Mapping[str, str], shares: Mapping[str, float], method: str = "linear"
              ) -> dict[str, dict[str, float | None]]:
    """Only the quantiles of :func:`order_statistics`."""
    return order_statistics(df, columns, shares, method)[1]


def named(columns) -> dict[str, str]:
    """Columns by their own names."""
    return {c: quoted(c) for c in columns}
