"""Text columns to numbers, the model's columns, and their scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import (
    BINARY_COLUMNS,
    ID,
    MODEL_NUMERIC_COLUMNS,
    ONE_HOT_PREFIXES,
    SCALED_COLUMNS,
    TARGET,
)
from holdfast.functions.numbers import quoted, sql_text


@dataclass(frozen=True)
class Dictionary:
    """Sorted distinct values of each text column."""

    values: dict[str, tuple[str, ...]]


def text_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != ID
    ]


def fit_dictionary(
    df: DataFrame, columns: Sequence[str] | None = None, most: int | None = None
) -> Dictionary:
    """Distinct values per text column.

    Encoded values become columns or constants of the plan, so the driver has to hold them. A
    caller who wants a bound gives ``most``: a column with more values is then an error.
    """
    columns = list(columns or text_columns(df))
    if not columns:
        return Dictionary({})
    distinct = (
        df.select(*columns).unpivot([], columns, "column", "value")
        .where("value IS NOT NULL").distinct()
    )
    bounded = distinct if most is None else distinct.limit(most * len(columns) + 1)
    rows = bounded.collect()
    found = {c: sorted(row["value"] for row in rows if row["column"] == c) for c in columns}
    crowded = [c for c, values in found.items() if most is not None and len(values) > most]
    if crowded or most is not None and len(rows) > most * len(columns):
        raise ValueError(f"more than {most} distinct values to encode: {crowded or columns}")
    return Dictionary({c: tuple(values) for c, values in found.items()})


def one_hot(df: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Each text column to one 0/1 column ``<column>_<value>`` per known value.

    Null and unknown values give zeros throughout.
    """
    dictionary = dictionary or fit_dictionary(df)
    kept = [quoted(c) for c in df.columns if c not in dictionary.values]
    flags = [
        f"CASE WHEN {quoted(c)} = {sql_text(v)} THEN 1 ELSE 0 END AS {quoted(f'{c}_{v}')}"
        for c, values in dictionary.values.items() for v in values
    ]
    return df.selectExpr(*kept, *flags)


def label_encode(df: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Each text column to the 0-based rank of its value; null and unknown get the next code."""
    dictionary = dictionary or fit_dictionary(df)
    codes = {}
    for c, values in dictionary.values.items():
        known = f"array({', '.join(sql_text(v) for v in values)})"
        place = f"nullif(array_position({known}, {quoted(c)}), 0L)" if values else "NULL"
        codes[c] = F.expr(f"int(coalesce({place} - 1, {len(values)}))")
    return df.withColumns(codes)


def feature_names(df: DataFrame) -> list[str]:
    """The model's input columns that ``df`` has: numeric, yes/no, then one-hot columns."""
    named = [c for c in (*MODEL_NUMERIC_COLUMNS, *BINARY_COLUMNS) if c in df.columns]
    prefixes = tuple(f"{p}_" for p in ONE_HOT_PREFIXES)
    hot = [c for c in df.columns if c.startswith(prefixes)]
    return [c for c in dict.fromkeys(named + hot) if c != TARGET]


def select_features(df: DataFrame) -> DataFrame:
    """Id, target and the model's input columns."""
    keys = [c for c in (ID, TARGET) if c in df.columns]
    return df.select(*keys, *[quoted(c) for c in feature_names(df)])


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per scaled column (1 where there is no spread)."""

    mean: dict[str, float]
    deviation: dict[str, float]


def fit_scaling(train: DataFrame, columns: Sequence[str] = SCALED_COLUMNS) -> Scaling:
    """From one pass over the training rows; one row reaches the driver."""
    present = [c for c in columns if c in train.columns]
    row = train.select(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(present)],
        *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(present)],
    ).first()

    def usable(deviation):
        return deviation if deviation and not math.isnan(deviation) else 1.0

    return Scaling(
        {c: row[f"m{i}"] or 0.0 for i, c in enumerate(present)},
        {c: usable(row[f"d{i}"]) for i, c in enumerate(present)},
    )


def standard_scale(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Scaled columns to (value − mean) / deviation."""
    return df.withColumns({
        c: F.expr(f"({c} - double('{scaling.mean[c]!r}')) / double('{scaling.deviation[c]!r}')")
        for c in scaling.mean if c in df.columns
    })
