"""Cleaning of the raw, all-text learner table.

Order matters: exact duplicates go first, on the raw text; numbers are read next; medians and
modes are taken before out-of-range numbers are clipped.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import (
    BINARY_COLUMNS,
    ID,
    NUMERIC_COLUMNS,
    TARGET,
    TRUE_TEXTS,
    VALUE_RANGES,
)
from holdfast.functions import selection
from holdfast.functions.distributions import most_frequent, text_counts
from holdfast.functions.numbers import clamp, quoted, to_number
from holdfast.workspace import materialise


@dataclass(frozen=True)
class CleaningStats:
    """What imputation fills in; applied to new rows it gives them the same values."""

    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def replace_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Columns replaced or added by SQL text, in one projection."""
    return df.withColumns({c: F.expr(text) for c, text in expressions.items()})


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


#: Bits of the filter for hashes that occur more than once. It is broadcast as at most ``FILTER_BITS / 64`` rows of two
#: numbers, whatever the table holds.
FILTER_BITS = 1 << 26


def with_repeat_mark(df: DataFrame, columns: list[str], mark: str) -> DataFrame:
    """The rows, and whether another row may have the same values in ``columns``: true for every row that has copies,
    and for others only where the filter does not tell them apart.

    Hashes of 128 bits are grouped, and those that occur more than once set a bit each; rows look up theirs.
    """
    values = ", ".join(map(quoted, columns))
    repeated = (
        df.selectExpr(f"xxhash64({values}) AS h1", f"xxhash64(17, {values}) AS h2")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    slot, word = f"xxhash64({values}) & {FILTER_BITS - 1}L", f"{mark}_word"
    filled = (
        repeated.selectExpr(f"h1 & {FILTER_BITS - 1}L AS slot")
        .groupBy(F.expr("slot div 64").alias(word))
        .agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias(f"{mark}_bits"))
    )
    looked_up = df.selectExpr("*", f"({slot}) div 64 AS {word}", f"int(({slot}) % 64) AS {mark}_bit").join(
        F.broadcast(filled), word, "left")
    return looked_up.selectExpr(
        *map(quoted, df.columns), f"coalesce(getbit({mark}_bits, {mark}_bit) = 1, false) AS {mark}")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct source row, with the smallest id of its copies.

    Two phases: hashes move for all rows, whole rows only where a hash occurs more than once. Those are
    compared in full, so equal hashes of different rows do no harm. The group-bys collapse copies before
    their shuffles, so a row with very many copies stays cheap.
    """
    source = [c for c in df.columns if c != ID]
    if ID not in df.columns:
        return df.distinct()
    if not source:
        return df.agg(F.min(ID).alias(ID)).where(F.col(ID).isNotNull())
    marked = with_repeat_mark(df, source, "_repeated")
    single = marked.where("NOT _repeated").select(*map(quoted, df.columns))
    copied = marked.where("_repeated").groupBy(*map(quoted, source)).agg(F.min(ID).alias(ID))
    return single.unionByName(copied.select(*map(quoted, df.columns)))


def _target() -> str:
    accepted = ", ".join(f"'{t}'" for t in TRUE_TEXTS)
    return f"CASE WHEN lower(regexp_replace(CAST({TARGET} AS STRING), '^\\\\s+|\\\\s+$', '')) IN ({accepted}) THEN 1 ELSE 0 END"


def _binary(c: str) -> str:
    return f"CASE WHEN {c} = 'yes' THEN 1 ELSE 0 END"


def normalise_target(df: DataFrame) -> DataFrame:
    """Target text to 1 for the accepted "true" spellings and 0 for all else, null included."""
    return replace_columns(df, {TARGET: _target()})


def map_binary(df: DataFrame) -> DataFrame:
    """``yes`` to 1; ``no``, null and any other text to 0."""
    return replace_columns(df, {c: _binary(c) for c in BINARY_COLUMNS if c in df.columns})


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns to double, unreadable text to null. All of them must be there."""
    kinds = dict(df.dtypes)
    return replace_columns(df, {
        c: to_number(c if kinds.get(c) == "string" else f"CAST({c} AS STRING)")
        for c in NUMERIC_COLUMNS
    })


def typed(df: DataFrame) -> DataFrame:
    """Raw text to typed columns, nothing filled in or clipped yet."""
    return df.transform(normalise_target).transform(map_binary).transform(coerce_numeric)


def unique_typed_rows(raw: DataFrame) -> DataFrame:
    """De-duplicated, typed rows as a written table.

    Only copies move as whole rows here, and nothing later does; every later pass scans the
    written columns it needs.
    """
    return materialise(
        raw.transform(trim_columns).transform(drop_duplicates).transform(typed), "unique_rows"
    )


def _text_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != ID
    ]


def _columns_with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    filled = df.select(F.count(F.lit(1)), *[F.count(c) for c in columns]).first()
    return [c for c, n in zip(columns, filled[1:]) if n < filled[0]]


def fit_cleaning(df: DataFrame, every_column: bool = False) -> CleaningStats:
    """Medians and modes of a typed frame.

    Only columns that have nulls are counted, unless ``every_column`` asks for all of them, which
    a model needs that will see new rows. At most one value per column reaches the driver.
    """
    numeric = [c for c in NUMERIC_COLUMNS if c in df.columns]
    texts = _text_columns(df)
    if not every_column:
        gaps = _columns_with_nulls(df, numeric + texts)
        numeric = [c for c in numeric if c in gaps]
        texts = [c for c in texts if c in gaps]
    medians, modes = {}, {}
    if numeric:
        middle = selection.quantiles(df, selection.named(numeric), {"median": 0.5})
        medians = {c: found["median"] for c, found in middle.items() if found["median"] is not None}
    if texts:
        modes = {
            row["column"]: row["value"]
            for row in most_frequent(text_counts(df, texts), ["column"]).collect()
        }
    return CleaningStats(medians, modes)


def impute_median(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Nulls of numeric columns to the fitted median."""
    values = {c: v for c, v in stats.medians.items() if c in df.columns}
    return df.na.fill(values) if values else df


def impute_mode(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Nulls of text columns to the fitted mode."""
    values = {c: v for c, v in stats.modes.items() if c in df.columns}
    return df.na.fill(values) if values else df


def impute(df: DataFrame, stats: CleaningStats) -> DataFrame:
    return df.transform(impute_median, stats).transform(impute_mode, stats)


def flag_zero_grades(df: DataFrame) -> DataFrame:
    """How many rows have both period grades 0 but a final grade above 0.

    Their period grades are probably missing. The rows stay as they are.
    """
    return df.selectExpr(
        "count_if(Grade_1 = 0 AND Grade_2 = 0 AND Final_Grade > 0) AS zero_grade_rows"
    )


def clip_ranges(df: DataFrame) -> DataFrame:
    """Out-of-range numbers to the nearest valid one."""
    return replace_columns(df, {
        c: clamp(c, low, high) for c, (low, high) in VALUE_RANGES.items() if c in df.columns
    })


def apply_cleaning(df: DataFrame, stats: CleaningStats) -> DataFrame:
    """Fill and clip a typed frame with known statistics; no job, also fit for streams."""
    return df.transform(impute, stats).transform(clip_ranges)


def clean(raw: DataFrame) -> DataFrame:
    """Raw text table to clean table: copies removed, then narrow passes over the written rows."""
    rows = unique_typed_rows(raw)
    return apply_cleaning(rows, fit_cleaning(rows))


def clean_audit(raw: DataFrame) -> DataFrame:
    """``check, column, n``: what cleaning removed, filled in or clipped."""
    named = raw.transform(trim_columns)
    binary = [c for c in BINARY_COLUMNS if c in named.columns]
    marked = named.transform(drop_duplicates).withColumns({
        f"_odd_{c}": F.expr(f"NOT coalesce({c} IN ('yes', 'no'), false)") for c in binary
    })
    rows = materialise(typed(marked), "audited_rows")
    plain = rows.drop(*[f"_odd_{c}" for c in binary])
    filled = rows.transform(impute, fit_cleaning(plain))

    numeric = [c for c in NUMERIC_COLUMNS if c in plain.columns]
    ranged = [c for c in VALUE_RANGES if c in plain.columns]
    before = [("unexpected_binary", c, f"_odd_{c}") for c in binary]
    before += [("imputed_median", c, f"{c} IS NULL") for c in numeric]
    before += [("imputed_mode", c, f"{c} IS NULL") for c in _text_columns(plain)]
    after = [(
        "zero_grades", "Grade_1", "Grade_1 = 0 AND Grade_2 = 0 AND Final_Grade > 0"
    )] + [
        ("out_of_range", c, "{0} < {1} OR {0} > {2}".format(c, *VALUE_RANGES[c])) for c in ranged
    ]
    copies = named.select(F.count(F.lit(1)).alias("n")).unionByName(
        rows.select((-F.count(F.lit(1))).alias("n"))
    )
    return (
        _counts(rows, before)
        .unionByName(_counts(filled, after))
        .unionByName(copies.selectExpr("'duplicates' AS check", "'*' AS column", "sum(n) AS n"))
    )


def _counts(df: DataFrame, tests: list[tuple[str, str, str]]) -> DataFrame:
    """One row ``check, column, n`` per test, all counted in one pass."""
    counted = df.selectExpr(*[f"count_if({test}) AS c{i}" for i, (_, _, test) in enumerate(tests)])
    cells = ", ".join(f"'{check}', '{c}', c{i}" for i, (check, c, _) in enumerate(tests))
    return counted.selectExpr(f"stack({len(tests)}, {cells}) AS (check, column, n)")
