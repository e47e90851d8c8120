"""Descriptive statistics and the tables behind the exploratory plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import (
    CORRELATION_COLUMNS,
    FEATURE_COLUMNS,
    GRADE_COLUMNS,
    ID,
    NUMERIC_COLUMNS,
    RISK_BINS,
    STATUS_LABELS,
    STUDY_TIME_LABELS,
    TARGET,
)
from holdfast.functions import selection
from holdfast.functions.numbers import half_even, labelled, quoted, ratio, sql_text, without_nan

STATUS = f"{labelled(TARGET, STATUS_LABELS)} AS status"


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != ID
    ]


def duplicate_count(df: DataFrame) -> DataFrame:
    """``copies, n``: rows that repeat an earlier one in all columns but the id, and all rows.

    Rows are compared by 128 bits of hash over the values and over which of them are null, so 16
    bytes a row are shuffled, not the row.
    """
    columns = [quoted(c) for c in df.columns if c != ID]
    values = ", ".join([*columns, *[f"isnull({c})" for c in columns]])
    hashed = df.selectExpr(f"xxhash64({values}) AS h1", f"xxhash64(17, {values}) AS h2")
    return hashed.groupBy("h1", "h2").count().selectExpr(
        "coalesce(sum(count - 1), 0L) AS copies", "coalesce(sum(count), 0L) AS n")


def table_stats(df: DataFrame) -> DataFrame:
    """``stat, value``: size, target rate in percent, null cells and duplicate rows."""
    columns = [c for c in df.columns if c != ID]
    nulls = " + ".join(f"count_if({quoted(c)} IS NULL)" for c in columns)
    rate = half_even(f"avg({TARGET}) * 100", 2) if TARGET in columns else "CAST(NULL AS DOUBLE)"
    census = df.selectExpr("count(1) AS n", f"{rate} AS rate", f"{nulls} AS nulls").selectExpr(
        "stack(4, 'n_students', double(n), "
        f"'n_features', {float(len(columns))}D, 'dropout_rate_pct', rate, "
        "'missing_values', double(nulls)) AS (stat, value)"
    )
    copies = duplicate_count(df).selectExpr("'duplicates' AS stat", "double(copies) AS value")
    return census.unionByName(copies)


SUMMARY_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def numeric_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """``column, stat, value``: count, mean, std (n−1), extremes and quartiles, two decimals.

    Quartiles are selected by counting, see :mod:`~holdfast.functions.selection`: one pass over the rows for each seven
    bits in which values differ, and no table of values. ``accuracy`` asks for quartiles with a rank error of at
    most 1/accuracy instead, from a single aggregation.
    """
    columns = list(columns or numeric_columns(df))
    if accuracy is not None:
        return _approximate_summary(df, columns, accuracy)
    moments, quartiles = selection.order_statistics(
        df, selection.named(columns), {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    rows = [
        (c, stat, value)
        for c in columns if moments[c].count
        for stat, value in zip(SUMMARY_STATS, (
            float(moments[c].count), moments[c].mean, moments[c].std, moments[c].low, *quartiles[c].values(), moments[c].high))
    ]
    table = df.sparkSession.createDataFrame(rows, "column string, stat string, value double")
    return table.withColumn("value", F.expr(half_even("value", 2)))


def _long_summary(wide: DataFrame, sources: Sequence[str]) -> DataFrame:
    cells = ", ".join(
        f"'{stat}', {half_even(source, 2)}" for stat, source in zip(SUMMARY_STATS, sources)
    )
    return wide.selectExpr("column", f"stack({len(sources)}, {cells}) AS (stat, value)")


def _approximate_summary(df: DataFrame, columns: list[str], accuracy: int) -> DataFrame:
    numbers = df.selectExpr(*[f"{without_nan(quoted(c))} AS {quoted(c)}" for c in columns])
    wide = numbers.unpivot([], columns, "column", "value").groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("q"),
    )
    return _long_summary(
        wide, ("double(count)", "mean", "std", "min", "q[0]", "q[1]", "q[2]", "max"))


def target_distribution(df: DataFrame) -> DataFrame:
    """Learners per outcome, with its label."""
    return df.groupBy(TARGET).agg(F.count(F.lit(1)).alias("count")).selectExpr(
        TARGET, f"{labelled(TARGET, STATUS_LABELS)} AS label", "count"
    )


def grade_histogram(df: DataFrame) -> DataFrame:
    """``grade, status, bin, count``: each grade by outcome in bins one point wide."""
    return (
        df.selectExpr(STATUS, *GRADE_COLUMNS)
        .unpivot(["status"], list(GRADE_COLUMNS), "grade", "value")
        .where("value IS NOT NULL AND status IS NOT NULL")
        .selectExpr("grade", "status", "floor(value) AS bin")
        .groupBy("grade", "status", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS, places: int = 2
) -> DataFrame:
    """``column_a, column_b, correlation`` for every ordered pair of columns, null if constant.

    A first pass takes the mean of each column. The second sums products of distances from the
    means, which keeps large values with a small spread exact. Rows where either column is null
    drop out of that pair only; pairs of complete columns share their sums.
    """
    names = [c for c in columns if c in df.columns]
    numbers = df.selectExpr(*[f"{without_nan(quoted(c))} AS x{i}" for i, c in enumerate(names)])
    size = len(names)
    first = numbers.selectExpr(
        "count(1) AS n", *[f"avg(x{i}) AS m{i}" for i in range(size)],
        *[f"count(x{i}) AS c{i}" for i in range(size)],
    ).first()
    complete = [first[f"c{i}"] == first["n"] for i in range(size)]
    shifted = numbers.selectExpr(
        *[f"x{i} - double('{first[f'm{i}'] or 0.0!r}') AS d{i}" for i in range(size)]
    )

    sums, cells = {}, []

    def total(expression: str) -> str:
        return sums.setdefault(expression, f"s{len(sums)}")

    for i in range(size):
        for j in range(i, size):
            both = "" if complete[i] and complete[j] else f"d{i} + d{j} IS NOT NULL"

            def over(value: str) -> str:
                return total(f"sum(CASE WHEN {both} THEN {value} END)" if both else f"sum({value})")

            n = total(f"count_if({both})" if both else "count(1)")
            a, b = over(f"d{i}"), over(f"d{j}")
            aa, ab, bb = over(f"d{i} * d{i}"), over(f"d{i} * d{j}"), over(f"d{j} * d{j}")
            covariance = f"({ab} - try_divide({a} * {b}, {n}))"
            scale = (
                f"sqrt(greatest({aa} - try_divide({a} * {a}, {n}), 0D)) * "
                f"sqrt(greatest({bb} - try_divide({b} * {b}, {n}), 0D))"
            )
            value = half_even(ratio(covariance, scale), places)
            pairs = {(names[i], names[j]), (names[j], names[i])}
            cells += [f"{sql_text(p)}, {sql_text(q)}, {value}" for p, q in sorted(pairs)]
    summed = shifted.selectExpr(*[f"{text} AS {name}" for text, name in sums.items()])
    return summed.selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) AS (column_a, column_b, correlation)"
    )


def absence_box(df: DataFrame, method: str = "linear") -> DataFrame:
    """Box summary of absences per outcome: quartiles, 1.5·IQR whiskers, outliers beyond them."""
    labelled_rows = df.selectExpr(STATUS, f"{without_nan('Number_of_Absences')} AS value").where(
        "status IS NOT NULL AND value IS NOT NULL")
    wanted = {label: f"CASE WHEN status = {sql_text(label)} THEN value END" for label in STATUS_LABELS.values()}
    quartiles = selection.quantiles(labelled_rows, wanted, {"q1": 0.25, "median": 0.5, "q3": 0.75}, method)
    cells = {label: q for label, q in quartiles.items() if q["median"] is not None}

    def of_status(part: str) -> str:
        cases = " ".join(f"WHEN status = {sql_text(label)} THEN double('{q[part]!r}')" for label, q in cells.items())
        return f"CASE {cases} END AS {part}" if cells else f"CAST(NULL AS DOUBLE) AS {part}"

    fenced = labelled_rows.selectExpr("*", *[of_status(part) for part in ("q1", "median", "q3")]).selectExpr(
        "*", "value BETWEEN q1 - 1.5D * (q3 - q1) AND q3 + 1.5D * (q3 - q1) AS inside")
    return fenced.groupBy("status", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.expr("min(CASE WHEN inside THEN value END)").alias("low_whisker"),
        F.expr("max(CASE WHEN inside THEN value END)").alias("high_whisker"),
        F.expr("count_if(NOT inside)").alias("outliers"),
    )


def study_time_by_status(df: DataFrame) -> DataFrame:
    """Learners per weekly study time and outcome; values without a label are left out."""
    return (
        df.selectExpr(f"{labelled('Study_Time', STUDY_TIME_LABELS)} AS study_time", STATUS)
        .where("study_time IS NOT NULL AND status IS NOT NULL")
        .groupBy("study_time", "status")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def risk_histogram(df: DataFrame, bins: int = RISK_BINS) -> DataFrame:
    """``status, bin, bin_start, count``: combined risk in equal bins over its whole range."""
    scored = df.where("combined_risk_score IS NOT NULL")
    low, high = scored.selectExpr("min(combined_risk_score)", "max(combined_risk_score)").first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    width = (high - low) / bins or 1.0
    place = f"least(floor((combined_risk_score - {low!r}D) / {width!r}D), {bins - 1}L)"
    return (
        scored.selectExpr(STATUS, f"{place} AS bin")
        .where("status IS NOT NULL")
        .groupBy("status", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
        .selectExpr("status", "bin", f"{half_even(f'{low!r}D + bin * {width!r}D', 6)} AS bin_start",
                    "count")
    )


def insights(df: DataFrame) -> DataFrame:
    """``insight, value``: the key figures, from one pass; those without their columns are absent."""
    def percent(condition: str) -> str:
        return half_even(f"avg(CASE WHEN {condition} THEN {TARGET} END) * 100", 2)

    def mean_grade(outcome: int) -> str:
        return half_even(f"avg(CASE WHEN {TARGET} = {outcome} THEN Final_Grade END)", 2)

    spread = "stddev_pop({0}) FILTER (WHERE {1} IS NOT NULL)"
    risk = "combined_risk_score"
    correlation = ratio(
        f"covar_pop({risk}, {TARGET})",
        f"({spread.format(risk, TARGET)} * {spread.format(TARGET, risk)})",
    )
    figures = {
        "dropout_rate_pct": ((), percent("true")),
        "dropout_rate_with_failure_pct": (
            ("Number_of_Failures",), percent("Number_of_Failures > 0")),
        "dropout_rate_high_absence_pct": (
            ("absence_risk_flag",), percent("absence_risk_flag = 1")),
        "avg_final_grade_dropout": (("Final_Grade",), mean_grade(1)),
        "avg_final_grade_active": (("Final_Grade",), mean_grade(0)),
        "combined_risk_score_correlation": ((risk,), half_even(correlation, 3)),
    }
    shown = {
        name: text for name, (needed, text) in figures.items()
        if {TARGET, *needed} <= set(df.columns)
    }
    if not shown:
        return df.sparkSession.createDataFrame([], "insight string, value double")
    cells = ", ".join(f"'{name}', {name}" for name in shown)
    return df.selectExpr(*[f"{text} AS {name}" for name, text in shown.items()]).selectExpr(
        f"stack({len(shown)}, {cells}) AS (insight, value)"
    )


def run_eda(df: DataFrame) -> dict[str, DataFrame]:
    """Every profile table. ``df`` is read many times, so hand in a written table."""
    return {
        "table_stats": table_stats(df),
        "numeric_summary": numeric_summary(df),
        "insights": insights(df),
        "target_distribution": target_distribution(df),
        "grade_histogram": grade_histogram(df),
        "correlation_matrix": correlation_matrix(df),
        "absence_box": absence_box(df),
        "study_time_by_status": study_time_by_status(df),
        "risk_histogram": risk_histogram(df),
    }


#: Columns that name a row of the tables which are not long already.
_ROW_NAMES = {
    "target_distribution": (TARGET, "label"),
    "grade_histogram": ("grade", "status", "bin"),
    "correlation_matrix": ("column_a", "column_b"),
    "absence_box": ("status",),
    "study_time_by_status": ("study_time", "status"),
    "risk_histogram": ("status", "bin"),
}


def eda_long(df: DataFrame) -> DataFrame:
    """``section, item, stat, value``: all nine profile tables in one; an item is named by its keys, joined by ``|``."""
    tables, whole = run_eda(df), eda_report(df)
    for section, names in _ROW_NAMES.items():
        table = tables[section]
        stats = [c for c in table.columns if c not in names]
        cells = ", ".join(f"'{c}', double({quoted(c)})" for c in stats)
        whole = whole.unionByName(table.selectExpr(
            f"'{section}' AS section", f"concat_ws('|', {', '.join(map(quoted, names))}) AS item",
            f"stack({len(stats)}, {cells}) AS (stat, value)"))
    return whole


def eda_report(df: DataFrame) -> DataFrame:
    """``section, item, stat, value``: table statistics, numeric summary and insights in one."""
    return (
        table_stats(df).selectExpr("'statistics' AS section", "'table' AS item", "stat", "value")
        .unionByName(numeric_summary(df).selectExpr(
            "'numeric_summary' AS section", "column AS item", "stat", "value"))
        .unionByName(insights(df).selectExpr(
            "'insights' AS section", "'table' AS item", "insight AS stat", "value"))
    )
