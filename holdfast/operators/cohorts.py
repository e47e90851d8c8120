"""Real dropout rate of learner groups chosen by a predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import GRADE_COLUMNS, ID, TARGET
from holdfast.functions.numbers import half_even, ratio

# Bounds of the groups and length of the printed sample.
LOW_GRADE = 10
MANY_ABSENCES = 20
SAMPLE_ROWS = 20


def low_grades(df: DataFrame) -> DataFrame:
    return df.where(" AND ".join(f"{c} <= {LOW_GRADE}" for c in GRADE_COLUMNS))


def zero_final(df: DataFrame) -> DataFrame:
    return df.where("Final_Grade = 0")


def many_absences(df: DataFrame) -> DataFrame:
    return df.where(f"Number_of_Absences > {MANY_ABSENCES}")


def cohort_rate(df: DataFrame) -> DataFrame:
    """``n_students, dropout_rate``: size and share of dropouts (0–1, four decimals)."""
    return df.agg(F.count(F.lit(1)).alias("n_students"), F.sum(TARGET).alias("_out")).selectExpr(
        "n_students", f"{half_even(ratio('_out', 'double(n_students)'), 4)} AS dropout_rate"
    )


def cohort_sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``rows`` learners by id with their grades, absences and outcome."""
    return df.orderBy(ID).limit(rows).select(ID, *GRADE_COLUMNS, "Number_of_Absences", TARGET)


def compare_cohorts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size, dropout rate, mean final grade and mean risk per cohort, with subtotals.

    A null in a ``by`` column marks a subtotal; ``cohort_level`` counts the columns rolled up.
    """
    return df.rollup(*by).agg(
        F.expr("bit_count(grouping_id())").alias("cohort_level"),
        F.count(F.lit(1)).alias("n_students"),
        F.expr(half_even(f"avg({TARGET}) * 100", 2)).alias("dropout_rate_pct"),
        F.expr(half_even("avg(Final_Grade)", 2)).alias("mean_final_grade"),
        F.expr(half_even("avg(combined_risk_score)", 4)).alias("mean_risk"),
    )
