"""The ten risk features of a clean learner table.

Two of them need table-wide extremes. Those are fitted first (one row reaches the driver) and
then enter the expressions as constants, so building features never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import (
    ABSENCE_THRESHOLD,
    ALCOHOL_WEIGHTS,
    ENGAGEMENT_WEIGHTS,
    FEATURE_COLUMNS,
    GRADE_CEILING,
    GRADE_WEIGHTS,
    RISK_WEIGHTS,
    SOCIAL_WEIGHTS,
    SUPPORT_WEIGHTS,
)
from holdfast.functions.numbers import clamp, half_even, ratio, weighted_sum


@dataclass(frozen=True)
class FeatureStats:
    """Table-wide extremes; applied to new rows it scores them on the same scale."""

    social_low: float | None = None
    social_high: float | None = None
    engagement_high: float | None = None


def _constant(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"double('{value!r}')"


def feature_expressions(columns, stats: FeatureStats) -> dict[str, str]:
    """SQL text of each feature; later ones may name earlier ones."""
    inputs = {*columns, *FEATURE_COLUMNS}
    low, high = _constant(stats.social_low), _constant(stats.social_high)
    relative_grade = clamp(f"(academic_performance_score / {GRADE_CEILING})", 0, 1)
    engaged = ratio("engagement_score", _constant(stats.engagement_high))
    blend = {
        "performance": f"(1 - {relative_grade})",
        "social": "social_risk_index",
        "absence": "absence_risk_flag",
        "failure": "failure_history_flag",
        "engagement": f"(1 - {engaged})",
    }
    social = weighted_sum(inputs, SOCIAL_WEIGHTS)
    return {
        "academic_performance_score": half_even(weighted_sum(inputs, GRADE_WEIGHTS), 2),
        "grade_progression": half_even("Grade_2 - Grade_1", 2),
        "alcohol_risk_score": half_even(weighted_sum(inputs, ALCOHOL_WEIGHTS), 2),
        "social_risk_index": half_even(ratio(f"({social}) - {low}", f"{high} - {low}"), 3),
        "family_support_score": half_even(weighted_sum(inputs, SUPPORT_WEIGHTS), 2),
        "engagement_score": half_even(weighted_sum(inputs, ENGAGEMENT_WEIGHTS), 2),
        "parental_education_level": half_even("(Mother_Education + Father_Education) / 2D", 2),
        "absence_risk_flag": (
            f"CASE WHEN Number_of_Absences >= {ABSENCE_THRESHOLD} THEN 1 ELSE 0 END"
        ),
        "failure_history_flag": "CASE WHEN Number_of_Failures > 0 THEN 1 ELSE 0 END",
        "combined_risk_score": half_even(
            " + ".join(f"{blend[part]} * {w}D" for part, w in RISK_WEIGHTS.items()), 3
        ),
    }


def add_feature(df: DataFrame, name: str, stats: FeatureStats = FeatureStats()) -> DataFrame:
    """One feature; ``df`` must hold the earlier features it is built from."""
    return df.withColumn(name, F.expr(feature_expressions(df.columns, stats)[name]))


def fit_features(clean: DataFrame) -> FeatureStats:
    """The extremes, from one pass over the few columns they need."""
    scored = clean.transform(add_feature, "alcohol_risk_score")
    scored = scored.transform(add_feature, "engagement_score")
    social = weighted_sum(scored.columns, SOCIAL_WEIGHTS)
    row = scored.selectExpr(
        f"min({social})", f"max({social})", "max(engagement_score)"
    ).first()
    return FeatureStats(*row)


def apply_features(clean: DataFrame, stats: FeatureStats) -> DataFrame:
    """All ten features with known extremes, in one projection; also fit for streams."""
    kept = [c for c in clean.columns if c not in FEATURE_COLUMNS]
    expressions = feature_expressions(kept, stats)
    return clean.select(*kept).selectExpr(
        "*", *[f"{text} AS {name}" for name, text in expressions.items()]
    )


def build_feature_set(clean: DataFrame, stats: FeatureStats | None = None) -> DataFrame:
    """All ten features; extremes come from ``clean`` itself unless given."""
    return apply_features(clean, stats or fit_features(clean))
