"""The SQL check of the cleaning and feature steps, as a chain of common table expressions."""

from __future__ import annotations

import re

from catalog.students import SQL as RAW
from holdfast.config import (
    BINARY_COLUMNS,
    CATEGORICAL_COLUMNS,
    FEATURE_COLUMNS,
    ID,
    NUMERIC_COLUMNS,
    SOURCE_COLUMNS,
    TARGET,
    VALUE_RANGES,
)

COLUMNS = (ID, *SOURCE_COLUMNS)
FEATURE_TABLE = (*COLUMNS, *FEATURE_COLUMNS)


def r(expr: str, places: int) -> str:
    """Half-even rounding that never yields a negative zero."""
    return f"(round_even(CAST({expr} AS DOUBLE), {places}) + 0e0)"


def columns(*names: str) -> str:
    return ", ".join(names)


def number(c: str) -> str:
    return f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"


def target(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('true', '1', 'yes') THEN 1 ELSE 0 END"


def typed_column(c: str) -> str:
    if c in NUMERIC_COLUMNS:
        return f"{number(c)} AS {c}"
    if c in BINARY_COLUMNS:
        return f"CASE WHEN {c} = 'yes' THEN 1 ELSE 0 END AS {c}"
    if c == TARGET:
        return f"{target(c)} AS {c}"
    return c


def _mode(c: str, source: str) -> str:
    return (
        f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
    )


def _clip(c: str) -> str:
    if c not in VALUE_RANGES:
        return c
    low, high = VALUE_RANGES[c]
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < {low} THEN {low}e0 "
        f"WHEN {c} > {high} THEN {high}e0 ELSE {c} END AS {c}"
    )


TYPED_LIST = columns(*[typed_column(c) for c in COLUMNS])

UNIQUE = f"""uniq AS (
  SELECT min({ID}) AS {ID}, {columns(*SOURCE_COLUMNS)}
  FROM raw GROUP BY {columns(*SOURCE_COLUMNS)})"""
TYPED = f"typed AS (SELECT {TYPED_LIST} FROM uniq)"
TYPED_RAW = f"typed_raw AS (SELECT {TYPED_LIST} FROM raw)"
FILL = f"""medians AS (
  SELECT {columns(*[f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC_COLUMNS])} FROM typed),
modes AS (SELECT {columns(*[_mode(c, "typed") for c in CATEGORICAL_COLUMNS])}),
filled AS (
  SELECT {columns(*[
      f"coalesce(t.{c}, m.{c}) AS {c}" if c in NUMERIC_COLUMNS
      else f"coalesce(t.{c}, o.{c}) AS {c}" if c in CATEGORICAL_COLUMNS
      else f"t.{c}" for c in COLUMNS])}
  FROM typed t, medians m, modes o)"""
CLEAN = f"clean AS (SELECT {columns(*[_clip(c) for c in COLUMNS])} FROM filled)"

ACADEMIC = r("Grade_1 * 0.25e0 + Grade_2 * 0.35e0 + Final_Grade * 0.40e0", 2)
PROGRESSION = r("Grade_2 - Grade_1", 2)
ALCOHOL = r("Weekday_Alcohol_Consumption * 0.6e0 + Weekend_Alcohol_Consumption * 0.4e0", 2)
SUPPORT = r("Family_Relationship * 0.5e0 + Family_Support * 2.0e0 + School_Support * 1.5e0", 2)
ENGAGEMENT = r(
    "Study_Time * 0.4e0 + Wants_Higher_Education * 1.5e0 + Internet_Access * 0.5e0 "
    "+ Extra_Curricular_Activities * 0.5e0", 2)
PARENTS = r("(Mother_Education + Father_Education) / 2e0", 2)
ABSENCE = "CASE WHEN Number_of_Absences >= 10 THEN 1 ELSE 0 END"
FAILURE = "CASE WHEN Number_of_Failures > 0 THEN 1 ELSE 0 END"

FEATURES = f"""scores AS (
  SELECT *, {ACADEMIC} AS academic_performance_score, {PROGRESSION} AS grade_progression,
         {ALCOHOL} AS alcohol_risk_score, {SUPPORT} AS family_support_score,
         {ENGAGEMENT} AS engagement_score, {PARENTS} AS parental_education_level,
         {ABSENCE} AS absence_risk_flag, {FAILURE} AS failure_history_flag
  FROM clean),
social AS (
  SELECT *, Going_Out * 0.4e0 + alcohol_risk_score * 0.4e0 + Free_Time * 0.2e0 AS social_raw
  FROM scores),
extremes AS (
  SELECT min(social_raw) AS lo, max(social_raw) AS hi, max(engagement_score) AS top FROM social),
indexed AS (
  SELECT s.*, {r("(social_raw - lo) / nullif(hi - lo, 0e0)", 3)} AS social_risk_index, top
  FROM social s, extremes),
features AS (
  SELECT {columns(*FEATURE_TABLE[:-1])},
    {r('''(1e0 - CASE WHEN academic_performance_score / 20e0 < 0 THEN 0e0
               WHEN academic_performance_score / 20e0 > 1 THEN 1e0
               ELSE academic_performance_score / 20e0 END) * 0.35e0
       + social_risk_index * 0.20e0 + absence_risk_flag * 0.20e0
       + failure_history_flag * 0.15e0
       + (1e0 - engagement_score / nullif(top, 0e0)) * 0.10e0''', 3)} AS combined_risk_score
  FROM indexed)"""

def _renamed(text: str, **names: str) -> str:
    for old, new in names.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


# New rows by what was fitted above: medians and modes of the unique rows, extremes of their features.
NEW_FEATURES = ",\n".join([
    TYPED_RAW,
    _renamed(FILL[FILL.index("filled AS"):], filled="new_filled", typed="typed_raw"),
    _renamed(CLEAN, clean="new_clean", filled="new_filled"),
    _renamed(re.sub(r"extremes AS \(.*?FROM social\),\n", "", FEATURES, flags=re.DOTALL),
             clean="new_clean", scores="new_scores", social="new_social", indexed="new_indexed", features="new_features"),
])

STEPS = {
    "raw": [RAW],
    "unique": [RAW, UNIQUE],
    "typed_raw": [RAW, TYPED_RAW],
    "typed": [RAW, UNIQUE, TYPED],
    "filled": [RAW, UNIQUE, TYPED, FILL],
    "clean": [RAW, UNIQUE, TYPED, FILL, CLEAN],
    "features": [RAW, UNIQUE, TYPED, FILL, CLEAN, FEATURES],
}


def after(step: str, body: str, *more: str) -> str:
    """``body`` with everything up to ``step`` in front, then any further expressions."""
    return "WITH " + ",\n".join([*STEPS[step], *more]) + "\n" + body
