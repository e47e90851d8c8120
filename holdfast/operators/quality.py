"""Data quality rules: one report row per rule, all counts from one pass over the table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from holdfast.config import (
    GRADE_COLUMNS,
    ID,
    MINIMUM_ROWS,
    QUALITY_FEATURES,
    QUALITY_RANGES,
    QUALITY_RULES,
    REQUIRED_COLUMNS,
    TARGET,
)
from holdfast.functions.numbers import quoted, sql_text
from holdfast.operators.profiling import duplicate_count


def _non_empty(entries: list[tuple[str, str, str]]) -> str:
    """JSON object of the entries whose test holds: (key, test, JSON text expression)."""
    parts = ", ".join(
        f"CASE WHEN {test} THEN concat({sql_text(json.dumps(key) + ':')}, {text}) END"
        for key, test, text in entries
    )
    return f"concat('{{', concat_ws(',', {parts}), '}}')" if parts else "'{}'"


def _wrapped(key: str, inner: str) -> str:
    return f"concat({sql_text('{' + json.dumps(key) + ':')}, {inner}, '}}')"


def _names(names: list[str]) -> str:
    return sql_text(json.dumps(names, separators=(",", ":"), ensure_ascii=False))


def quality_report(df: DataFrame, min_rows: int = MINIMUM_ROWS) -> DataFrame:
    """``rule, test_name, severity, passed, details, rows_checked``; ``details`` is JSON.

    Rules about columns the frame lacks are left out where they could not be evaluated.
    """
    columns = [c for c in df.columns if c != ID]
    ranged = {c: bounds for c, bounds in QUALITY_RANGES.items() if c in columns}
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> str:
        # A column of the wrong type fails its own rule; the others read what they can of it.
        return c if isinstance(kinds[c], T.NumericType) else f"try_cast({c} AS DOUBLE)"

    measures = {"n": "count(1)"}
    for i, c in enumerate(columns):
        measures[f"null_{i}"] = f"count_if({quoted(c)} IS NULL)"
    for c, (low, high) in ranged.items():
        measures[f"out_{c}"] = f"count_if({number(c)} < {low} OR {number(c)} > {high})"
        measures[f"min_{c}"] = f"min(double({number(c)}))"
        measures[f"max_{c}"] = f"max(double({number(c)}))"
    if TARGET in columns:
        measures["class_0"] = f"count_if({number(TARGET)} = 0)"
        measures["class_1"] = f"count_if({number(TARGET)} = 1)"
        measures["other_class"] = f"count_if({number(TARGET)} NOT IN (0, 1))"
    if set(GRADE_COLUMNS) <= set(columns):
        first, second, final = (number(c) for c in GRADE_COLUMNS)
        measures["odd_grades"] = f"count_if({final} > 0 AND {first} = 0 AND {second} = 0)"

    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    absent_features = [c for c in QUALITY_FEATURES if c not in columns]
    wrong = {
        c: {"expected": "numeric", "found": kinds[c].simpleString()}
        for c in QUALITY_RANGES
        if c in columns and not isinstance(kinds[c], T.NumericType)
    }
    nulls = [(c, f"null_{i} > 0", f"null_{i}") for i, c in enumerate(columns)]
    violations = [
        (c, f"out_{c} > 0",
         f"concat('{{\"expected_range\":[{low},{high}],\"n_violations\":', out_{c}, "
         f"',\"min_found\":', min_{c}, ',\"max_found\":', max_{c}, '}}')")
        for c, (low, high) in ranged.items()
    ]
    rules = {
        "dq_required_columns": (f"{not missing}", _wrapped("missing_columns", _names(missing))),
        "dq_no_missing": (
            " AND ".join(f"null_{i} = 0" for i in range(len(columns))),
            _wrapped("columns_with_missing", _non_empty(nulls)),
        ),
        "dq_column_types": (
            f"{not wrong}",
            _wrapped("type_errors", sql_text(json.dumps(wrong, separators=(",", ":")))),
        ),
        "dq_value_ranges": (
            " AND ".join(f"out_{c} = 0" for c in ranged) or "true",
            _wrapped("violations", _non_empty(violations)),
        ),
        "dq_min_rows": (
            f"n >= {min_rows}",
            f"concat('{{\"n_rows\":', n, ',\"min_required\":{min_rows}}}')",
        ),
        "dq_feature_columns": (
            f"{not absent_features}", _wrapped("missing_features", _names(absent_features)),
        ),
    }
    if TARGET in columns:
        classes = [("0", "class_0 > 0", "class_0"), ("1", "class_1 > 0", "class_1"),
                   ("other", "other_class > 0", "other_class")]
        rules["dq_target_balance"] = (
            "class_0 > 0 AND class_1 > 0 AND other_class = 0",
            _wrapped("class_counts", _non_empty(classes)),
        )
    if "odd_grades" in measures:
        rules["dq_grade_consistency"] = (
            "odd_grades = 0", "concat('{\"incoherent_rows\":', odd_grades, '}')",
        )

    def row(rule: str, passed: str, details: str) -> str:
        title, severity = QUALITY_RULES[rule]
        title = title.format(min_rows=min_rows)
        return f"'{rule}', {sql_text(title)}, '{severity}', {passed}, {details}, n"

    census = df.selectExpr(*[f"{text} AS {quoted(name)}" for name, text in measures.items()])
    cells = ", ".join(row(rule, *rules[rule]) for rule in QUALITY_RULES if rule in rules)
    names = "(rule, test_name, severity, passed, details, rows_checked)"
    checked = census.selectExpr(f"stack({len(rules)}, {cells}) AS {names}")

    found = "concat('{\"duplicate_count\":', copies, '}')"
    duplicates = duplicate_count(df).selectExpr(
        f"stack(1, {row('dq_no_duplicates', 'copies = 0', found)}) AS {names}"
    )
    return checked.unionByName(duplicates)


def quality_summary(report: DataFrame) -> DataFrame:
    """``total_tests, passed, failed, overall_passed``; warnings do not count for the last."""
    return report.selectExpr(
        "count(1) AS total_tests",
        "count_if(passed) AS passed",
        "count_if(NOT passed) AS failed",
        "count_if(NOT passed AND severity = 'error') = 0 AS overall_passed",
    )
