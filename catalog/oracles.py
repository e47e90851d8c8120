"""SQL that each registered query must equal."""

from __future__ import annotations

from catalog import chain
from catalog.chain import after, columns, r, target
from holdfast.config import (
    BINARY_COLUMNS,
    CATEGORICAL_COLUMNS,
    CLASS_NAMES,
    CORRELATION_COLUMNS,
    FEATURE_COLUMNS,
    ID,
    MISSING_TOKENS,
    MODEL_CHECKS,
    MODEL_NUMERIC_COLUMNS,
    MODELS,
    NUMERIC_COLUMNS,
    QUALITY_RULES,
    REQUEST_FIELDS,
    SCALED_COLUMNS,
    SOURCE_COLUMNS,
    TARGET,
    UPLOAD_FIELDS,
    VALUE_RANGES,
)

ORACLES: dict[str, str] = {}

ORACLES["trim_columns"] = after("raw", "SELECT * FROM raw")
ORACLES["drop_duplicates"] = after("unique", "SELECT * FROM uniq")
ORACLES["normalise_target"] = after("raw", f"SELECT {ID}, {target(TARGET)} AS {TARGET} FROM raw")
ORACLES["map_binary"] = after("typed_raw", f"SELECT {columns(ID, *BINARY_COLUMNS)} FROM typed_raw")
ORACLES["coerce_numeric"] = after(
    "typed_raw", f"SELECT {columns(ID, *NUMERIC_COLUMNS)} FROM typed_raw")
ORACLES["impute_median"] = after("filled", f"SELECT {columns(ID, *NUMERIC_COLUMNS)} FROM filled")
ORACLES["impute_mode"] = after("filled", f"SELECT {columns(ID, *CATEGORICAL_COLUMNS)} FROM filled")
ORACLES["flag_zero_grades"] = after(
    "filled",
    "SELECT count(*) FILTER (Grade_1 = 0 AND Grade_2 = 0 AND Final_Grade > 0) "
    "AS zero_grade_rows FROM filled",
)
ORACLES["clip_ranges"] = after(
    "typed",
    f"SELECT {columns(*[chain._clip(c) for c in (ID, *NUMERIC_COLUMNS)])} FROM typed",
)
ORACLES["clean"] = after("clean", "SELECT * FROM clean")


def _count(check: str, c: str, test: str, source: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{c}' AS \"column\", count(*) FILTER ({test}) AS n "
        f"FROM {source}"
    )


ORACLES["clean_audit"] = after("filled", "\nUNION ALL ".join(
    [_count("unexpected_binary", c, f"{c} IS NULL OR {c} NOT IN ('yes', 'no')", "uniq")
     for c in BINARY_COLUMNS]
    + [_count("imputed_median", c, f"{c} IS NULL", "typed") for c in NUMERIC_COLUMNS]
    + [_count("imputed_mode", c, f"{c} IS NULL", "typed") for c in CATEGORICAL_COLUMNS]
    + [_count("zero_grades", "Grade_1",
              "Grade_1 = 0 AND Grade_2 = 0 AND Final_Grade > 0", "filled")]
    + [_count("out_of_range", c, f"{c} < {low} OR {c} > {high}", "filled")
       for c, (low, high) in VALUE_RANGES.items()]
    + ["SELECT 'duplicates', '*', (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq)"]
))

for _feature in FEATURE_COLUMNS:
    ORACLES[_feature] = after("features", f"SELECT {ID}, {_feature} FROM features")
ORACLES["build_feature_set"] = after("features", "SELECT * FROM features")


# Profiles and cohorts.

_RATE = (
    f"SELECT count(*) AS n_students, {r('sum(Dropped_Out) / nullif(count(*), 0)', 4)} "
    "AS dropout_rate FROM typed_raw WHERE "
)
_LOW = "Grade_1 <= 10 AND Grade_2 <= 10 AND Final_Grade <= 10"
ORACLES["low_grade_cohort"] = after("typed_raw", _RATE + _LOW)
ORACLES["low_grade_sample"] = after(
    "typed_raw",
    "SELECT student_id, Grade_1, Grade_2, Final_Grade, Number_of_Absences, Dropped_Out "
    f"FROM typed_raw WHERE {_LOW} ORDER BY student_id LIMIT 20",
)
ORACLES["zero_final_cohort"] = after("typed_raw", _RATE + "Final_Grade = 0")
ORACLES["high_absence_cohort"] = after("typed_raw", _RATE + "Number_of_Absences > 20")

_ALL_FEATURES = [c for c in chain.FEATURE_TABLE if c != ID]


def table_stats_sql(source: str, names: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in names)
    return f"""SELECT 'n_students' AS stat, CAST(count(*) AS DOUBLE) AS value FROM {source}
UNION ALL SELECT 'n_features', {len(names)}e0
UNION ALL SELECT 'dropout_rate_pct', {r('avg(Dropped_Out) * 100', 2)} FROM {source}
UNION ALL SELECT 'missing_values', CAST({nulls} AS DOUBLE) FROM {source}
UNION ALL SELECT 'duplicates', CAST((SELECT count(*) FROM {source}) - (SELECT count(*) FROM
  (SELECT DISTINCT {columns(*names)} FROM {source})) AS DOUBLE)"""


ORACLES["table_stats"] = after("features", table_stats_sql("features", _ALL_FEATURES))


def summary_sql(source: str, names: list[str]) -> str:
    parts = []
    for c in names:
        stats = {
            "count": "count(x)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)",
            "25%": "quantile_cont(x, 0.25)", "50%": "quantile_cont(x, 0.5)",
            "75%": "quantile_cont(x, 0.75)", "max": "max(x)",
        }
        cells = ", ".join(f"{r(text, 2)} AS \"{name}\"" for name, text in stats.items())
        parts.append(f"SELECT '{c}' AS \"column\", {cells} "
                     f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source})")
    stat_names = ", ".join(f'"{s}"' for s in
                           ("count", "mean", "std", "min", "25%", "50%", "75%", "max"))
    return (
        "SELECT \"column\", stat, value FROM (" + "\nUNION ALL ".join(parts)
        + f") UNPIVOT (value FOR stat IN ({stat_names}))"
    )


_NUMERIC = [c for c in _ALL_FEATURES if c not in CATEGORICAL_COLUMNS]
ORACLES["numeric_summary"] = after("features", summary_sql("features", _NUMERIC))
ORACLES["numeric_summary_lineitem"] = summary_sql(
    "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])

_STATUS = "CASE Dropped_Out WHEN 0 THEN 'Actif' WHEN 1 THEN 'Décroché' END"
ORACLES["target_distribution"] = after(
    "features",
    f"SELECT Dropped_Out, {_STATUS} AS label, count(*) AS count FROM features GROUP BY 1, 2",
)
ORACLES["grade_histogram"] = after("features", "\nUNION ALL ".join(
    f"SELECT '{c}' AS grade, {_STATUS} AS status, CAST(floor({c}) AS BIGINT) AS bin, "
    "count(*) AS count FROM features GROUP BY 2, 3"
    for c in ("Grade_1", "Grade_2", "Final_Grade")
))


def correlation_sql(source: str, names: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})', 2)} AS correlation "
        f"FROM {source}"
        for a in names for b in names
    )


ORACLES["correlation_matrix"] = after(
    "features", correlation_sql("features", list(CORRELATION_COLUMNS)))
ORACLES["correlation_matrix_with_nulls"] = after("typed", correlation_sql(
    "typed", [c for c in CORRELATION_COLUMNS if c not in FEATURE_COLUMNS]))
ORACLES["absence_box"] = after(
    "features",
    """SELECT status, q1, median, q3, count(*) AS count, min(x) AS min, max(x) AS max,
  min(x) FILTER (x BETWEEN lo AND hi) AS low_whisker,
  max(x) FILTER (x BETWEEN lo AND hi) AS high_whisker,
  count(*) FILTER (x NOT BETWEEN lo AND hi) AS outliers
FROM (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM box) b
JOIN rows_by_status USING (status) GROUP BY status, q1, median, q3""",
    f"rows_by_status AS (SELECT {_STATUS} AS status, Number_of_Absences AS x FROM features)",
    "box AS (SELECT status, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, "
    "quantile_cont(x, 0.75) AS q3 FROM rows_by_status GROUP BY status)",
)
ORACLES["study_time_by_status"] = after(
    "features",
    "SELECT * FROM (SELECT CASE Study_Time WHEN 1 THEN '<2h' WHEN 2 THEN '2-5h' "
    "WHEN 3 THEN '5-10h' WHEN 4 THEN '>10h' END AS study_time, "
    f"{_STATUS} AS status, count(*) AS count FROM features GROUP BY 1, 2) "
    "WHERE study_time IS NOT NULL",
)
ORACLES["risk_histogram"] = after(
    "features",
    f"SELECT status, bin, {r('lo + bin * width', 6)} AS bin_start, count(*) AS count FROM ("
    f"SELECT {_STATUS} AS status, lo, width, "
    "least(CAST(floor((combined_risk_score - lo) / width) AS BIGINT), 29) AS bin "
    "FROM features, edges) GROUP BY status, bin, lo, width",
    "edges AS (SELECT min(combined_risk_score) AS lo, "
    "(max(combined_risk_score) - min(combined_risk_score)) / 30e0 AS width FROM features)",
)
_INSIGHTS = {
    "dropout_rate_pct": r("avg(Dropped_Out) * 100", 2),
    "dropout_rate_with_failure_pct": r("avg(Dropped_Out) FILTER (Number_of_Failures > 0) * 100", 2),
    "dropout_rate_high_absence_pct": r("avg(Dropped_Out) FILTER (absence_risk_flag = 1) * 100", 2),
    "avg_final_grade_dropout": r("avg(Final_Grade) FILTER (Dropped_Out = 1)", 2),
    "avg_final_grade_active": r("avg(Final_Grade) FILTER (Dropped_Out = 0)", 2),
    "combined_risk_score_correlation": r("corr(combined_risk_score, Dropped_Out)", 3),
}
_INSIGHT_ROWS = "\nUNION ALL ".join(
    f"SELECT '{name}' AS insight, {text} AS value FROM features"
    for name, text in _INSIGHTS.items()
)
ORACLES["insights"] = after("features", _INSIGHT_ROWS)
ORACLES["save_eda_report"] = after("features", f"""
SELECT 'statistics' AS section, 'table' AS item, stat, value
FROM ({table_stats_sql("features", _ALL_FEATURES)})
UNION ALL SELECT 'numeric_summary', "column", stat, value
FROM ({summary_sql("features", _NUMERIC)})
UNION ALL SELECT 'insights', 'table', insight, value FROM ({_INSIGHT_ROWS})""")
_PROFILES = {
    "target_distribution": (("Dropped_Out", "label"), ("count",)),
    "grade_histogram": (("grade", "status", "bin"), ("count",)),
    "correlation_matrix": (("column_a", "column_b"), ("correlation",)),
    "absence_box": (("status",), (
        "q1", "median", "q3", "count", "min", "max", "low_whisker", "high_whisker", "outliers")),
    "study_time_by_status": (("study_time", "status"), ("count",)),
    "risk_histogram": (("status", "bin"), ("bin_start", "count")),
}
ORACLES["run_eda"] = (
    "WITH " + ",\n".join(f"t_{name} AS ({ORACLES[name]})" for name in (*_PROFILES, "save_eda_report"))
    + "\nSELECT * FROM t_save_eda_report" + "".join(
        f"\nUNION ALL SELECT '{name}', concat_ws('|', {columns(*keys)}), '{stat}', CAST({stat} AS DOUBLE) FROM t_{name}"
        for name, (keys, stats) in _PROFILES.items() for stat in stats))


# Quality rules, on typed raw rows and on the encoded feature table.

_RANGES = {**VALUE_RANGES, TARGET: (0, 1)}


def quality_sql(source: str, names: list[str], duplicates_by: list[str], has_features: bool) -> str:
    def row(rule: str, title: str, severity: str, passed: str, details: str) -> str:
        return (
            f"SELECT '{rule}' AS rule, '{title}' AS test_name, '{severity}' AS severity, "
            f"{passed} AS passed, {details} AS details, count(*) AS rows_checked FROM {source}"
        )

    nulls = ", ".join(
        f"CASE WHEN count(*) FILTER (\"{c}\" IS NULL) > 0 THEN "
        f"'\"{c}\":' || count(*) FILTER (\"{c}\" IS NULL) END" for c in names
    )
    any_null = " OR ".join(f"\"{c}\" IS NULL" for c in names)
    out = {c: f"{c} < {lo} OR {c} > {hi}" for c, (lo, hi) in _RANGES.items()}
    violations = ", ".join(
        f"CASE WHEN count(*) FILTER ({out[c]}) > 0 THEN '\"{c}\":{{\"expected_range\":[{lo},{hi}],"
        f"\"n_violations\":' || count(*) FILTER ({out[c]}) || ',\"min_found\":' "
        f"|| min(CAST({c} AS DOUBLE)) || ',\"max_found\":' || max(CAST({c} AS DOUBLE)) || '}}' END"
        for c, (lo, hi) in _RANGES.items()
    )
    classes = ", ".join(
        f"CASE WHEN count(*) FILTER ({TARGET} = {k}) > 0 "
        f"THEN '\"{k}\":' || count(*) FILTER ({TARGET} = {k}) END" for k in (0, 1)
    )
    odd = "Final_Grade > 0 AND Grade_1 = 0 AND Grade_2 = 0"
    copies = (
        f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns(*duplicates_by)} "
        f"FROM {source})))"
    )
    missing = [] if has_features else [
        "academic_performance_score", "grade_progression", "alcohol_risk_score",
        "social_risk_index", "engagement_score", "combined_risk_score", "absence_risk_flag",
        "failure_history_flag",
    ]
    listed = ",".join(f'"{m}"' for m in missing)
    return "\nUNION ALL ".join([
        row("dq_required_columns", "Colonnes requises présentes", "error", "true",
            "'{\"missing_columns\":[]}'"),
        row("dq_no_missing", "Absence de valeurs manquantes", "error",
            f"count(*) FILTER ({any_null}) = 0",
            f"'{{\"columns_with_missing\":{{' || concat_ws(',', {nulls}) || '}}}}'"),
        row("dq_no_duplicates", "Absence de doublons", "warning", f"{copies} = 0",
            f"'{{\"duplicate_count\":' || {copies} || '}}'"),
        row("dq_column_types", "Types de colonnes corrects", "error", "true",
            "'{\"type_errors\":{}}'"),
        row("dq_value_ranges", "Valeurs dans les plages attendues", "warning",
            f"count(*) FILTER ({' OR '.join(out.values())}) = 0",
            f"'{{\"violations\":{{' || concat_ws(',', {violations}) || '}}}}'"),
        row("dq_target_balance", "Variable cible non dégénérée (2 classes)", "error",
            f"count(DISTINCT {TARGET}) = 2",
            f"'{{\"class_counts\":{{' || concat_ws(',', {classes}) || '}}}}'"),
        row("dq_grade_consistency", "Cohérence des notes (G1, G2, Final)", "warning",
            f"count(*) FILTER ({odd}) = 0",
            f"'{{\"incoherent_rows\":' || count(*) FILTER ({odd}) || '}}'"),
        row("dq_min_rows", "Dataset contient au moins 100 lignes", "error", "count(*) >= 100",
            "'{\"n_rows\":' || count(*) || ',\"min_required\":100}'"),
        row("dq_feature_columns", "Features engineered présentes", "warning",
            "true" if has_features else "false", f"'{{\"missing_features\":[{listed}]}}'"),
    ])


_RAW_QUALITY = quality_sql("typed_raw", list(SOURCE_COLUMNS), list(SOURCE_COLUMNS), False)
for _rule in QUALITY_RULES:
    ORACLES[_rule] = after("typed_raw", f"SELECT * FROM ({_RAW_QUALITY}) WHERE rule = '{_rule}'")
ORACLES["quality_summary"] = after("typed_raw", f"""SELECT count(*) AS total_tests,
  count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  count(*) FILTER (NOT passed AND severity = 'error') = 0 AS overall_passed
FROM ({_RAW_QUALITY})""")

# The texts that occur in each text column.
_JOBS = ("at_home", "health", "other", "services", "teacher")
TEXT_VALUES = {
    "School": ("GP", "MS"),
    "Gender": ("F", "M"),
    "Address": ("R", "U"),
    "Family_Size": ("GT3", "LE3"),
    "Parental_Status": ("A", "T"),
    "Mother_Job": _JOBS,
    "Father_Job": _JOBS,
    "Reason_for_Choosing_School": ("course", "home", "other", "reputation"),
    "Guardian": ("father", "mother", "other"),
}
_HOT = [
    f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\""
    for c, values in TEXT_VALUES.items() for v in values
]
_HOT_NAMES = [f"{c}_{v}" for c, values in TEXT_VALUES.items() for v in values]


def encoded_cte(source: str, names: tuple[str, ...]) -> str:
    kept = [c for c in names if c not in CATEGORICAL_COLUMNS]
    return f"encoded AS (SELECT {columns(*kept, *_HOT)} FROM {source})"


_ENCODED_NAMES = [
    c for c in chain.FEATURE_TABLE if c not in CATEGORICAL_COLUMNS and c != ID] + _HOT_NAMES
ENCODED = encoded_cte("features", chain.FEATURE_TABLE)
ORACLES["quality_report"] = after(
    "features", quality_sql("encoded", _ENCODED_NAMES, _ENCODED_NAMES, True), ENCODED)


# Encoding, split and scaling.

ORACLES["one_hot"] = after(
    "clean", "SELECT * FROM encoded", encoded_cte("clean", chain.COLUMNS))
_LABELLED = (*CATEGORICAL_COLUMNS, *BINARY_COLUMNS)


def codes_cte(fitted_on: str) -> list[str]:
    """Per column, each known text with its rank."""
    return [
        f"codes_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code "
        f"FROM (SELECT DISTINCT {c} FROM {fitted_on} WHERE {c} IS NOT NULL))"
        for c in _LABELLED
    ]


def encode_sql(source: str, kept: str) -> str:
    codes = [
        f"CAST(coalesce(c_{c}.code, (SELECT count(*) FROM codes_{c})) AS INTEGER) AS {c}"
        for c in _LABELLED
    ]
    joins = " ".join(f"LEFT JOIN codes_{c} c_{c} ON c_{c}.v = t.{c}" for c in _LABELLED)
    return f"SELECT {kept}, {columns(*codes)} FROM {source} t {joins}"


ORACLES["label_encode"] = after("unique", encode_sql("uniq", "t.student_id"), *codes_cte("uniq"))
ORACLES["label_encode_apply"] = after(
    "raw", encode_sql("raw", "t.student_id, t.Age"),
    "young AS (SELECT * FROM raw WHERE Age < '20')", *codes_cte("young"),
)

_ORDER_TEXTS = """texts AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS price,
    o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""
_ORDER_COLUMNS = ("customer", "price", "status", "priority")
_ORDER_CODES = [
    f"codes_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code "
    f"FROM (SELECT DISTINCT {c} FROM texts WHERE {c} IS NOT NULL AND priority <> '1-URGENT'))"
    for c in _ORDER_COLUMNS
]
_ORDER_JOINS = " ".join(f"LEFT JOIN codes_{c} c_{c} ON c_{c}.v = t.{c}" for c in _ORDER_COLUMNS)
ORACLES["label_encode_orders"] = f"WITH {', '.join([_ORDER_TEXTS, *_ORDER_CODES])} SELECT o_orderkey, " + columns(*[
    f"coalesce(c_{c}.code, (SELECT count(*) FROM codes_{c})) AS {c}" for c in _ORDER_COLUMNS
]) + f" FROM texts t {_ORDER_JOINS}"
ORACLES["one_hot_sparse"] = f"WITH {', '.join([_ORDER_TEXTS, *_ORDER_CODES])} " + " UNION ALL ".join(
    f"SELECT o_orderkey, CAST(code" + "".join(f" + (SELECT count(*) FROM codes_{b})" for b in _ORDER_COLUMNS[:i])
    + f" AS BIGINT) AS place FROM texts t JOIN codes_{c} ON v = t.{c}"
    for i, c in enumerate(_ORDER_COLUMNS))

_MODEL_NAMES = list(dict.fromkeys([*MODEL_NUMERIC_COLUMNS, *BINARY_COLUMNS, *_HOT_NAMES]))
ORACLES["select_features"] = after(
    "features", f"SELECT {columns(ID, TARGET, *_MODEL_NAMES)} FROM encoded", ENCODED)

SPLIT = """sizes AS (
  SELECT Dropped_Out AS class, count(*) AS n, sum(count(*)) OVER () AS total
  FROM features GROUP BY Dropped_Out),
exact_sizes AS (
  SELECT class, CAST(ceil(round(0.2e0 * total, 9)) AS BIGINT) AS wanted,
         ceil(round(0.2e0 * total, 9)) * n / total AS exact FROM sizes),
test_sizes AS (
  SELECT class, CAST(floor(exact) AS BIGINT) + CASE WHEN
    row_number() OVER (ORDER BY floor(exact) - exact, class)
    <= wanted - sum(CAST(floor(exact) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS n_test
  FROM exact_sizes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Dropped_Out
    ORDER BY md5(concat('42', ':', CAST(student_id AS VARCHAR)))) AS place FROM encoded),
parts AS (
  SELECT r.*, CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN test_sizes t ON t.class = r.Dropped_Out)"""
ORACLES["stratified_split"] = after(
    "features", "SELECT student_id, Dropped_Out, split FROM parts", ENCODED, SPLIT)


def _scaled(c: str, places: int | None) -> str:
    text = (
        f"({c} - (SELECT avg({c}) FROM parts WHERE split = 'train')) / coalesce(nullif("
        f"(SELECT stddev_pop({c}) FROM parts WHERE split = 'train'), 0), 1)"
    )
    return f"{r(text, places)} AS {c}"


ORACLES["standard_scale"] = after(
    "features",
    f"SELECT student_id, split, {columns(*[_scaled(c, 6) for c in SCALED_COLUMNS])} FROM parts",
    ENCODED, SPLIT,
)


# Sources, sinks and the data pipeline.

_TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
READ_BACK = (
    "read_back AS (SELECT student_id, "
    + columns(*[f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}"
                for c in SOURCE_COLUMNS])
    + " FROM raw)"
)
UPLOAD_NAMES = {source: field for field, source, _, _ in REQUEST_FIELDS if field in UPLOAD_FIELDS}
_RENAMED = columns(ID, *[
    f"{c} AS {UPLOAD_NAMES[c]}" if c in UPLOAD_NAMES else c for c in SOURCE_COLUMNS])
ORACLES["load_raw"] = after("raw", "SELECT * FROM read_back", READ_BACK)
ORACLES["load_upload"] = after("raw", f"SELECT {_RENAMED} FROM read_back", READ_BACK)
ORACLES["save_processed"] = after("features", "SELECT * FROM encoded", ENCODED)
ORACLES["save_features"] = ORACLES["build_feature_set"]

_SCALED_ROWS = (
    f"scaled AS (SELECT student_id, Dropped_Out, split, "
    + columns(*[_scaled(c, 6) if c in SCALED_COLUMNS else c for c in _MODEL_NAMES])
    + " FROM parts)"
)
ORACLES["save_ml_datasets"] = after(
    "features", "SELECT * FROM scaled", ENCODED, SPLIT, _SCALED_ROWS)
ORACLES["load_ml_datasets"] = after(
    "features", "SELECT * FROM scaled",
    ENCODED, SPLIT, _SCALED_ROWS)
ORACLES["prepare_registered"] = after(
    "features",
    f"SELECT student_id, {columns(*[_scaled(c, 6) if c in SCALED_COLUMNS else c for c in _MODEL_NAMES])} FROM new_encoded",
    ENCODED, SPLIT, chain.NEW_FEATURES,
    ENCODED.replace("encoded AS", "new_encoded AS").replace("FROM features", "FROM new_features"))
ORACLES["build_ml_dataset"] = after(
    "features",
    "SELECT split, Dropped_Out, count(*) AS n, "
    + columns(*[f"{r(f'avg({c})', 4)} AS avg_{c}" for c in FEATURE_COLUMNS])
    + " FROM scaled GROUP BY split, Dropped_Out",
    ENCODED, SPLIT, _SCALED_ROWS)
ORACLES["save_quality_report"] = after("typed_raw", _RAW_QUALITY)
ORACLES["run_etl"] = ORACLES["one_hot"]
ORACLES["data_pipeline"] = after("features", f"""
SELECT 'raw' AS stage, count(*) AS rows, {len(SOURCE_COLUMNS)} AS columns FROM raw
UNION ALL SELECT 'features', count(*), {len(_ALL_FEATURES)} FROM features
UNION ALL SELECT 'encoded', count(*), {len(_ENCODED_NAMES)} FROM encoded
UNION ALL SELECT split, count(*), {len(_MODEL_NAMES)} FROM parts GROUP BY split""", ENCODED, SPLIT)


# Metrics and comparison.

_DECIDED = "CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction"
PREDICTIONS = f"""scores_by_rule AS (
  SELECT 'baseline_majority' AS model, student_id, Dropped_Out AS label,
    (SELECT CAST(Dropped_Out AS DOUBLE) FROM features GROUP BY Dropped_Out
     ORDER BY count(*) DESC, Dropped_Out LIMIT 1) AS score FROM features
  UNION ALL SELECT 'combined_risk', student_id, Dropped_Out, combined_risk_score FROM features
  UNION ALL SELECT 'final_grade', student_id, Dropped_Out, {r('(20 - Final_Grade) / 20', 3)}
    FROM features
  UNION ALL SELECT 'absences', student_id, Dropped_Out, {r('Number_of_Absences / 32', 3)}
    FROM features),
predictions AS (SELECT *, {_DECIDED} FROM scores_by_rule),
tallies AS (
  SELECT model, count(*) AS n, {columns(*[
      f"count(*) FILTER (label = {k}) AS s_{k}, count(*) FILTER (prediction = {k}) AS p_{k}, "
      f"count(*) FILTER (label = {k} AND prediction = {k}) AS t_{k}" for k in (0, 1)])}
  FROM predictions GROUP BY model),
per_class AS (
  SELECT *, {columns(*[
      f"coalesce(t_{k} / nullif(CAST(p_{k} AS DOUBLE), 0), 0) AS pr_{k}, "
      f"coalesce(t_{k} / nullif(CAST(s_{k} AS DOUBLE), 0), 0) AS re_{k}, "
      f"coalesce(2 * t_{k} / nullif(CAST(s_{k} + p_{k} AS DOUBLE), 0), 0) AS f_{k}"
      for k in (0, 1)])}
  FROM tallies),
placed AS (
  SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
    + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS place FROM predictions),
areas AS (
  SELECT model, (sum(place) FILTER (label = 1) - p * (p + 1) / 2e0) / (p * q) AS area
  FROM (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY model) AS p,
               count(*) FILTER (label = 0) OVER (PARTITION BY model) AS q FROM placed)
  GROUP BY model, p, q),
measured AS (
  SELECT model, {r('(t_0 + t_1) / CAST(n AS DOUBLE)', 4)} AS accuracy,
    {columns(*[f"{r(f'({x}_0 * s_0 + {x}_1 * s_1) / CAST(s_0 + s_1 AS DOUBLE)', 4)} AS {name}"
               for x, name in (("f", "f1"), ("pr", "precision"), ("re", "recall"))])},
    {r('area', 4)} AS roc_auc
  FROM per_class JOIN areas USING (model))"""
ORACLES["baseline_majority"] = after(
    "features",
    "SELECT student_id, CAST(score AS INTEGER) AS prediction, score FROM predictions "
    "WHERE model = 'baseline_majority'", PREDICTIONS)
ORACLES["balanced_weights"] = after(
    "features",
    "SELECT student_id, Dropped_Out, total / (2e0 * n) AS class_weight FROM features "
    "JOIN (SELECT Dropped_Out, count(*) AS n, sum(count(*)) OVER () AS total FROM features "
    "GROUP BY Dropped_Out) USING (Dropped_Out)")
ORACLES["classification_metrics"] = after("features", "SELECT * FROM measured", PREDICTIONS)
ORACLES["confusion_matrix"] = after(
    "features",
    "SELECT model, label, prediction, count(p.student_id) AS count FROM "
    "(SELECT DISTINCT model FROM predictions) CROSS JOIN "
    "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(label, prediction) "
    "LEFT JOIN predictions p USING (model, label, prediction) GROUP BY 1, 2, 3", PREDICTIONS)
_HITS = "(t_0 + t_1) / CAST(n AS DOUBLE)"
ORACLES["class_report"] = after(
    "features",
    "SELECT model, 'Actif (0)' AS class, pr_0 AS precision, re_0 AS recall, f_0 AS f1, "
    "s_0 AS support FROM per_class "
    "UNION ALL SELECT model, 'Décroché (1)', pr_1, re_1, f_1, s_1 FROM per_class "
    f"UNION ALL SELECT model, 'accuracy', {_HITS}, {_HITS}, {_HITS}, n FROM per_class "
    "UNION ALL SELECT model, 'macro avg', (pr_0 + pr_1) / 2, (re_0 + re_1) / 2, (f_0 + f_1) / 2, "
    "n FROM per_class UNION ALL SELECT model, 'weighted avg', "
    + columns(*[f"({x}_0 * s_0 + {x}_1 * s_1) / CAST(s_0 + s_1 AS DOUBLE)"
                for x in ("pr", "re", "f")])
    + ", n FROM per_class", PREDICTIONS)
_RANKED = """ranks AS (
  SELECT CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank, *,
    CAST(NULL AS DOUBLE) AS train_time_s, CAST(NULL AS DOUBLE) AS inference_time_ms,
    model AS run_id FROM measured)"""
ORACLES["comparison_table"] = after("features", "SELECT * FROM ranks", PREDICTIONS, _RANKED)


def _norm(m: str) -> str:
    return (
        f"CASE WHEN max({m}) OVER () > min({m}) OVER () THEN ({m} - min({m}) OVER ()) "
        f"/ (max({m}) OVER () - min({m}) OVER ()) ELSE 1e0 END AS {m}_norm"
    )


_COMPOSITE = f"""norms AS (
  SELECT *, {columns(*[_norm(m) for m in ("f1", "roc_auc", "accuracy", "recall")])} FROM ranks),
composite AS (
  SELECT *, {r('f1_norm * 0.40e0 + roc_auc_norm * 0.30e0 + accuracy_norm * 0.20e0 '
               '+ recall_norm * 0.10e0', 4)} AS composite_score FROM norms),
best AS (
  SELECT *, printf('''%s'' sélectionné avec F1=%.4f, ROC-AUC=%.4f, score composite=%.4f. '
    || 'F1 priorisé car dataset déséquilibré (15%% décrochage).', model, f1, roc_auc,
    composite_score) AS justification
  FROM composite ORDER BY composite_score DESC, rank LIMIT 1)"""
ORACLES["composite_score"] = after(
    "features", "SELECT * FROM composite", PREDICTIONS, _RANKED, _COMPOSITE)
ORACLES["select_best"] = after(
    "features", "SELECT * FROM best", PREDICTIONS, _RANKED, _COMPOSITE)
ORACLES["save_comparison_report"] = after(
    "features",
    "SELECT c.*, b.justification FROM composite c LEFT JOIN best b USING (model)",
    PREDICTIONS, _RANKED, _COMPOSITE)


# Scoring steps.

ORACLES["rename_for_scoring"] = after("raw", f"SELECT {_RENAMED} FROM raw")
_ABSENT = ("travel_time", "grade_2")
ORACLES["require_columns"] = after("raw", "\nUNION ALL ".join(
    f"SELECT '{field}' AS \"column\", false AS present, CAST(0 AS BIGINT) AS filled"
    if field in _ABSENT
    else f"SELECT '{field}' AS \"column\", true AS present, count({source}) AS filled FROM raw"
    for source, field in UPLOAD_NAMES.items()
))


def _whole(c: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS INTEGER)"


_GIVEN = {"Family_Relationship", "Mother_Job", "Internet_Access", "Health_Status", *UPLOAD_NAMES}
ORACLES["default_fields"] = after("raw", "SELECT student_id, " + columns(*[
    (f"{_whole(source)} AS {field}" if kind == "int" else f"{source} AS {field}")
    if source in _GIVEN
    else (f"{default} AS {field}" if kind == "int" else f"'{default}' AS {field}")
    for field, source, kind, default in REQUEST_FIELDS
]) + " FROM raw")
ORACLES["to_model_columns"] = after("raw", "SELECT student_id, " + columns(*[
    f"{_whole(source)} AS {source}" if kind == "int" else source
    for _, source, kind, _ in REQUEST_FIELDS
]) + ", 'course' AS Reason_for_Choosing_School, 'mother' AS Guardian FROM raw")
ORACLES["align_columns"] = after(
    "clean",
    "SELECT student_id, Final_Grade, Age, Dropped_Out, 0 AS Attendance, 0 AS School_GP FROM clean")
_BAND = (
    "CASE WHEN score < 0.4 THEN 'Faible' WHEN score < 0.6 THEN 'Moyenne' "
    "WHEN score < 0.8 THEN 'Forte' ELSE 'Tres forte' END AS confidence"
)
_PERCENT = "round_even(score * 100, 1)"
SCORED = (
    "scored AS (SELECT *, combined_risk_score AS score FROM features)",
    "displayed AS (SELECT student_id, School AS school, Gender AS sex, Age AS age, "
    "Number_of_Absences AS absences, Grade_1 AS grade_1, Grade_2 AS grade_2, "
    "Final_Grade AS final_grade, CASE WHEN score > 0.5 THEN 'Dropout' ELSE 'Active' END "
    f"AS prediction, printf('%.1f%%', {_PERCENT}) AS probability, {_BAND}, score FROM scored)",
)
ORACLES["score_decision"] = after(
    "features", f"SELECT student_id, score, {_DECIDED} FROM scored", *SCORED)
ORACLES["confidence_band"] = after(
    "features", f"SELECT student_id, score, {_BAND} FROM scored", *SCORED)
ORACLES["score_display"] = after(
    "features", "SELECT * EXCLUDE (score) FROM displayed", *SCORED)
ORACLES["score_limit"] = after(
    "features",
    "SELECT * EXCLUDE (score) FROM displayed ORDER BY student_id LIMIT 100", *SCORED)
_AT_RISK = "SELECT * EXCLUDE (score) FROM displayed WHERE prediction = 'Dropout' AND "
ORACLES["at_risk_filter"] = after(
    "features",
    _AT_RISK + f"age BETWEEN 16 AND 21 AND school = 'GP' AND {_PERCENT} / 100 >= 0.6", *SCORED)
ORACLES["export_results"] = after(
    "features", _AT_RISK + f"age BETWEEN 15 AND 30 AND {_PERCENT} / 100 >= 0.5", *SCORED)


# Trained results: ids, labels, names and bounds are known beforehand.

_TEST_FLAGS = after(
    "features", f"SELECT {ID}, {TARGET} AS label, TRUE AS consistent, TRUE AS bounded "
    "FROM parts WHERE split = 'test'", ENCODED, SPLIT)
for _name in ("train_logreg", "train_rf_v1", "train_rf_v2", "train_gbt", "train_gbt_subsampled", "train_raw_balanced"):
    ORACLES[f"{_name}_checked"] = _TEST_FLAGS
_RESPONSES = after("raw", f"SELECT CAST({ID} AS VARCHAR) AS {ID}, TRUE AS consistent, TRUE AS bounded FROM raw")
ORACLES["score_batch_checked"] = _RESPONSES
ORACLES["score_stream_checked"] = _RESPONSES
ORACLES["score_uploads_checked"] = _RESPONSES
ORACLES["score_registered_checked"] = _RESPONSES


def _listed(names, row) -> str:
    return "\nUNION ALL ".join("SELECT " + row(i, name) for i, name in enumerate(names))


ORACLES["train_single_checked"] = "SELECT 'random_forest_v1' AS model, TRUE AS above_floor"
ORACLES["train_all_checked"] = _listed(
    MODELS, lambda _, m: f"'{m}' AS model, {m != 'baseline_majority'} AS above_floor, TRUE AS bounded")
ORACLES["feature_importance_checked"] = (
    f"SELECT model, feature, TRUE AS bounded, TRUE AS adds_up FROM (VALUES "
    + columns(*[f"('{m}')" for m in MODELS if m != "baseline_majority"]) + ") m(model), (VALUES "
    + columns(*[f"('{c}')" for c in _MODEL_NAMES]) + ") f(feature)")
_REPORT_ROWS = [
    *[f"SELECT 'check' AS section, '{c}' AS item, '{title}' AS stat, "
      f"{'CAST(NULL AS BOOLEAN)' if c == 'sensitivity' else 'TRUE'} AS passed, CAST(NULL AS DOUBLE) AS support"
      for c, title in MODEL_CHECKS.items()],
    *[f"SELECT 'class_report', '{title}', '{stat}', NULL, "
      + (f"(SELECT CAST(count(*) AS DOUBLE) FROM parts WHERE split = 'test' AND Dropped_Out IN ({classes}))" if stat == "support" else "NULL")
      for title, classes in [*[(t, str(k)) for k, t in CLASS_NAMES.items()], *[(t, "0, 1") for t in ("accuracy", "macro avg", "weighted avg")]]
      for stat in ("precision", "recall", "f1", "support")],
    *[f"SELECT 'confusion_matrix', '{a}|{b}', 'count', NULL, NULL" for a in (0, 1) for b in (0, 1)],
]
ORACLES["validate_model_checked"] = after("features", "\nUNION ALL ".join(_REPORT_ROWS), ENCODED, SPLIT)
ORACLES["save_validation_report_checked"] = ORACLES["validate_model_checked"]
ORACLES["model_registry_checked"] = _listed(
    MODELS, lambda i, m: f"'learner_dropout_classifier' AS registry_name, {i + 1} AS version, '{m}' AS model_name, "
    f"'{'Production' if i + 1 == len(MODELS) else 'Archived'}' AS stage")
ORACLES["ml_pipeline_checked"] = (
    f"SELECT {len(MODELS)} AS models_trained, TRUE AS beats_majority, TRUE AS above_floor, "
    f"CAST({len(MODEL_CHECKS)} AS BIGINT) AS checks_total, 'learner_dropout_classifier' AS registry_name, "
    "1 AS version, 'Production' AS stage")
ORACLES["learner_segments_checked"] = after(
    "features",
    "SELECT CAST(4 AS BIGINT) AS n_segments, count(*) AS n_students, CAST(sum(Dropped_Out) AS BIGINT) AS n_dropped_out, "
    + columns(*[f"{r(f'avg({c})', 4)} AS avg_{c}" for c in FEATURE_COLUMNS]) + " FROM scaled",
    ENCODED, SPLIT, _SCALED_ROWS)
ORACLES["segment_quality_checked"] = _listed(
    (2, 3, 4, 5, 6), lambda _, k: f"{k} AS k, {k} AS n_segments, TRUE AS bounded, TRUE AS no_worse_than_two")
#: Checks that need the training of every model; left to ``tools/check.py``, as they take minutes.
LONG = tuple(n for n in ORACLES if n.endswith("_checked"))


# Drift, activity and cohort comparison.

_WATCHED = (*NUMERIC_COLUMNS, *FEATURE_COLUMNS)


def _shares(name: str, school: str) -> str:
    bins = "\nUNION ALL ".join(
        f"SELECT '{c}' AS col, CAST(least(greatest(floor(({c} - lo) / width), 0), 9) AS INTEGER) "
        f"AS bin FROM features, (SELECT CAST(min({c}) AS DOUBLE) AS lo, "
        f"coalesce(nullif((max({c}) - min({c})) / 10e0, 0), 1) AS width "
        f"FROM features WHERE School = 'GP') WHERE School = '{school}' AND {c} IS NOT NULL"
        for c in _WATCHED
    )
    return (
        f"{name}_shares AS (SELECT col, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY col) "
        f"AS DOUBLE) AS {name} FROM ({bins}) GROUP BY col, bin)"
    )


_B, _A = "coalesce(before, 0.0001e0)", "coalesce(after, 0.0001e0)"
ORACLES["drift_report"] = after(
    "features",
    "SELECT col AS \"column\", psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 "
    f"THEN 'moderate' ELSE 'strong' END AS level FROM (SELECT col, "
    f"{r(f'sum(({_A} - {_B}) * ln({_A} / {_B}))', 6)} AS psi "
    "FROM before_shares FULL JOIN after_shares USING (col, bin) GROUP BY col)",
    _shares("before", "GP"), _shares("after", "MS"))
ORACLES["drift_periods"] = ORACLES["drift_report"]
_ACTIVITY = (
    "SELECT user_id, count(*) AS n_events, count(DISTINCT date_trunc('minute', ts)) "
    "AS active_minutes, count(DISTINCT CAST(ts AS DATE)) AS active_days "
    "FROM events WHERE user_id IS NOT NULL GROUP BY user_id"
)
ORACLES["user_activity"] = _ACTIVITY
ORACLES["activity_kpis"] = "SELECT count(*) AS n_users, " + columns(*[
    f"{r(f'avg({c})', 4)} AS mean_{c}" for c in ("n_events", "active_minutes", "active_days")
]) + f" FROM ({_ACTIVITY})"
ORACLES["learner_kpis"] = after(
    "features",
    f"SELECT count(*) AS n_students, {r('avg(Final_Grade)', 2)} AS mean_final_grade, "
    f"{r('avg(Dropped_Out) * 100', 2)} AS dropout_rate_pct, "
    f"{r('avg(CASE WHEN combined_risk_score > 0.5 THEN 1 ELSE 0 END) * 100', 2)} AS at_risk_pct "
    "FROM features")
_WINDOWS = (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, "
    "count(*) AS n_events FROM events {closed} GROUP BY date_trunc('hour', ts), event_type"
)
ORACLES["activity_windows"] = _WINDOWS.format(closed="")
ORACLES["activity_stream"] = ORACLES["activity_windows"]
ORACLES["compare_cohorts"] = after(
    "features",
    "SELECT School, Gender, CAST(grouping(School) + grouping(Gender) AS INTEGER) AS cohort_level, "
    f"count(*) AS n_students, {r('avg(Dropped_Out) * 100', 2)} AS dropout_rate_pct, "
    f"{r('avg(Final_Grade)', 2)} AS mean_final_grade, "
    f"{r('avg(combined_risk_score)', 4)} AS mean_risk "
    "FROM features GROUP BY ROLLUP (School, Gender)")
