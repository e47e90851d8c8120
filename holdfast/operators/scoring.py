"""Requests and uploads to scored learners, and the list of those at risk.

Every step is a projection or filter on columns, so it works alike on tables and on streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import (
    CONFIDENCE_BANDS,
    DECISION_THRESHOLD,
    DISPLAY_COLUMNS,
    ID,
    OUTCOME_NAMES,
    REQUEST_CONSTANTS,
    REQUEST_FIELDS,
    TOP_CONFIDENCE,
    UPLOAD_FIELDS,
)
from holdfast.functions.numbers import half_even, labelled, quoted, sql_text
from holdfast.operators.models import predict, served_inputs

_BY_FIELD = {field: (source, kind, default) for field, source, kind, default in REQUEST_FIELDS}


def rename_for_scoring(df: DataFrame) -> DataFrame:
    """Source names of the upload fields to their request names; other columns stay."""
    return df.withColumnsRenamed({_BY_FIELD[f][0]: f for f in UPLOAD_FIELDS})


def upload_spellings() -> list[tuple[str, str]]:
    """The two names of each column that an uploaded file must have."""
    return [(f, _BY_FIELD[f][0]) for f in UPLOAD_FIELDS]


def require_columns(df: DataFrame, needed: Sequence[str] = UPLOAD_FIELDS) -> list[str]:
    """The needed columns ``df`` lacks; looks at the schema only."""
    return [c for c in needed if c not in df.columns]


def required_columns_report(df: DataFrame, needed: Sequence[str] = UPLOAD_FIELDS) -> DataFrame:
    """``column, present, filled``: whether each needed column is there, and its filled cells."""
    absent = require_columns(df, needed)
    counts = df.selectExpr(*[
        f"{'0L' if c in absent else f'count({quoted(c)})'} AS c{i}" for i, c in enumerate(needed)
    ])
    cells = ", ".join(f"'{c}', {c not in absent}, c{i}" for i, c in enumerate(needed))
    return counts.selectExpr(f"stack({len(needed)}, {cells}) AS (column, present, filled)")


def default_fields(df: DataFrame) -> DataFrame:
    """Id and the 31 request fields.

    A field comes from the column of its own name, else from its source column, else it is a
    constant. Only absent columns are filled in; a null cell stays null.
    """
    present = {c: kind for c, kind in df.dtypes}
    fields = []
    for field, (source, kind, default) in _BY_FIELD.items():
        column = next((c for c in (field, source) if c in present), None)
        if field in UPLOAD_FIELDS and field not in present:
            column = None
        if column is None:
            text = f"{default}" if kind == "int" else sql_text(default)
        elif kind == "int":
            number = column if present[column] != "string" else f"try_cast({column} AS DOUBLE)"
            text = f"try_cast({number} AS INT)"
        else:
            text = f"CAST({column} AS STRING)"
        fields.append(f"{text} AS {field}")
    return df.selectExpr(ID, *fields)


def to_model_columns(requests: DataFrame) -> DataFrame:
    """Request fields to the raw-named columns the served model was trained on."""
    carried = [f"{field} AS {source}" for field, (source, _, _) in _BY_FIELD.items()]
    fixed = [f"{sql_text(value)} AS {c}" for c, value in REQUEST_CONSTANTS.items()]
    return requests.selectExpr(ID, *carried, *fixed)


def align_columns(df: DataFrame, wanted: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Id and the wanted columns in their order; absent ones are 0, further ones are dropped.

    With a mapping the columns are cast to the given types.
    """
    kinds = wanted if isinstance(wanted, Mapping) else {}
    columns = []
    for c in wanted:
        value = quoted(c) if c in df.columns else "0"
        columns.append(
            f"CAST({value} AS {kinds[c]}) AS {quoted(c)}" if c in kinds else f"{value} AS {quoted(c)}"
        )
    return df.selectExpr(ID, *columns)


def score_decision(score: str = "score") -> str:
    """1 above the threshold, 0 at it and below."""
    return f"CASE WHEN {score} > {DECISION_THRESHOLD}D THEN 1 ELSE 0 END"


def confidence_band(score: str = "score") -> str:
    """Name of the band the probability falls in."""
    cases = " ".join(f"WHEN {score} < {top}D THEN '{name}'" for top, name in CONFIDENCE_BANDS)
    return f"CASE {cases} ELSE '{TOP_CONFIDENCE}' END"


def decide(scored: DataFrame) -> DataFrame:
    """Probability to the response fields: id as text, class, probability, band."""
    return scored.selectExpr(
        f"CAST({ID} AS STRING) AS {ID}",
        f"{score_decision()} AS prediction",
        "score AS probability",
        f"{confidence_band()} AS confidence",
    )


def score_batch(model: PipelineModel, upload: DataFrame) -> DataFrame:
    """An uploaded table to one response per learner."""
    missing = require_columns(rename_for_scoring(upload))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    requests = upload.transform(rename_for_scoring).transform(default_fields)
    return decide(score_requests(model, requests))


def score_requests(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """``student_id, score`` for a table or stream of requests."""
    rows = requests.transform(to_model_columns).transform(align_columns, served_inputs(model))
    return predict(model, rows).select(ID, "score")


def score_limit(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` learners by id, for a preview."""
    return df.orderBy(ID).limit(rows)


def score_display(scored: DataFrame) -> DataFrame:
    """The ten displayed columns and the id, from request fields plus ``score``.

    The percentage is rounded half to even before it is printed.
    """
    percent = half_even("score * 100", 1)
    return scored.withColumns({
        "prediction": F.expr(labelled(score_decision(), OUTCOME_NAMES)),
        "probability": F.expr(f"format_string('%.1f%%', {percent})"),
        "confidence": F.expr(confidence_band()),
    }).select(ID, *DISPLAY_COLUMNS)


def at_risk_filter(
    scored: DataFrame,
    min_age: int = 15,
    max_age: int = 30,
    school: str = "All",
    sex: str = "All",
    min_probability: float = 0.5,
) -> DataFrame:
    """Displayed learners predicted to drop out that pass the chosen filters.

    The threshold is compared with the displayed percentage, one decimal, as a share.
    """
    rows = scored.where(F.col("age").between(min_age, max_age))
    if school != "All":
        rows = rows.where(F.col("school") == school)
    if sex != "All":
        rows = rows.where(F.col("sex") == sex)
    shown = f"{half_even('score * 100', 1)} / 100"
    rows = rows.where(f"{shown} >= {float(min_probability)}D AND {score_decision()} = 1")
    return score_display(rows)
