"""Quality of binary predictions.

A prediction table holds ``label`` and ``prediction`` (0 or 1), optionally ``score`` (probability
of 1), and key columns such as ``model`` that take few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import CLASS_NAMES
from holdfast.functions.distributions import running_totals
from holdfast.functions.numbers import half_even, sql_text
from holdfast.workspace import materialise

METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc")
MODEL_KEY = ("model",)


def tallies(predictions: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    """Per key: rows ``n``, and per class k labelled ``s_k``, predicted ``p_k``, both ``t_k``."""
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.expr(f"count_if({test})").alias(f"{name}_{k}")
            for k in (0, 1)
            for name, test in (
                ("s", f"label = {k}"),
                ("p", f"prediction = {k}"),
                ("t", f"label = {k} AND prediction = {k}"),
            )
        ],
    )


def _share(part: str, whole: str) -> str:
    return f"coalesce(double({part}) / nullif(double({whole}), 0D), 0D)"


def class_scores(k: int) -> dict[str, str]:
    """Precision, recall and F1 of class k from its tallies, 0 where undefined."""
    return {
        "precision": _share(f"t_{k}", f"p_{k}"),
        "recall": _share(f"t_{k}", f"s_{k}"),
        "f1": _share(f"2 * t_{k}", f"(s_{k} + p_{k})"),
    }


def _weighted(name: str) -> str:
    zero, one = class_scores(0)[name], class_scores(1)[name]
    return f"({zero} * s_0 + {one} * s_1) / nullif(double(s_0 + s_1), 0D)"


def roc_auc(
    predictions: DataFrame,
    keys: Sequence[str] = MODEL_KEY,
) -> DataFrame:
    """``keys…, roc_auc``: exact area under the curve, ties counted half; null with one class.

    Rows are collapsed to one per distinct score first, then ranked by running totals.
    """
    scores = materialise(
        predictions.where("score IS NOT NULL AND NOT isnan(score)")
        .groupBy(*keys, "score")
        .agg(F.expr("count_if(label = 1)").alias("pos"), F.expr("count_if(label = 0)").alias("neg")),
        "scores",
    )
    ranked = running_totals(scores, keys, "score", ["pos", "neg"])
    return ranked.groupBy(*keys).agg(
        F.expr(
            "sum(double(pos) * (double(neg_before) + double(neg) / 2)) "
            "/ nullif(double(max(pos_total)) * double(max(neg_total)), 0D)"
        ).alias("roc_auc")
    )


def classification_metrics(
    predictions: DataFrame,
    keys: Sequence[str] = MODEL_KEY,
) -> DataFrame:
    """``keys…, accuracy, f1, precision, recall, roc_auc``: support-weighted, four decimals."""
    counted = tallies(predictions, keys).selectExpr(
        *keys,
        f"{half_even('double(t_0 + t_1) / double(n)', 4)} AS accuracy",
        *[f"{half_even(_weighted(name), 4)} AS {name}" for name in ("f1", "precision", "recall")],
    )
    if "score" not in predictions.columns:
        return counted.withColumn("roc_auc", F.lit(None).cast("double"))
    areas = roc_auc(predictions, keys)
    return counted.join(areas, list(keys), "left").selectExpr(
        *keys, "accuracy", "f1", "precision", "recall", f"{half_even('roc_auc', 4)} AS roc_auc"
    )


def confusion_matrix(predictions: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    """``keys…, label, prediction, count``: all four cells, empty ones included."""
    cells = "0, 0, t_0, 0, 1, s_0 - t_0, 1, 0, s_1 - t_1, 1, 1, t_1"
    return tallies(predictions, keys).selectExpr(
        *keys, f"stack(4, {cells}) AS (label, prediction, count)"
    )


def class_report(predictions: DataFrame, keys: Sequence[str] = MODEL_KEY) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted means."""
    rows = []
    for k, title in CLASS_NAMES.items():
        scores = class_scores(k)
        rows.append((title, scores["precision"], scores["recall"], scores["f1"], f"s_{k}"))
    hits = "double(t_0 + t_1) / double(n)"
    rows.append(("accuracy", hits, hits, hits, "n"))
    names = ("precision", "recall", "f1")
    macro = [f"({class_scores(0)[x]} + {class_scores(1)[x]}) / 2" for x in names]
    rows.append(("macro avg", *macro, "n"))
    rows.append(("weighted avg", *[_weighted(x) for x in names], "n"))
    cells = ", ".join(
        f"{sql_text(title)}, {p}, {r}, {f1}, {support}" for title, p, r, f1, support in rows
    )
    return tallies(predictions, keys).selectExpr(
        *keys, f"stack({len(rows)}, {cells}) AS (class, precision, recall, f1, support)"
    )
