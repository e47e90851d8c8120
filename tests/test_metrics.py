import itertools
import random

import pytest

from holdfast.operators import comparison, metrics
from holdfast.operators.comparison import RUN_COLUMNS

SCHEMA = "model string, label int, prediction int, score double"


def frame_of(spark, rows, model="m"):
    return spark.createDataFrame([(model, *r) for r in rows], SCHEMA)


def test_perfect_and_all_wrong(spark):
    perfect = [(k, k, float(k)) for k in (0, 1, 1, 0)]
    wrong = [(k, 1 - k, 1.0 - k) for k in (0, 1, 1, 0)]
    both = frame_of(spark, perfect, "right").union(frame_of(spark, wrong, "wrong"))
    rows = {r["model"]: r for r in metrics.classification_metrics(both).collect()}
    assert all(rows["right"][m] == 1.0 for m in metrics.METRICS)
    assert all(rows["wrong"][m] == 0.0 for m in metrics.METRICS)


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < .3), 0, round(rng.random(), 2)) for _ in range(400)]
    rows += [(k, 0, 0.5) for k in (0, 1) for _ in range(120)]
    positives = [s for k, _, s in rows if k]
    negatives = [s for k, _, s in rows if not k]
    wins = sum((p > q) + (p == q) / 2 for p, q in itertools.product(positives, negatives))
    got = metrics.roc_auc(frame_of(spark, rows).repartition(6))
    assert got.first()["roc_auc"] == pytest.approx(wins / len(positives) / len(negatives), abs=1e-12)


def test_one_class_has_no_auc_and_undefined_shares_are_zero(spark):
    row = metrics.classification_metrics(frame_of(spark, [(0, 0, .1), (0, 0, .2)])).first()
    assert row["roc_auc"] is None
    assert (row["accuracy"], row["precision"], row["recall"]) == (1.0, 1.0, 1.0)


def test_without_scores(spark):
    frame = frame_of(spark, [(0, 0, .1), (1, 0, .2)]).drop("score")
    row = metrics.classification_metrics(frame).first()
    assert (row["accuracy"], row["precision"], row["roc_auc"]) == (0.5, 0.25, None)


def test_confusion_has_empty_cells(spark):
    cells = metrics.confusion_matrix(frame_of(spark, [(0, 0, .1), (1, 0, .2)])).collect()
    assert {(r["label"], r["prediction"]): r["count"] for r in cells} == {
        (0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def runs_of(spark, rows):
    kinds = ", ".join(
        f"{c} {'string' if c in ('model', 'run_id') else 'double'}" for c in RUN_COLUMNS)
    return spark.createDataFrame(
        [(name, acc, f1, .5, rec, auc, None, None, name) for name, acc, f1, rec, auc in rows], kinds)


def ranked(spark, rows):
    table = comparison.comparison_table(runs_of(spark, rows))
    return comparison.composite_score(table)


def test_comparison_order_and_best(spark):
    table = ranked(spark, [
        ("base", .85, .78, .85, .5), ("forest", .97, .96, .97, .95), ("line", .9, .9, .9, .97)])
    rows = {r["model"]: r for r in table.collect()}
    assert [rows[m]["rank"] for m in ("forest", "line", "base")] == [1, 2, 3]
    assert all(0 <= r["composite_score"] <= 1 for r in rows.values())
    best = comparison.select_best(table).first()
    assert best["model"] == "forest"
    assert best["justification"].startswith("'forest' sélectionné avec F1=0.9600, ROC-AUC=0.9500")
    assert best["justification"].endswith("(15% décrochage).")


def test_equal_models_score_one_and_first_name_wins(spark):
    table = ranked(spark, [("b", .9, .9, .9, .9), ("a", .9, .9, .9, .9)])
    assert {r["composite_score"] for r in table.collect()} == {1.0}
    assert comparison.select_best(table).first()["model"] == "a"


def test_missing_metrics(spark):
    partly = {r["model"]: r["composite_score"] for r in ranked(
        spark, [("a", .9, .9, .9, None), ("b", .8, .8, .8, .7), ("c", .8, .8, .8, .6)]).collect()}
    assert partly["a"] is None and partly["b"] == 0.3
    none = {r["model"]: r["composite_score"] for r in ranked(
        spark, [("a", .9, .9, .9, None), ("b", .8, .8, .8, None)]).collect()}
    assert none == {"a": 0.7, "b": 0.0}
