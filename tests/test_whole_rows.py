"""No model is fitted on a part of its rows."""

from pyspark.sql import functions as F

from holdfast.config import ID, TARGET
from holdfast.operators import models, segments

MANY = models.FIT_ROWS + 200_000


def many(spark):
    return spark.range(MANY).selectExpr(f"id AS {ID}", f"int(id % 5 = 0) AS {TARGET}", "double(id % 7) AS Age")


def test_all_rows_are_fitted_on(spark):
    rows = many(spark)
    assert models.fit_rows(rows, MANY).count() == MANY
    vectors = models.vector_table(rows)
    assert vectors.rows.select(ID).distinct().count() == MANY
    assert vectors.counts == {0: MANY * 4 // 5, 1: MANY // 5}


def test_models_see_all_rows(spark, monkeypatch):
    seen, fit_rows = [], models.fit_rows
    monkeypatch.setattr(models, "fit_rows", lambda *a, **k: seen.append(fit_rows(*a, **k)) or seen[-1])
    settings = {"kind": "logistic", "iterations": 1, "balanced": True}
    model = models.fit_model(settings, many(spark).where(f"{ID} < {MANY}"))
    assert [df.count() for df in seen] == [MANY, MANY]
    assert model.stages[-1].numClasses == 2


def test_segments_are_fitted_on_all_rows(spark, monkeypatch):
    seen, fit_rows = [], segments.fit_rows
    monkeypatch.setattr(segments, "fit_rows", lambda *a: seen.append(fit_rows(*a)) or seen[-1])
    rows = many(spark).withColumn("split", F.lit("train"))
    quality = segments.segment_quality(rows, (2,), ["Age"]).first()
    assert quality["n_segments"] == 2
    segments.fit_segments(rows, 2, ["Age"])
    assert [df.count() for df in seen] == [MANY] * 3


def test_parts_grow_with_the_rows():
    assert models.whole_parts(models.FIT_ROWS) == models.fit_parts(models.FIT_ROWS)
    assert models.whole_parts(models.FIT_ROWS + 8 * models.GROUP_PART_ROWS) == models.fit_parts(models.FIT_ROWS) + 8
