"""Held-out quality of the rule ensemble, and agreement of the compiled rules with numpy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import quality
from holdfast.llm.queries import op4_quality

DIR = "/root/testdata/sf0.1"


def auc(good, bad):
    return np.mean([(good > x).mean() + (good == x).mean() / 2 for x in bad])


def test_held_out_rows(spark):
    rows = op4_quality(spark, DIR).toPandas()
    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas().set_index("doc_id").quality
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    rows["y"] = labels.reindex(rows.doc_id).to_numpy()
    own = rows[rows.held_out & rows.y.notna()]
    good, bad = own[own.y == 1], own[own.y == 0]
    assert auc(good.score.to_numpy(), bad.score.to_numpy()) > 0.98
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.2


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, len(quality.STATISTICS))) * 10
    y = ((x[:, 5] > 3) & (x[:, 9] <= 4) | (x[:, 1] > 12)).astype(float)
    return quality.fit(x, y), x, y


def test_rules_are_found_and_sparse(model):
    ensemble, x, y = model
    total = ensemble.intercept + sum(w * r.holds(x) for r, w in ensemble.rules)
    for f, low, high, mean, scale, w in ensemble.linear:
        total = total + (np.clip(x[:, f], low, high) - mean) / scale * w
    assert ((total > 0) == (y == 1)).mean() > 0.97
    assert 0 < len(ensemble.rules) < 150


def test_compiled_column_equals_numpy(spark, model):
    ensemble, x, _ = model
    rows = [tuple(map(float, r)) for r in x[:200]]
    df = spark.createDataFrame(rows, ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r[0] for r in df.select(ensemble.column(F.struct(*quality.STATISTICS))).collect()]
    total = ensemble.intercept + sum(w * r.holds(x[:200]) for r, w in ensemble.rules)
    for f, low, high, mean, scale, w in ensemble.linear:
        total = total + (np.clip(x[:200, f], low, high) - mean) / scale * w
    assert np.allclose(got, 1 / (1 + np.exp(-total)))


def test_odd_texts_and_missing_labels(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x", "a"), (3, "word " * 50_000, "a"), (3, "word", "a"), (4, " \n\t ", "a"), (5, "日本 é", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    labels = "doc_id long, quality int"
    none = quality.train(docs, spark.createDataFrame([], labels))
    out = quality.score(docs, none).collect()
    assert len(out) == 7 and {round(r.score, 6) for r in out} == {0.5} and out[0].stats == "a"
    ones = quality.train(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 0), (4, None), (99, 0)], labels))
    assert all(0.9 < r.score <= 1 for r in quality.score(docs, ones).collect())
    counted = quality.with_statistics(docs, "text").select("doc_id", "stats.*").collect()
    assert counted[0].chars == counted[1].distinct_words == counted[5].words == 0
    assert counted[3].words == 50_000 and counted[3].same_word > 0.99
    assert quality.score(docs.limit(0), none).count() == 0


def test_bound_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else "A! B! C!") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(2000)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=300)
    out = quality.score(docs, model).collect()
    assert all((r.score > 0.5) == (r.doc_id % 3 > 0) for r in out)
