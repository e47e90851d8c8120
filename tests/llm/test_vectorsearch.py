"""Top-k against every inner product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import vectorsearch


def brute(rows, step, k):
    vectors = {}
    out = set()
    good = [(i, np.floor(64 * np.array(v, float))) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    for i, v in good:
        if i % step == 0 and i not in vectors:
            vectors[i] = v
    for q, v in vectors.items():
        scored = sorted((-int(v @ x), i) for i, x in good if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("k", [1, 20])
def test_vectors_with_ties_and_gaps(spark, k):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).round(1).tolist()) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(600, 800)]
    rows += [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8),
             (905, [0.0] * 8), (906, [3.0, -2.0]), (None, [1.0] * 8), (920, [1e4] * 8), (940, [-1e-9] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string").repartition(6)
    got = [tuple(r) for r in vectorsearch.top_k(df, F.col("vec_id") % 20 == 0, k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 20, k)


def test_small_cells_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(vectorsearch, "CELL", 10)
    monkeypatch.setattr(vectorsearch, "BLOCK", 7)
    rows = [(i, [float(i % 7), 1.0]) for i in range(300)]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in vectorsearch.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()} == brute(rows, 20, 5)
    assert vectorsearch.top_k(df.limit(0), F.lit(True)).count() == 0
    assert vectorsearch.top_k(df.limit(1), F.lit(True)).count() == 0
    assert vectorsearch.top_k(df.limit(3), F.lit(False)).count() == 0
