import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.config import ID, TARGET
from holdfast.operators import forests, models

WEIGHTS = (1.0, 1.0)


def walked(tree, codes, category, bins):
    """The share of the leaf of each row, step by step."""
    sets, found = tree["sets"].reshape(-1, bins), []
    for row in codes:
        at = 0
        while tree["child"][at] >= 0:
            f, b = tree["feature"][at], tree["bin"][at]
            left = sets[b, row[f]] if category[f] else row[f] <= b
            at = tree["child"][at] + (not left)
        found.append(tree["share"][at])
    return np.array(found)


@pytest.mark.parametrize("bins", [32, 70, 300])
def test_scores_are_those_of_a_walk(bins):
    """Bounds, sets of categories, and codes beyond one word of bits and beyond one byte."""
    draw = np.random.default_rng(1)
    kind = forests.code_type(bins)
    codes = np.stack([draw.integers(0, bins - 1, 900), draw.integers(0, bins, 900), draw.integers(0, 2, 900)], axis=1).astype(kind)
    labels = ((codes[:, 1] % 3 == 0) ^ (codes[:, 0] > bins // 2) ^ (draw.random(900) < 0.1)).astype("u1")
    category, limits = np.array([False, True, True]), [[i + 0.5 for i in range(bins - 2)], [], []]
    trees = [forests.grow(codes, labels, (0.7, 2.0), category, bins, 8, 2, 2, [42, i]) for i in range(3)]
    rows = [{"tree": i, **{c: np.ascontiguousarray(t[c], k).tobytes() for c, k in forests.KINDS.items()}} for i, t in enumerate(trees)]
    scores = forests.Trees(reversed(rows), limits, category, bins).score(codes.astype(float))
    assert scores == pytest.approx(np.mean([walked(t, codes, category, bins) for t in trees], axis=0), abs=1e-12)
    assert ((scores > 0.5) == labels).mean() > 0.8
    assert all(len(t["sets"]) > 0 and t["importance"].shape == (3,) for t in trees)


def test_a_stump_is_the_best_split():
    draw = np.random.default_rng(2)
    codes, labels = draw.integers(0, 9, (500, 3)).astype("u1"), draw.integers(0, 2, 500).astype("u1")
    tree = forests.grow(codes, labels, WEIGHTS, np.zeros(3, bool), 32, 1, 1, 3, [42, 0])
    times = np.random.default_rng([42, 0]).poisson(1.0, 500)

    def impurity(f, b):
        side, found = codes[:, f] <= b, 0.0
        for rows in (side, ~side):
            n, one = times[rows].sum(), (times * labels)[rows].sum()
            found += 2 * one * (n - one) / n if n else 0.0
        return found

    best = min(((f, b) for f in range(3) for b in range(8)), key=lambda x: impurity(*x))
    assert len(tree["child"]) in (1, 3)  # leaves that predict the same become one
    if len(tree["child"]) == 3:
        assert (tree["feature"][0], tree["bin"][0]) == best


def test_bounds_follow_from_all_rows(spark):
    """MLlib takes them from about 10,000 rows: a value that is rare among many was not seen."""
    from pyspark.ml.feature import VectorAssembler

    table = spark.range(60_000).selectExpr("double(id % 3) AS a", "double(IF(id = 77, 9, 0)) AS rare", "double(id) AS many")
    rows = VectorAssembler(inputCols=["a", "rare", "many"], outputCol="inputs").transform(table)
    found = forests.bounds(rows, "inputs", [False] * 3, 60_000, 32)
    assert found[:2] == [[0.5, 1.5], [4.5]]
    assert found[2] == [60_000 * k / 32 - 0.5 for k in range(1, 32)]
    assert forests.bounds(rows, "inputs", [True, False, True], 60_000, 32) == [[], [4.5], []]


def test_large_forests_are_tables_of_trees(spark, monkeypatch):
    """No tree is an object of the driver: there 200 deep ones took more memory than it has."""
    monkeypatch.setattr(models, "PART_ROWS", 100)
    monkeypatch.setattr(models, "TREES_TOGETHER", 2)
    rows = spark.range(500).selectExpr(f"id AS {ID}", f"int(id % 7 < 2) AS {TARGET}", "double(id % 7) AS Age")
    settings = {"kind": "forest", "trees": 5, "depth": 3, "balanced": True}
    model = models.fit_model(settings, rows)
    forest = model.stages[-1]
    assert isinstance(forest, forests.ForestModel)
    assert [r["tree"] for r in forest.table.orderBy("tree").collect()] == [0, 1, 2, 3, 4]
    scored = models.predict(model, rows, [ID, TARGET])
    assert scored.where(f"prediction = {TARGET}").count() == 500
    # The JVM is sent no model to score with.
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()
    full = model.transform(rows).select(F.col("score"), models.vector_to_array("probability").alias("p")).collect()
    assert all(r["p"] == [1 - r["score"], r["score"]] for r in full)
    # Beyond what a task may hold MLlib fits the groups.
    monkeypatch.setattr(models, "TASK_CELLS", 10)
    assert isinstance(models.fit_model(settings, rows).stages[-1], models.RandomForestClassificationModel)
