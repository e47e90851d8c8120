import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast.config import ID, TARGET
from holdfast.operators import segments

COLUMNS = ("x", "y")


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    given = [
        (i, draw.gauss(4 * (i % 3), 0.5), draw.gauss(-3 * (i % 3 == 1), 0.5) if i % 50 else None, i % 2) for i in range(600)
    ]
    return spark.createDataFrame(given, f"{ID} long, x double, y double, {TARGET} int")


def assigned(frame, **settings):
    found = segments.fit_segments(frame, 3, COLUMNS, **settings)
    return found, {r[ID]: r["segment"] for r in segments.assign_segments(found, frame).collect()}


def test_layout_and_order_change_nothing(rows):
    results = [assigned(frame) for frame in (
        rows.repartition(1), rows.repartition(7), rows.repartition(64), rows.orderBy(F.rand(3)), rows.orderBy(F.desc("x")).coalesce(2))]
    assert all(found.centres == results[0][0].centres and of == results[0][1] for found, of in results)
    of = results[0][1]
    # The three groups the rows were made from, but for single rows.
    assert len(set(of.values())) == 3
    agree = sum(of[i] == max(set(v := [of[j] for j in of if j % 3 == i % 3]), key=v.count) for i in of)
    assert agree > 590


def test_nearest_centre_by_hand(rows):
    found, of = assigned(rows)
    for r in rows.collect():
        far = [(r.x - a) ** 2 + ((r.y or 0.0) - b) ** 2 for a, b in found.centres]
        assert of[r[ID]] == far.index(min(far))


def test_fit_is_bounded(rows, monkeypatch):
    seen = []
    fit_rows = segments.fit_rows
    monkeypatch.setattr(segments, "fit_rows", lambda *args: seen.append(fit_rows(*args)) or seen[-1])
    assert len(assigned(rows, most=100)[1]) == 600
    assert 50 < seen[0].count() < 160


def test_quality(rows):
    table = segments.segment_quality(rows, (2, 3, 5), COLUMNS)
    by = {r["k"]: r for r in table.collect()}
    assert by[2]["inertia"] > by[3]["inertia"] > by[5]["inertia"]
    assert segments.best_number(table) == 3
    found, _ = assigned(rows)
    want = 0.0
    for r in rows.collect():
        own, other = sorted((r.x - a) ** 2 + ((r.y or 0.0) - b) ** 2 for a, b in found.centres)[:2]
        want += 1 - math.sqrt(own) / math.sqrt(other)
    assert by[3]["silhouette"] == pytest.approx(want / 600, abs=1e-4)


def test_rows_to_fit_on_are_drawn_once(rows, monkeypatch):
    """They were counted and drawn from the whole table again for every number of segments."""
    stored, materialise = [], segments.materialise
    monkeypatch.setattr(segments, "materialise", lambda *args: stored.append(materialise(*args)) or stored[-1])
    table = {r["k"]: r for r in segments.segment_quality(rows, (2, 4), COLUMNS, 100).collect()}
    assert len(stored) == 1 and 50 < stored[0].count() < 160
    for k, row in table.items():
        alone = segments.fit_segments(rows, k, COLUMNS, 100)
        assert row["n_segments"] == len(alone.centres)
        mean = rows.select(F.expr(f"array_min({alone.distances()})").alias("d")).agg(F.avg("d")).first()[0]
        assert row["inertia"] == pytest.approx(mean, abs=1e-4)
