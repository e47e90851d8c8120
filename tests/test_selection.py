import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import selection

SHARES = {"q0": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "q": 1.0}


def columns_of_numbers():
    draw = random.Random(9)
    n = 500
    return {
        "few": [float(draw.randint(0, 20)) for _ in range(n)],
        "prices": [round(draw.uniform(900, 105_000), 2) for _ in range(n)],
        "magnitudes": [draw.choice((-1, 1)) * 10.0 ** draw.randint(-300, 300) for _ in range(n)],
        "tiny": [draw.randint(0, 9) * 5e-324 for _ in range(n)],
        "near": [1.0 + draw.randint(0, 99) * 2**-52 for _ in range(n)],
        "widest": [draw.choice((-1.7e308, 0.0, 1.7e308)) for _ in range(n)],
        "outlier": [1e300] + [draw.random() for _ in range(n - 1)],
        "infinite": [draw.choice((-math.inf, 0.0, 2.5, math.inf)) for _ in range(n)],
        "gaps": [draw.choice((None, math.nan, float(draw.randint(-5, 5)))) for _ in range(n)],
        "one": [None] * (n - 1) + [7.0],
        "none": [None] * n,
    }


@pytest.fixture(scope="module")
def frame(spark):
    given = columns_of_numbers()
    schema = ", ".join(f"{c} double" for c in given)
    return given, spark.createDataFrame(list(zip(*given.values())), schema).repartition(5)


def placed(values, p, method):
    """Interpolated between the two ranks around the place."""
    n = len(values)
    place = p * (n - 1) if method == "linear" else min(max(p * n - 0.5, 0.0), n - 1.0)
    low, high = sorted(values)[math.floor(place)], sorted(values)[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("method", ["linear", "midpoint"])
def test_against_sorting(frame, method):
    given, df = frame
    moments, got = selection.order_statistics(df, selection.named(given), SHARES, method)
    for c, values in given.items():
        whole = [v for v in values if v is not None and not math.isnan(v)]
        assert moments[c].count == len(whole)
        for name, p in SHARES.items():
            want = placed(whole, p, method) if whole else None
            assert got[c][name] == want or math.isnan(want) and math.isnan(got[c][name]), (c, name)
    assert moments["prices"].mean == pytest.approx(np.mean(given["prices"]))
    assert moments["prices"].std == pytest.approx(np.std(given["prices"], ddof=1))
    assert (moments["one"].low, moments["one"].high, moments["one"].std) == (7.0, 7.0, None)


def test_passes_are_few(frame, monkeypatch):
    given, df = frame
    passes = []
    count = selection._count
    monkeypatch.setattr(selection, "_count", lambda *args: passes.append(1) or count(*args))
    selection.quantiles(df, selection.named(given), SHARES)
    assert len(passes) <= 12
    passes.clear()
    selection.quantiles(df, selection.named(["few", "prices"]), SHARES)
    assert len(passes) <= 3


def test_values_are_not_shuffled(spark, monkeypatch):
    """A row per part moves, not one per value."""
    df = spark.range(20_000).selectExpr("double(id) AS x", "double(id * 7 % 20011) AS y")
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    got = selection.quantiles(df, selection.named(["x", "y"]), {"m": 0.5})
    assert got["x"]["m"] == 9999.5
    assert max(map(len, seen)) <= 2 * 2 * (selection.BUCKETS + 2)


def test_unknown_method(frame):
    with pytest.raises(ValueError):
        selection.quantiles(frame[1], {"few": "few"}, SHARES, "nearest")


def test_a_step_works_on_few_columns(spark, monkeypatch):
    """The JVM does not compile the method of a step for many columns, and interprets it for every row."""
    seen, frame_class = [], type(spark.range(1))
    select = frame_class.selectExpr
    monkeypatch.setattr(frame_class, "selectExpr", lambda self, *texts: seen.append(texts) or select(self, *texts))
    many = spark.range(101).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(3 * selection.TOGETHER + 1)])
    moments, found = selection.order_statistics(many, selection.named(many.columns), {"m": 0.5})
    assert all(found[f"c{i}"]["m"] == 50.0 * (i + 1) and moments[f"c{i}"].count == 101 for i in range(len(many.columns)))
    stacks = [int(text.split("(")[1].split(",")[0]) for texts in seen for text in texts if text.startswith("stack(")]
    assert stacks and max(stacks) <= selection.TOGETHER
    assert max(sum(text.startswith("avg(") for text in texts) for texts in seen) == selection.TOGETHER
