import hashlib

import pytest

from holdfast.operators import encoding, splitting
from tests.conftest import by_id


@pytest.fixture
def texts(spark):
    rows = [(1, "b", "it's"), (2, "a", None), (3, "b", "x y"), (4, None, "it's")]
    return spark.createDataFrame(rows, "student_id bigint, t string, u string")


def test_one_hot(texts):
    hot = encoding.one_hot(texts)
    assert hot.columns == ["student_id", "t_a", "t_b", "u_it's", "u_x y"]
    assert by_id(hot, "t_a", "t_b", "u_it's") == {
        1: (0, 1, 1), 2: (1, 0, 0), 3: (0, 1, 0), 4: (0, 0, 1)}


def test_unseen_values(texts, spark):
    dictionary = encoding.fit_dictionary(texts)
    fresh = spark.createDataFrame([(9, "new", "x y")], texts.schema)
    assert encoding.one_hot(fresh, dictionary).first()[1:] == (0, 0, 0, 1)
    assert encoding.label_encode(fresh, dictionary).first()[1:] == (2, 1)


def test_label_encode(texts):
    assert by_id(encoding.label_encode(texts), "t", "u") == {
        1: (1, 0), 2: (0, 2), 3: (1, 1), 4: (2, 0)}


def test_too_many_values(texts):
    with pytest.raises(ValueError, match="t"):
        encoding.fit_dictionary(texts, most=1)


def test_nothing_to_encode(spark):
    frame = spark.createDataFrame([(1, 2.0)], "student_id bigint, Age double")
    assert encoding.one_hot(frame).columns == frame.columns


def test_scaling_uses_population_deviation_and_keeps_constants(spark):
    frame = spark.createDataFrame(
        [(1, 1.0, 5.0), (2, 3.0, 5.0)], "student_id bigint, Age double, Grade_1 double")
    scaled = encoding.standard_scale(frame, encoding.fit_scaling(frame))
    assert by_id(scaled, "Age", "Grade_1") == {1: (-1.0, 0.0), 2: (1.0, 0.0)}


def test_target_is_no_input(spark):
    frame = spark.createDataFrame(
        [(1, 0, 1.0, 1, 1)],
        "student_id bigint, Dropped_Out int, Age double, School_GP int, School_Support int")
    assert encoding.feature_names(frame) == ["Age", "School_Support", "School_GP"]


def reference_split(rows, share, seed):
    """Plain ranking of each class by hash."""
    tests = set()
    by_class = {}
    for i, c in rows:
        by_class.setdefault(c, []).append(i)
    sizes = splitting.test_sizes({c: len(ids) for c, ids in by_class.items()}, share)
    for c, ids in by_class.items():
        ids.sort(key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        tests.update(ids[: sizes[c]])
    return tests


@pytest.mark.parametrize("step", [1, 2, 4])
@pytest.mark.parametrize("n, share, seed", [(1, .2, 42), (10, .2, 42), (137, .2, 1), (500, .33, 7)])
def test_split_equals_plain_ranking(spark, n, share, seed, step):
    rows = [(i * 7, int(i % 6 == 0)) for i in range(n)]
    frame = spark.createDataFrame(rows, "student_id bigint, Dropped_Out int")
    parts = splitting.stratified_split(frame, splitting.fit_split(frame, share, seed, step))
    got = {r["student_id"] for r in parts.where("split = 'test'").collect()}
    assert got == reference_split(rows, share, seed)


def test_split_sizes():
    assert splitting.test_sizes({0: 549, 1: 100}, 0.2) == {0: 110, 1: 20}
    assert splitting.test_sizes({0: 12, 1: 3}, 0.2) == {0: 2, 1: 1}
    assert sum(splitting.test_sizes({0: 7, 1: 7, 2: 7}, 0.2).values()) == 5


def test_split_of_empty_table(spark):
    frame = spark.createDataFrame([], "student_id bigint, Dropped_Out int")
    assert splitting.stratified_split(frame).count() == 0


def test_split_needs_no_shuffle(spark):
    frame = spark.range(100).selectExpr("id AS student_id", "int(id % 2) AS Dropped_Out")
    parts = splitting.stratified_split(frame, splitting.fit_split(frame))
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
