"""Dictionaries as tables: codes and one-hot places of columns with any number of values."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import dictionary, encoding
from tests.conftest import by_id

SCHEMA = "student_id bigint, t string, u string"


def wide(spark, rows):
    """A column with many values, one of which a third of all rows hold."""
    return spark.range(rows).select(
        F.col("id").alias("student_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("v"), (F.col("id") * 7919 % 4999).cast("string"))).alias("t"),
        F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("u"))


def expected(df, column):
    held = sorted({r[column] for r in df.collect() if r[column] is not None})
    codes = {v: i for i, v in enumerate(held)}
    return {r["student_id"]: codes.get(r[column], len(held)) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_many_values_and_a_hot_one(spark, parts):
    df = wide(spark, 12_000)
    values = dictionary.fit_values(df, parts=parts)
    assert values.sizes["t"] > dictionary.HOT > values.sizes["u"] == 4
    assert [r["value"] for r in values.table.where("column = 't' AND hot").collect()] == ["hot"]
    coded = dictionary.label_encode(df, values)
    assert coded.columns == df.columns
    assert by_id(coded, "t") == expected(df, "t")
    assert by_id(coded, "u") == expected(df, "u")


def test_equals_the_encoder_with_constants(spark):
    rows = [(1, "b", "it's"), (2, "a", None), (3, "b", "é"), (4, None, "z"), (4, "a", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    values = dictionary.fit_values(df)
    one = dictionary.label_encode(df, values).selectExpr("student_id", "int(t) t", "int(u) u")
    assert sorted(one.collect()) == sorted(encoding.label_encode(df).collect())


def test_places_and_vectors_agree(spark):
    df = wide(spark, 6_000)
    values = dictionary.fit_values(df.where("student_id < 4000"))
    places = by_id(dictionary.one_hot_places(df, values), "places")
    vectors = by_id(dictionary.one_hot_vectors(df, values), "features")
    assert {i: list(map(int, v.indices)) for i, v in vectors.items()} == places
    assert {v.size for v in vectors.values()} == {sum(values.sizes.values())}
    assert min(len(p) for p in places.values()) == 1


def test_unknown_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], SCHEMA)
    values = dictionary.fit_values(df)
    fresh = spark.createDataFrame([(9, "new", "x", 5, 6, 7, 8)], SCHEMA + ", text_of_value int, near_of_value int, value int, places int")
    coded = dictionary.label_encode(fresh, values).first()
    assert tuple(coded) == (9, 2, 0, 5, 6, 7, 8)
    assert dictionary.one_hot_places(fresh, values).first()["places"] == [2]
    nothing = dictionary.fit_values(df.limit(0))
    assert nothing.sizes == {"t": 0, "u": 0}
    assert by_id(dictionary.label_encode(df, nothing), "t", "u") == {1: (0, 0), 2: (0, 0)}
    assert by_id(dictionary.one_hot_places(df, nothing), "places") == {1: [], 2: []}


def test_rows_of_small_columns_do_not_move(spark):
    df = wide(spark, 3_000).drop("t")
    values = dictionary.fit_values(df)
    plan = dictionary.label_encode(df, values)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
