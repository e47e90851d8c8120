import pytest
from pyspark.sql import functions as F

from holdfast.sources import writers
from holdfast.workspace import new_path

LIMIT = writers.METHOD_LIMIT


@pytest.mark.parametrize("save", [writers.save_features, writers.save_ml_datasets])
def test_wide_tables_are_written_by_compiled_methods(spark, save, monkeypatch):
    """The JVM interprets a method of more than 8000 bytes for every row, such as that of all features."""
    seen, writer = [], type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *args, **named: seen.append(int(spark.conf.get(LIMIT))) or parquet(self, *args, **named))
    rows = spark.range(4).withColumn("split", F.lit("train"))
    path = save(rows, new_path(spark, "wide"))
    assert seen == [8000] and int(spark.conf.get(LIMIT)) == 65535
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]


def test_a_chosen_limit_stays(spark):
    spark.conf.set(LIMIT, "9000")
    try:
        with writers.wide_steps_compiled(spark):
            assert spark.conf.get(LIMIT) == "9000"
        assert spark.conf.get(LIMIT) == "9000"
    finally:
        spark.conf.unset(LIMIT)


def test_encoded_tables_are_written_by_compiled_methods(spark, monkeypatch):
    test_wide_tables_are_written_by_compiled_methods(spark, writers.save_processed, monkeypatch)
