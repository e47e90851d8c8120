"""Laws of the shards."""

import zlib

import pytest

from holdfast.llm import sharding
from holdfast.llm.queries import op8_sharding
from holdfast.workspace import new_path


def laws(rows, shards, spare):
    size = [0] * shards
    slots = {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size) / shards
    assert all(abs(s - mean) <= spare for s in size), size


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    rows = op8_sharding(spark, "/root/testdata/sf0.01").collect()
    text = dict(zip(docs.doc_id, docs.text))
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    laws(rows, 16, max(r.size for r in rows))


@pytest.mark.parametrize("rows", [
    [(7, "same text")] * 3000 + [(i, f"t{i}" * (i % 9)) for i in range(3000)],
    [(i, "copy") for i in range(2000)] + [(i, None) for i in range(2000, 4000)],
])
def test_hot_texts_and_repeated_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(7)
    out = sharding.assign(df, 16).collect()
    assert len(out) == len(rows)
    sizes = sorted(r.size for r in out)
    laws(out, 16, 0.03 * sum(sizes) / 16 + 2 * sizes[-1])


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert sharding.assign(spark.createDataFrame([], schema), 4).count() == 0
    one = sharding.assign(spark.createDataFrame([(None, None)], schema), 4).collect()
    assert len(one) == 1 and one[0].size == 1 and one[0].slot == 0 and 0 <= one[0].shard < 4
    two = sharding.assign(spark.createDataFrame([(1, "x" * 1_000_000), (2, "y")], schema), 4).collect()
    assert sorted(r.size for r in two) == [2, 1_000_001]


def test_written_shards_hold_whole_rows(spark):
    folder = new_path(spark, "shards")
    df = spark.createDataFrame([(i, f"text {i}", i, "k") for i in range(500)], "doc_id long, text string, shard int, other string")
    sharding.write_shards(df.drop("shard"), folder, 4)
    back = spark.read.parquet(folder)
    assert back.count() == 500 and back.select("shard").distinct().count() == 4
    assert {(r.doc_id, r.text, r.other) for r in back.collect()} == {(i, f"text {i}", "k") for i in range(500)}


def divided(rows, text):
    shards = {}
    for r in rows:
        shards.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    return sorted((t for t, held in shards.items() if len(held) > 1), key=len)


def test_equal_texts_stay_together(spark):
    """No group of the given documents is divided."""
    folder = "/root/testdata/sf0.1"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = op8_sharding(spark, folder).collect()
    assert divided(rows, text) == []
    total = sum(r.size for r in rows)
    laws(rows, 16, sharding.GROUP_TOLERANCE * total / 16 + max(r.size for r in rows))


def test_only_a_text_that_fills_shards_is_divided(spark):
    """A third of all rows has one text; other groups are small."""
    text = {i: "hot text" if i % 3 == 0 else f"group {i % 400}" for i in range(9000)}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(5)
    rows = sharding.assign(df, 16).collect()
    assert divided(rows, text) == ["hot text"]
    laws(rows, 16, 2 * sharding.GROUP_TOLERANCE * sum(r.size for r in rows) / 16 + 10)
