"""Codes of text values from a dictionary that is a table, for columns with any number of values.

The dictionary never reaches the driver: its values are counted, range-partitioned and numbered part by part.
Applying it joins each column on its value. Values that more than a ``HOT``-th of all rows hold, fewer than ``HOT`` of
them, are broadcast and so settle the rows that would make the join uneven; all others meet in a shuffled join. A
column with at most ``HOT`` values is broadcast whole, and its rows do not move.

Defined results: null and unknown values get the code after the last known one and no place in the one-hot form;
an empty table gives a dictionary without values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import quoted
from holdfast.operators.encoding import text_columns
from holdfast.workspace import materialise

HOT = 1000
#: Rows that a broadcast has settled are spread over this many keys in the join that follows.
SPREAD = 4096


@dataclass(frozen=True)
class ValueTable:
    """``column, value, n, code, hot``, and the number of values of each column in order."""

    table: DataFrame
    sizes: dict[str, int]

    def offsets(self) -> dict[str, int]:
        """The place of each column's first value among all one-hot places."""
        before, places = 0, {}
        for c, n in self.sizes.items():
            places[c], before = before, before + n
        return places


def fit_values(df: DataFrame, columns: Sequence[str] | None = None, parts: int | None = None) -> ValueTable:
    """Numbers the distinct values of every text column from 0, in the order of their bytes."""
    columns = list(columns or text_columns(df))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(*[F.col(quoted(c)) for c in columns]).unpivot([], [quoted(c) for c in columns], "column", "value")
    counts = materialise(
        texts.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n")), "value-counts")
    # The number of the part is written with its rows: numbering reads it and does not deal them again.
    ranged = materialise(
        counts.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id()), "ranged-values")
    held = materialise(ranged.groupBy("column", "part").agg(F.count("*").alias("m"), F.sum("n").alias("rows")), "value-parts")
    until = Window.partitionBy("column").orderBy("part")
    before = held.select("column", "part", (F.sum("m").over(until) - F.col("m")).alias("before"))
    whole = held.groupBy("column").agg(F.sum("m").alias("size"), F.sum("rows").alias("rows"))
    place = F.row_number().over(Window.partitionBy("column", "part").orderBy("value"))
    # One row per column and part, and one per column.
    coded = ranged.withColumn("place", place).join(F.broadcast(before), ["column", "part"]).join(
        F.broadcast(whole), "column").select(
        "column", "value", "n", (F.col("before") + F.col("place") - 1).alias("code"),
        ((F.col("size") <= HOT) | (F.col("n") * HOT > F.col("rows"))).alias("hot"))
    found = {r["column"]: r["size"] for r in whole.select("column", "size").collect()}
    return ValueTable(materialise(coded, "values"), {c: found.get(c, 0) for c in columns})


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def label_encode(df: DataFrame, values: ValueTable) -> DataFrame:
    """Each column of the dictionary to the code of its value, a long; the other columns stay."""
    order = df.columns
    for c, size in values.sizes.items():
        given, near, far, spread = (_free(df, f"{n}_of_value") for n in ("text", "near", "far", "spread"))
        own = values.table.where(F.col("column") == c)
        hot = own.where("hot").select(F.col("value").alias(given), F.col("code").alias(near))
        df = df.join(F.broadcast(hot), F.col(quoted(c)) == F.col(given), "left").drop(given)
        codes = [F.col(near)]
        if size > HOT:
            cold = own.where("NOT hot").select(
                F.lit(0).alias(f"{spread}_"), F.col("value").alias(given), F.col("code").alias(far))
            settled = F.col(near).isNotNull() | F.col(quoted(c)).isNull()
            row = F.xxhash64(*[F.col(quoted(x)) for x in order])
            df = df.withColumn(spread, F.when(settled, F.pmod(row, F.lit(SPREAD)).cast("int") + 1).otherwise(0))
            df = df.join(cold, (F.col(spread) == F.col(f"{spread}_")) & (F.col(quoted(c)) == F.col(given)), "left")
            codes.append(F.col(far))
        df = df.withColumn(c, F.coalesce(*codes, F.lit(size).cast("bigint"))).select(*[F.col(quoted(x)) for x in order])
    return df


def one_hot_places(df: DataFrame, values: ValueTable, into: str = "places") -> DataFrame:
    """The dictionary's columns replaced by the sorted places, among all known values, that hold a 1."""
    coded = label_encode(df, values)
    offsets = values.offsets()
    held = [
        F.when(F.col(quoted(c)) < size, F.col(quoted(c)) + F.lit(offsets[c]).cast("bigint"))
        for c, size in values.sizes.items()
    ]
    places = F.array_compact(F.array(*held)) if held else F.array().cast("array<bigint>")
    kept = [F.col(quoted(c)) for c in df.columns if c not in values.sizes and c != into]
    return coded.select(*kept, places.alias(into))


def one_hot_vectors(df: DataFrame, values: ValueTable, into: str = "features") -> DataFrame:
    """The same places as one sparse vector column for MLlib; columns without known values add nothing."""
    used = [c for c, size in values.sizes.items() if size]
    coded, hot = label_encode(df, values), [_free(df, f"hot_{i}_of_value") for i in range(len(used))]
    # The number of codes is stated, so that nothing is scanned for it; the last code is the unknown one.
    stated = coded.withColumns({
        h: F.col(quoted(c)).cast("double").alias(
            h, metadata={"ml_attr": {"type": "nominal", "name": h, "num_vals": values.sizes[c] + 1}})
        for h, c in zip(hot, used)
    })
    vectors = [f"{h}_v" for h in hot]
    encoded = OneHotEncoder(inputCols=hot, outputCols=vectors, dropLast=True).fit(stated).transform(stated)
    kept = [c for c in df.columns if c not in values.sizes and c != into]
    return VectorAssembler(inputCols=vectors, outputCol=into).transform(encoded).select(
        *[F.col(quoted(c)) for c in kept], into)
