"""Exact search for the highest inner products, by a pivot-distance index.

Components become ``floor(64 * x)``. With one more component that brings every vector to the same length,
a higher inner product with a query is a smaller distance from it, so the triangle inequality holds.
Each vector is keyed by its nearest pivot and its distance from it; a cell is a ring of one pivot, and
very full cells are divided. A query visits its cells in order of the smallest distance that a member can
have, in waves; after each wave the score of its worst result so far gives a radius, and cells that lie
wholly outside are never visited. The search ends when no query has a cell left.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; shorter
vectors count as filled up with zeros; ties go to the smaller id; a row's own id is no result of it, nor
are other rows with the same id; rows without id take no part. Scores are exact while they stay
below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.workspace import materialise

SCALE = 64
PIVOTS = 48
#: Vectors that pivots are fitted on at most; every vector is indexed.
SAMPLE = 4096
RINGS = 16
#: Most vectors of a cell and queries of a block that meet in one task at a time.
CELL, BLOCK = 4096, 4096
#: Cells that a query visits in the first wave; each later wave takes four times as many.
FIRST = 4


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (array of doubles with whole values) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col(key).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample by Lloyd's method, from a fixed start."""
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)]
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = sample[near == k].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Index:
    """``cells``: ``cell, id, v`` of every vector; ``rings``: a row per cell, its pivot and distances."""

    def __init__(self, vectors: DataFrame, width: int, longest: float, centres: np.ndarray):
        self.width, self.longest, self.centres = width, longest, centres
        step = max(2 * np.sqrt(longest) / RINGS / 2, 1e-9)

        def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v = _matrix(batch["v"], width)
                rest = np.sqrt(np.maximum(longest - (v * v).sum(1), 0))
                far = _distances(np.column_stack([v, rest]), centres)
                pivot = far.argmin(1)
                near = far[np.arange(len(far)), pivot] if len(far) else np.empty(0)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "pivot": pivot.astype("int32"), "far": near,
                                    "ring": (near / step).astype("int32")})

        keyed = materialise(vectors.mapInPandas(key, "id bigint, v array<double>, pivot int, far double, ring int"), "keyed-vectors")
        full = materialise(keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n")), "ring-sizes")
        parts = F.ceil(F.col("n") / CELL)
        # A ring has a row per pivot and distance step, whatever the number of vectors.
        placed = keyed.join(F.broadcast(full), ["pivot", "ring"]).select(
            "id", "v", "far", "pivot", F.concat_ws(":", "pivot", "ring", F.pmod(F.xxhash64("id"), parts)).alias("cell"))
        self.cells = materialise(placed, "cells")
        self.rings = materialise(self.cells.groupBy("cell", "pivot").agg(
            F.min("far").alias("near"), F.max("far").alias("far")), "rings")


def build(vectors: DataFrame) -> Index | None:
    """The index of ``id, v``; None if there are no vectors."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(_square("v")).alias("longest")).first()
    if not size["n"]:
        return None
    share = max(1, size["n"] // SAMPLE)
    some = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE)
    drawn = [r["v"] for r in some.collect()] or [vectors.first()["v"]]
    sample = _matrix(drawn, size["width"])
    rest = np.sqrt(np.maximum(size["longest"] - (sample * sample).sum(1), 0))
    return Index(vectors, size["width"], size["longest"], fit_pivots(np.column_stack([sample, rest]), PIVOTS))


def _square(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds its ``k`` highest scores."""
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    every = materialise(quantised(df, key, vector), "vectors")
    index = build(every)
    if index is None:
        return spark.createDataFrame([], schema)
    queries = materialise(quantised(df.filter(is_query), key, vector).dropDuplicates(["id"]), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    visits = materialise(_visits(queries, index), "visits")
    best, low, high = None, 0, FIRST
    while True:
        wave = visits.filter((F.col("place") >= low) & (F.col("place") < high))
        rest = visits.filter(F.col("place") >= high)
        if best is not None:
            # The radius of the worst of k results so far: nothing nearer can be outside it.
            radius = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
            within = (2 * F.col("worst") <= F.col("reach")) | F.col("worst").isNull()
            wave = wave.join(radius, "query_id", "left").filter(within).drop("worst")
            rest = rest.join(radius, "query_id", "left").filter(within).drop("worst")
            visits = materialise(rest, "visits-left")
            rest = visits
        found = _scored(wave, queries, index, k)
        pool = found if best is None else found.unionByName(best.select("query_id", "vec_id", "score"))
        best = materialise(_ranked(pool, k), "best")
        if rest.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")
        low, high = high, high * 4


def _visits(queries: DataFrame, index: Index) -> DataFrame:
    """``query_id, block, cell, reach, place``: a query's cells by rising smallest distance.

    ``reach`` is the most that twice a member's score can be. The stated queries meet the rings, a
    bounded number per pivot, in blocks.
    """
    centres, width, longest = index.centres, index.width, index.longest

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["id_v"], width)
            away = _distances(np.column_stack([v, np.zeros(len(v))]), centres)
            yield pd.DataFrame({
                "query_id": np.repeat(batch["id"].to_numpy(), len(centres)),
                "block": np.repeat(batch["block"].to_numpy(), len(centres)),
                "square": np.repeat((v * v).sum(1), len(centres)),
                "pivot": np.tile(np.arange(len(centres), dtype="int32"), len(v)),
                "away": away.ravel()})

    to_pivots = queries.select("id", "block", F.col("v").alias("id_v")).mapInPandas(
        far, "query_id bigint, block int, square double, pivot int, away double")
    gap = F.greatest(F.lit(0.0), F.col("away") - F.col("far"), F.col("near") - F.col("away"))
    # A little slack for rounding in the distances.
    reach = F.col("square") + longest - gap * gap + 1e-6 * (F.col("square") + longest) + 1e-6
    order = Window.partitionBy("query_id").orderBy(F.desc("reach"), "cell")
    return to_pivots.join(index.rings, "pivot").select("query_id", "block", "cell", reach.alias("reach")).withColumn(
        "place", F.row_number().over(order) - 1)


def _scored(wave: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The ``k`` best of each visited cell for each query that visits it."""
    width = index.width
    asked = wave.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").select(
        "cell", "block", "query_id", "q")
    used = wave.select("cell", "block").distinct()
    members = index.cells.select("cell", "id", "v").join(used, "cell").select("cell", "block", "id", "v").toDF(
        "cell_m", "block_m", "id", "v")

    def score(_, asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(members):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        members = members.sort_values("id", kind="stable")
        ids, m = members["id"].to_numpy(), _matrix(members["v"], width).T.copy()
        out = []
        for start in range(0, len(asked), 256):
            some = asked.iloc[start : start + 256]
            scores = _matrix(some["q"], width) @ m
            for query, row in zip(some["query_id"].to_numpy(), scores):
                row[ids == query] = -np.inf
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    some_of = np.flatnonzero(row >= least)
                else:
                    some_of = np.arange(len(row))
                some_of = some_of[row[some_of] > -np.inf]
                some_of = some_of[np.lexsort((ids[some_of], -row[some_of]))][:k]
                out.append((np.full(len(some_of), query), ids[some_of], row[some_of].astype("int64")))
        return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    return asked.groupBy("cell", "block").cogroup(members.groupBy("cell_m", "block_m")).applyInPandas(
        score, "query_id bigint, vec_id bigint, score bigint")


def _ranked(pool: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pool.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
