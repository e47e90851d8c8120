"""Random forests of two classes whose trees are grown one by one on all rows, and kept as a table of trees.

Inputs become codes of one or two bytes, by bounds that follow from all rows. A task then holds the codes of all rows and
grows a group of trees level by level in numpy, so no counts are shuffled and the driver sees no tree while they grow. A
saved forest is one row for each tree; scoring broadcasts its arrays, about 20 bytes a node.

Trees follow the rules of MLlib's classifier: bagging with replacement, a draw of the root of the number of inputs for each node,
Gini impurity, at least ``leaf`` rows in a child, and no two leaves of one node with the same prediction. All draws follow from
the seed, the number of the tree and the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TREES = "tree int, feature binary, bin binary, child binary, share binary, sets binary, importance binary"
#: Types of the arrays of a tree: input that a node asks (-1 in a leaf), its bound or set, its left child (the right one
#: follows), the share of class 1, and the sets of codes that go left, one row of bits each.
KINDS = {"feature": "<i2", "bin": "<i4", "child": "<i4", "share": "<f8", "sets": "?", "importance": "<f8"}
LEAST_GAIN = 1e-12
#: Rows whose codes are looked up at a time, so that what is in between stays in the cache.
BLOCK = 1 << 14


def categories(metadata: Mapping, width: int) -> list[bool]:
    """Whether each input is a category, by the attributes of the vector column."""
    found = [False] * width
    for attribute in metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", []):
        found[attribute["idx"]] = True
    return found


def bounds(rows: DataFrame, inputs: str, category: Sequence[bool], total: int, bins: int) -> list[list[float]]:
    """Bounds between the codes of each input, from the values of all rows; a category needs none.

    Halfway between values where there are at most ``bins`` of them, else after the values at which the running number of rows
    passes a multiple of ``total / bins``.
    """
    each = rows.select(F.posexplode(vector_to_array(inputs)).alias("input", "value"))
    numbers = [i for i, c in enumerate(category) if not c]
    counted = each.where(F.col("input").isin(numbers)).groupBy("input", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("input").orderBy("value")
    placed = counted.select(
        "input", "value", "n", F.lead("value").over(order).alias("next"), F.sum("n").over(order).alias("upto"),
        F.count(F.lit(1)).over(Window.partitionBy("input")).alias("values"))
    chosen = placed.where(
        f"next IS NOT NULL AND (values <= {bins} OR upto * {bins} DIV {total} > (upto - n) * {bins} DIV {total})")
    found: list[list[float]] = [[] for _ in category]
    for r in chosen.select("input", F.expr("value / 2 + next / 2").alias("bound")).collect():
        found[r["input"]].append(r["bound"])
    return [sorted(set(b)) for b in found]


def encode(values: np.ndarray, limits: Sequence[Sequence[float]], category: Sequence[bool], bins: int) -> np.ndarray:
    """A code for each value: the number of bounds below it, or the category itself."""
    codes = np.empty(values.shape, code_type(bins))
    for i, limit in enumerate(limits):
        column = values[:, i]
        codes[:, i] = np.clip(column, 0, bins - 1) if category[i] else np.searchsorted(np.asarray(limit), column, "left")
    return codes


def code_type(bins: int) -> str:
    return "u1" if bins <= 256 else "<u2"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def coded(rows: DataFrame, inputs: str, keep: Sequence[str], target: str, limits, category, bins: int) -> DataFrame:
    """``keep…, target, codes``: the inputs of each row as bytes."""
    width = len(category)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(_matrix(batch.column("values"), width), limits, category, bins)
            step = width * codes.itemsize
            offsets = np.arange(len(codes) + 1, dtype="<i4") * step
            cells = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())])
            columns = [batch.column(c) for c in (*keep, target)]
            yield pa.RecordBatch.from_arrays([*columns, cells], [*keep, target, "codes"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, target)) + ", codes binary"
    return rows.select(*keep, target, vector_to_array(inputs).alias("values")).mapInArrow(code, schema)


def grow(
    codes: np.ndarray, labels: np.ndarray, weights: tuple[float, float], category: np.ndarray, bins: int,
    depth: int, leaf: int, share_of_inputs: int, seed: Sequence[int],
) -> dict[str, np.ndarray]:
    """The arrays of one tree; ``codes`` has a row for each row."""
    n, width = codes.shape
    used = int(codes.max(initial=1)) + 1
    flat, draw = codes.reshape(-1), np.random.default_rng(seed)
    bag = draw.poisson(1.0, n).astype("u1")
    rows = np.flatnonzero(bag)
    # Where the codes of a row begin, its label, how often it was drawn, and the place of its node among those of the level.
    start, label, times = rows * width, labels[rows].astype(np.int64), bag[rows].astype(np.float64)
    node = np.zeros(len(rows), np.int64)
    key = np.empty(len(rows), np.int64)
    del rows, bag
    totals = np.bincount(label, times, 2).reshape(1, 2)
    w = np.asarray(weights)
    counts, feature, bound, child, gains, sets = [totals], [], [], [], [], []
    n_sets, made, levels = 0, 1, [0]
    open_nodes = np.arange(1)  # among the nodes of this level

    for level in range(depth + 1):
        here = len(counts[-1])
        levels.append(levels[-1] + here)
        f_level, b_level = np.full(here, -1, "<i2"), np.zeros(here, "<i4")
        c_level, g_level = np.full(here, -1, "<i4"), np.zeros(here)
        a = len(open_nodes)
        if level < depth and a:
            whole = counts[-1][open_nodes]
            best, best_f, best_b = np.full(a, -np.inf), np.zeros(a, np.int64), np.zeros(a, np.int64)
            best_left, best_set = np.zeros((a, 2)), np.zeros((a, bins), bool)
            cell = node * (2 * used) + label
            drawn = np.sort(np.argpartition(draw.random((a, width)), share_of_inputs - 1, axis=1)[:, :share_of_inputs], axis=1)
            for j in range(share_of_inputs):
                f = np.ascontiguousarray(drawn[:, j])
                key = key[: len(node)]
                for at in range(0, len(node), BLOCK):
                    place = f.take(node[at : at + BLOCK])
                    place += start[at : at + BLOCK]
                    np.multiply(flat.take(place), 2, out=place, casting="unsafe", dtype=np.int64)
                    np.add(place, cell[at : at + BLOCK], out=key[at : at + BLOCK])
                held = np.bincount(key, times, a * used * 2).reshape(a, used, 2)
                nominal = np.flatnonzero(category[f])
                if len(nominal):
                    of = held[nominal]
                    one = of[:, :, 1] * w[1]
                    size = of[:, :, 0] * w[0] + one
                    rank = np.argsort(np.where(size > 0, one / np.where(size > 0, size, 1), np.inf), axis=1, kind="stable")
                    held[nominal] = np.take_along_axis(of, rank[:, :, None], axis=1)
                left = held.cumsum(axis=1)[:, :-1]
                pure = _purity(left[:, :, 0], left[:, :, 1], whole, w, leaf)
                at = pure.argmax(axis=1)
                better = np.flatnonzero(pure[np.arange(a), at] > best)
                best[better], best_f[better], best_b[better] = pure[better, at[better]], f[better], at[better]
                best_left[better] = left[better, at[better]]
                if len(nominal):
                    went = better[category[f[better]]]
                    place = np.full(a, -1)
                    place[nominal] = np.arange(len(nominal))
                    chosen = np.zeros((len(went), bins), bool)
                    np.put_along_axis(chosen, rank[place[went]], np.arange(used)[None, :] <= at[went][:, None], axis=1)
                    best_set[went] = chosen
            weighed = whole * w
            size = weighed.sum(axis=1)
            gain = (best - (weighed**2).sum(axis=1) / size) / size
            split = np.flatnonzero(gain > LEAST_GAIN)
            ids = open_nodes[split]
            f_level[ids], g_level[ids] = best_f[split], gain[split] * size[split]
            nominal = category[best_f[split]]
            b_level[ids] = np.where(nominal, n_sets + nominal.cumsum() - 1, best_b[split])
            sets.append(best_set[split][nominal])
            n_sets += int(nominal.sum())
            c_level[ids] = made + 2 * np.arange(len(split))
            made += 2 * len(split)
            below = np.stack([best_left[split], whole[split] - best_left[split]], axis=1).reshape(-1, 2)
            goes_on = (below.min(axis=1) > 0) & (below.sum(axis=1) >= 2 * leaf) & (level + 1 < depth)
            open_nodes = np.flatnonzero(goes_on)
            number = np.where(goes_on, goes_on.cumsum() - 1, -1)
            to = np.full((a, 2), -1)
            to[split] = number.reshape(-1, 2)
            asked = best_f[node]
            code = flat[start + asked]
            left_side = code <= best_b[node]
            by_set = np.flatnonzero(category[asked])
            left_side[by_set] = best_set[node[by_set], code[by_set]]
            node = to[node, 1 - left_side.astype(np.int64)]
            stay = node >= 0
            node, start, label, times = node[stay], start[stay], label[stay], times[stay]
        else:
            below = np.zeros((0, 2))
        for kept, new in ((feature, f_level), (bound, b_level), (child, c_level), (gains, g_level)):
            kept.append(new)
        if not len(below):
            break
        counts.append(below)
    tree = {
        "feature": np.concatenate(feature), "bin": np.concatenate(bound), "child": np.concatenate(child),
        "sets": np.concatenate(sets) if sets else np.zeros((0, bins), bool),
    }
    return _finished(tree, np.concatenate(counts) * w, np.concatenate(gains), levels, width)


def _purity(left_0: np.ndarray, left_1: np.ndarray, whole: np.ndarray, w: np.ndarray, leaf: int) -> np.ndarray:
    """Sum over both children of squared class weights by weight, which is the larger the less impure they are."""
    right_0, right_1 = whole[:, :1] - left_0, whole[:, 1:] - left_1
    fits = (left_0 + left_1 >= leaf) & (right_0 + right_1 >= leaf)
    found = np.full(left_0.shape, -np.inf)
    total = np.zeros(left_0.shape)
    for zero, one in ((left_0, left_1), (right_0, right_1)):
        zero, one = zero * w[0], one * w[1]
        size = zero + one
        size[size == 0] = 1
        total += (zero * zero + one * one) / size
    np.copyto(found, total, where=fits)
    return found


def _finished(tree: dict[str, np.ndarray], weighed: np.ndarray, gains: np.ndarray, levels: list[int], width: int) -> dict[str, np.ndarray]:
    """Leaves of one node with the same prediction become one, and what is left moves together."""
    feature, child = tree["feature"], tree["child"]
    says = weighed[:, 1] > weighed[:, 0]
    for begin, end in zip(levels[-2::-1], levels[:0:-1]):
        inner = begin + np.flatnonzero(child[begin:end] >= 0)
        left = child[inner]
        same = inner[(child[left] < 0) & (child[left + 1] < 0) & (says[left] == says[left + 1])]
        child[same], feature[same] = -1, -1
    reached = np.zeros(len(child), bool)
    reached[0] = True
    for begin, end in zip(levels[:-1], levels[1:]):
        inner = begin + np.flatnonzero(reached[begin:end] & (child[begin:end] >= 0))
        reached[child[inner]] = reached[child[inner] + 1] = True
    moved = reached.cumsum() - 1
    inner = reached & (child >= 0)
    importance = np.bincount(feature[inner], gains[inner], width)
    child[inner] = moved[child[inner]]
    return {
        "feature": feature[reached], "bin": tree["bin"][reached], "child": child[reached],
        "share": (weighed[:, 1] / weighed.sum(axis=1))[reached], "sets": tree["sets"], "importance": importance,
    }


def grown(
    ordered: DataFrame, target: str, total: int, trees: Sequence[int], weights: tuple[float, float],
    category: Sequence[bool], bins: int, depth: int, leaf: int, share_of_inputs: int, seed: int,
) -> DataFrame:
    """A row of :data:`TREES` for each of ``trees``, all grown in one task on the rows in their order."""
    width, kind = len(category), np.dtype(code_type(bins))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, labels, filled = np.empty((total, width), kind), np.empty(total, "u1"), 0
        for batch in batches:
            n = batch.num_rows
            if filled + n > total:
                raise ValueError(f"more than {total} rows to fit on")
            label = np.asarray(batch.column(target))
            if not np.isin(label, (0, 1)).all():
                raise ValueError("labels other than 0 and 1")
            offsets = np.frombuffer(batch.column("codes").buffers()[1], "<i4")[batch.column("codes").offset:][: n + 1]
            held = np.frombuffer(batch.column("codes").buffers()[2], "u1")[offsets[0] : offsets[-1]]
            codes[filled : filled + n] = held.view(kind).reshape(n, width)
            labels[filled : filled + n] = label
            filled += n
        for number in trees:
            tree = grow(
                codes[:filled], labels[:filled], weights, np.asarray(category), bins, depth, leaf, share_of_inputs, [seed, number])
            cells = [pa.array([np.ascontiguousarray(tree[c], kind).tobytes()], pa.binary()) for c, kind in KINDS.items()]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *cells], ["tree", *KINDS])

    # One task: the parts come one after the other, so in the order of their numbers.
    return ordered.select(target, "codes").coalesce(1).mapInArrow(work, TREES)


def _ones(n: np.ndarray) -> np.ndarray:
    """Words whose ``n`` lowest bits are set, from none to all 64."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


class Trees:
    """The arrays of all trees one after the other, as scoring wants them.

    A node holds its left child and the input it asks in one number, and a bit for each code that goes left, in words of 64.
    """

    def __init__(self, rows: Iterable, limits: Sequence[Sequence[float]], category: Sequence[bool], bins: int):
        self.limits, self.category, self.bins = limits, np.asarray(category), bins
        self.words = -(-bins // 64)
        held = {r["tree"]: self._packed({c: np.frombuffer(r[c], KINDS[c]) for c in KINDS if c != "importance"}) for r in rows}
        parts = [held.pop(number) for number in sorted(held)]
        self.roots = np.cumsum([0, *[len(p[0]) for p in parts]])
        self.depths = [p[3] for p in parts]
        self.asks, self.goes_left, self.share = (np.concatenate([p[i] for p in parts]) for i in range(3))

    def _packed(self, tree: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """What a node asks and leads to, its bits, the share of class 1, and the number of levels below the root."""
        feature, bound, n = tree["feature"], tree["bin"], len(tree["child"])
        inner = feature >= 0
        bits = _ones(bound[:, None].astype(np.int64) + 1 - 64 * np.arange(self.words))
        by_set = inner & self.category[feature]
        sets = np.zeros((len(tree["sets"]) // self.bins, 64 * self.words), bool)
        sets[:, : self.bins] = tree["sets"].reshape(-1, self.bins)
        bits[by_set] = np.packbits(sets, axis=1, bitorder="little").view("<u8")[bound[by_set]]
        # A leaf leads to itself whatever its input is, so rows that have arrived stay.
        bits[~inner] = ~np.uint64(0)
        child = np.where(inner, tree["child"], np.arange(n)).astype(np.int64)
        depth, level = 0, np.zeros(1, np.int64)
        while len(level := level[inner[level]]):
            level, depth = np.concatenate([child[level], child[level] + 1]), depth + 1
        return child << 16 | np.where(inner, feature, 0), bits.reshape(-1), tree["share"], depth

    def score(self, values: np.ndarray) -> np.ndarray:
        """The mean over all trees of the share of class 1 in the leaf that a row falls into."""
        codes = encode(values, self.limits, self.category, self.bins)
        n, width = codes.shape
        flat, start, total = codes.reshape(-1), np.arange(n) * width, np.zeros(n)
        for root, end, depth in zip(self.roots, self.roots[1:], self.depths):
            asks, share = self.asks[root:end], self.share[root:end]
            goes_left = self.goes_left[root * self.words : end * self.words]
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                ask = asks.take(node)
                code = flat.take(start + (ask & 0xFFFF))
                word = node if self.words == 1 else node * self.words + (code >> 6)
                left = goes_left.take(word) >> (code & 63) & np.uint64(1)
                node = (ask >> 16) + 1 - left.astype(np.int64)
            # In a leaf that was reached early every code goes left, to itself.
            total += share.take(node)
        return total / len(self.depths)


class Tree:
    """One tree, to look at."""

    def __init__(self, row):
        self.numNodes = len(row["child"]) // 4
        self.row = row

    @property
    def toDebugString(self) -> str:
        held = {c: np.frombuffer(self.row[c], KINDS[c]).tolist() for c in ("feature", "bin", "child", "share")}
        return "\n".join(
            f"{i}: share {s}" if c < 0 else f"{i}: input {f} by {b}: {c}, else {c + 1}"
            for i, (f, b, c, s) in enumerate(zip(held["feature"], held["bin"], held["child"], held["share"])))


class ForestModel(Model, MLReadable, MLWritable):
    """Adds ``probability``, ``score`` (the probability of class 1) and ``prediction`` to rows with a vector of inputs.

    ``table`` has a row of :data:`TREES` for each tree. The driver reads it when rows are scored or importances are asked for.
    """

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "column with the vector of inputs", TypeConverters.toString)
    bins = Param(Params._dummy(), "bins", "number of codes of an input at most", TypeConverters.toInt)
    limits = Param(Params._dummy(), "limits", "bounds between the codes of each input")
    category = Param(Params._dummy(), "category", "whether each input is a category")

    @keyword_only
    def __init__(self, *, numTrees=None, featuresCol=None, bins=None, limits=None, category=None):
        super().__init__()
        self.table: DataFrame | None = None
        self._importance: np.ndarray | None = None
        self._sent = None
        self._set(**self._input_kwargs)

    def over(self, table: DataFrame) -> ForestModel:
        self.table = table
        return self

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault("numTrees")

    @property
    def trees(self) -> list[Tree]:
        return [Tree(r) for r in sorted(self.table.collect(), key=lambda r: r["tree"])]

    def _trees(self) -> Trees:
        return Trees(self.table.toLocalIterator(), *[self.getOrDefault(p) for p in ("limits", "category", "bins")])

    @property
    def featureImportances(self) -> DenseVector:
        if self._importance is None:
            rows = self.table.select("tree", "importance").collect()
            each = np.stack([np.frombuffer(r["importance"], KINDS["importance"]) for r in sorted(rows, key=lambda r: r["tree"])])
            sums = each.sum(axis=1, keepdims=True)
            summed = np.divide(each, sums, out=np.zeros_like(each), where=sums > 0).sum(axis=0)
            self._importance = summed / (summed.sum() or 1.0)
        return DenseVector(self._importance)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._sent is None:
            # The driver keeps no copy of its own.
            self._sent = dataset.sparkSession.sparkContext.broadcast(self._trees())
        sent, width = self._sent, len(self.getOrDefault("category"))

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            return pa.array(sent.value.score(_matrix(values, width)))

        scored = dataset.withColumn("score", score(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        return scored.withColumns({
            "probability": array_to_vector(F.array(1.0 - F.col("score"), F.col("score"))),
            "prediction": F.when(F.col("score") > 0.5, 1.0).otherwise(0.0),
        })

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active())
        self.model.table.coalesce(8).write.parquet(f"{path}/trees")


class ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = ForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model.over(spark.read.schema(TREES).parquet(f"{path}/trees"))


def inputs_drawn(width: int) -> int:
    """Inputs that each node may ask."""
    return math.ceil(math.sqrt(width))
