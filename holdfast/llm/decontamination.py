"""Benchmark passages inside documents, by size-partitioned MinHash containment, in DataFrame functions only.

The minimum of an item's shingles under a hash function is one of its shingles, and a document that
contains a share ``c`` of the item has that shingle with probability ``c``. So the minima of an item under
several functions are its anchors, and the share of anchors that a document has estimates how much of
the item it contains, however long the document is. Items are partitioned by size: the smallest use
every shingle as an anchor, which makes their search exact; each class of larger ones has a number of functions of
its own, and a threshold that grows with it, so that long items find few documents by chance. A
document with the class's number of anchors of an item, and with enough shingles of its own, is a candidate,
and candidates are verified by exact containment of the shingles as text.

An item of which a document contains 80 % is missed with a probability below 1e-7.

Defined results: shingles are five words, A-Z in lower case; an item of fewer words is one shingle of its
length; items and documents without words take no part; rows that share an id are one item or document, rows without
id are known by their text.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.workspace import materialise

WIDTH = 5
PERCENT = 80
#: Items by size: up to so many shingles, functions, and anchors that a candidate must have. Up to the first number all
#: shingles are anchors. Of an item of which a document holds 80 %, the classes miss 0, 1.3e-8, 8e-9 and 3e-9.
WHOLE = 16
CLASSES = ((64, 16, 3), (256, 24, 6), (1 << 62, 32, 11))


def words(text: str) -> Column:
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(said: Column, widths: Sequence[int], join: Callable[..., Column]) -> Column:
    """``join`` of every ``width`` words in a row, for each of the widths.

    The words are bound to a variable of an outer transform, so that they are made once for a text:
    the optimizer would put the expression of a column into the inner function, once per word.
    """
    def every(w: Column, width: int) -> Column:
        each = F.transform(w, lambda first, i: join(width, first, *[F.get(w, i + k) for k in range(1, width)]))
        return F.slice(each, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))

    if len(widths) == 1:
        return F.flatten(F.transform(F.array(said), lambda w: every(w, widths[0])))
    return F.flatten(F.transform(F.array(said), lambda w: F.flatten(F.array(*[every(w, n) for n in widths]))))


def hashed(width: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(width), *parts)


def spelled(width: int, *parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def both(width: int, *parts: Column) -> Column:
    return F.struct(spelled(width, *parts).alias("shingle"), hashed(width, *parts).alias("h"))


def _owner(key: str, text: str) -> Column:
    """Id, and the hash of the text where there is none: such rows are known by their text."""
    unnamed = F.col(key).isNull()
    return F.struct(F.col(key).alias("id"), F.when(unnamed, F.xxhash64(text)).alias("h1"),
                    F.when(unnamed, F.xxhash64(F.lit(1), text)).alias("h2"))


def item_table(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``item_id, width, shingle, h, n``: the distinct shingles of each item, their hash and their number."""
    said = items.select(_owner(key, text).alias("item_id"), words(text).alias("words")).filter(F.size("words") > 0)
    said = said.withColumn("width", F.least(F.size("words"), F.lit(width)))
    parts = [
        said.filter(F.col("width") == w)
        .select("item_id", "width", F.explode(shingles_of(F.col("words"), [w], both)).alias("s"))
        .select("item_id", "width", "s.shingle", "s.h")
        for w in range(1, width + 1)
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.distinct()
    sizes = every.groupBy("item_id").agg(F.count("*").alias("n"))
    return materialise(every.join(sizes, "item_id"), "benchmark-shingles")


def anchor_table(shingles: DataFrame, whole: int, classes: Sequence[tuple[int, int, int]], percent: int) -> DataFrame:
    """``h, item_id, j, least, fewest, width``: the anchors by hash, with what a candidate must have."""
    small = F.col("n") <= whole

    def of_class(place: int) -> Column:
        return F.coalesce(*[F.when(F.col("n") <= c[0], F.lit(c[place])) for c in classes])

    fewest = F.expr(f"cast(ceil(n * {percent} / 100.0D) as int)")
    all_of = shingles.filter(small).select(
        "h", "item_id", (F.row_number().over(_each_item()) - 1).alias("j"), fewest.alias("least"),
        fewest.alias("fewest"), "width")
    minima = (
        shingles.filter(~small).withColumn("j", F.explode(F.sequence(F.lit(0), of_class(1) - 1)))
        .groupBy("item_id", "j").agg(F.min_by("h", F.xxhash64("j", "h")).alias("h"),
                                     F.first(of_class(2)).alias("least"), F.first(fewest).alias("fewest"),
                                     F.first("width").alias("width"))
        .select("h", "item_id", "j", "least", "fewest", "width")
    )
    return materialise(all_of.unionByName(minima), "anchors")


def _each_item():
    return Window.partitionBy("item_id").orderBy("h", "shingle")


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
              item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT,
              width: int = WIDTH, whole: int = WHOLE, classes: Sequence[tuple[int, int, int]] = CLASSES) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` where ``100 * n_shared >= percent * n_item``.

    The tables of anchors and candidates are written first, so the planner knows their size when it
    chooses between sending them to all tasks and shuffling the other side.
    """
    shingles = item_table(items, item_key, item_text, width)
    anchored = anchor_table(shingles, whole, classes, percent)
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    if not widths:
        widths = [width]
    said = docs.select(_owner(key, text).alias("doc_id"), F.col(text).alias("said"))
    # The outer form, as for the other the planner would make the shingles a second time to filter by.
    seen = said.select("doc_id", F.array_distinct(shingles_of(words("said"), widths, hashed)).alias("grams")).select(
        "doc_id", F.size("grams").alias("size"), F.explode_outer("grams").alias("h"))
    met = seen.join(anchored, "h").filter(F.col("size") >= F.col("fewest"))
    candidates = materialise(
        met.groupBy("doc_id", "item_id").agg(
            F.expr("bit_count(bit_or(shiftleft(1L, j)))").alias("met"),
            F.first("least").alias("least"))
        .filter("met >= least").select("doc_id", "item_id"), "contamination-candidates")

    wanted = candidates.select(F.col("doc_id").alias("wanted")).distinct()
    own = said.join(wanted, F.col("doc_id") == F.col("wanted"))
    found = own.select("doc_id", F.explode(F.array_distinct(shingles_of(words("said"), widths, spelled))).alias("shingle"))
    pairs = candidates.select(F.col("doc_id").alias("of_doc"), "item_id").join(shingles, "item_id")
    return (
        found.join(pairs, (F.col("doc_id") == F.col("of_doc")) & (found["shingle"] == pairs["shingle"]))
        .select("doc_id", "item_id", "n", found["shingle"].alias("shingle")).distinct()
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_item"))
        .filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
        .select(F.col("doc_id.id").alias("doc_id"), F.col("item_id.id").alias("item_id"), "n_item", "n_shared")
    )
