"""Shards of near equal bytes by histogram sort.

Rows are sorted by 63 bits of their text's hash, ``k``, then by 63 bits, ``r``, of the hash of text and id and of
what differs between repeated rows. The splitters between shards are found by counting: each round sums the
exact bytes below evenly spaced probes inside every splitter's interval, over all partitions, and keeps
the probe interval that holds the target, until the bytes left inside meet the tolerance or the interval
is one key. So equal texts stay together, and a splitter that falls into a group of them goes to the nearer border
of the group. Only where that border is further away than ``GROUP_TOLERANCE`` of a shard, as in a text that fills
several shards, is the group divided, by the same search over ``r``. Then rows are exchanged once.

Defined results: a null text has size 1 and the checksum of the empty text, and is equal to it; an empty table has
no rows; the driver sees at most ``PROBES`` sums per splitter and round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.workspace import materialise

KEY_BITS = 63
TIE_BITS = 10
PROBES = 64
#: Bytes a splitter may miss its target by, as a share of one shard: between different texts, and to keep equal ones together.
TOLERANCE, GROUP_TOLERANCE = 0.0005, 0.02
#: Rows of a shard are numbered in pieces of the key range, this many to the whole range; a piece with over
#: CROWDED times the mean of rows is divided further.
PIECES = 1 << 14
CROWDED = 4
Splitter = tuple[int, int]


def sort_keys(whole: Column, key: Column) -> list[Column]:
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE_BITS)
    by_row = F.shiftrightunsigned(F.xxhash64(whole, key), 64 - KEY_BITS + TIE_BITS)
    return [F.shiftrightunsigned(F.xxhash64(whole), 64 - KEY_BITS).alias("k"), F.shiftleft(by_row, TIE_BITS).bitwiseOR(tie).alias("r")]


def sized(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, k, r`` of each row; the last two are the sort key."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole).cast("bigint") + 1).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        *sort_keys(whole, F.col(key)),
    )


def _counted(rows: DataFrame, column: str, intervals: Sequence[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Bytes in each probe step of each interval ``[low, high)``; keys are (interval, step)."""
    number, step = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for i, (low, high) in enumerate(intervals):
        inside = (F.col(column) >= low) & (F.col(column) <= high - 1)
        width = max(1, -(-(high - low) // PROBES))
        number = F.when(inside, F.lit(i)).otherwise(number)
        step = F.when(inside, F.expr(f"({column} - {low}L) div {width}L")).otherwise(step)
    sums = (
        rows.select(number.alias("i"), step.alias("s"), "size").filter("i is not null")
        .groupBy("i", "s").agg(F.sum("size").alias("bytes")).collect()
    )
    return {(r["i"], r["s"]): r["bytes"] for r in sums}


def _search(rows: DataFrame, column: str, targets: Sequence[float], below: int, allowed: float) -> list[tuple[int, int, int, int]]:
    """For each target the interval of keys that holds it, the bytes before the interval and those inside: within
    ``allowed``, or of one key. ``below`` bytes lie before all rows."""
    state = [(0, (1 << KEY_BITS) - 1, below, None) for _ in targets]
    searching = set(range(len(targets)))
    while searching:
        intervals = sorted({state[i][:2] for i in searching})
        counts = _counted(rows, column, intervals)
        for i in list(searching):
            low, high, before, _ = state[i]
            at, width = intervals.index((low, high)), max(1, -(-(high - low) // PROBES))
            for step in range(PROBES):
                inside = counts.get((at, step), 0)
                if before + inside >= targets[i] or step == PROBES - 1:
                    start = low + step * width
                    stop = min(start + width, high)
                    state[i] = (start, stop, before, inside)
                    if inside <= allowed or stop - start <= 1:
                        searching.remove(i)
                    break
                before += inside
    return state


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, groups: float = GROUP_TOLERANCE) -> list[Splitter]:
    """Sort keys at which shards 1, 2, ... begin; the second key is 0 where no group of equal texts is divided."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * (i + 1) / shards for i in range(shards - 1)]
    allowed = total / shards * tolerance
    found: list[Splitter] = []
    divided: dict[int, tuple[int, list[float]]] = {}
    for target, (low, high, before, inside) in zip(targets, _search(rows, "k", targets, 0, allowed)):
        early, late = target - before, before + inside - target
        if min(early, late) <= max(allowed, total / shards * groups) or high - low > 1:
            found.append((low if early < late else high, 0))
        else:
            divided.setdefault(low, (before, []))[1].append(target)
    for k, (before, own) in divided.items():
        for target, (low, high, less, inside) in zip(own, _search(rows.filter(F.col("k") == k), "r", own, before, allowed)):
            found.append((k, low if target - less < less + inside - target else high))
    return sorted(found)


def shard_of(cuts: Sequence[Splitter]) -> Column:
    """Number of splitters at or before the row."""
    passed = [(F.col("k") > k) | ((F.col("k") == k) & (F.col("r") >= r)) for k, r in cuts]
    return sum((F.when(p, 1).otherwise(0) for p in passed), F.lit(0)).cast("int")


def assign(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text",
           tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; slots count from 0 within a shard, by pieces of the key range.

    Slots are numbered piece by piece: a piece is a part of a shard's key range, or of one with very many rows a part by
    ``r``, and begins where the rows of the pieces before it end.
    """
    rows = materialise(sized(df, key, text), "shard-sizes")
    cuts = splitters(rows, shards, tolerance)
    whole = rows.withColumn("shard", shard_of(cuts)).withColumn(
        "range", F.shiftrightunsigned("k", KEY_BITS - (PIECES.bit_length() - 1)))
    # At most PIECES + shards rows, and parts in proportion to the rows they hold, so as many again at most.
    sizes = materialise(whole.groupBy("shard", "range").agg(F.count("*").alias("n")), "range-sizes")
    most = max(1024.0, CROWDED / PIECES * (sizes.agg(F.sum("n")).first()[0] or 0))
    parts = sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(most))).filter("parts > 1").select("shard", "range", "parts")
    part = F.floor(F.col("r") / F.lit(float(1 << KEY_BITS)) * F.coalesce("parts", F.lit(1))).cast("bigint")
    placed = whole.join(F.broadcast(parts), ["shard", "range"], "left").withColumn("part", part).drop("parts")
    counts = placed.groupBy("shard", "range", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "range", "part").orderBy("k", "r", "doc_id")
    numbered = placed.withColumn("row", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "range", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("row")).alias("slot"))


def write_shards(df: DataFrame, folder: str, shards: int = 16, key: str = "doc_id",
                 text: str = "text", tasks_per_shard: int = 8) -> None:
    """Writes whole rows, one folder per shard, after a single exchange of them.

    ``k``, ``r`` and ``shard`` replace columns of these names while the rows move.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    k, r = sort_keys(whole, F.col(key))
    keyed = df.withColumns({"k": k, "r": r})
    sizes = keyed.select((F.octet_length(whole).cast("bigint") + 1).alias("size"), "k", "r")
    cuts = splitters(materialise(sizes, "shard-sizes"), shards)
    spread = F.pmod(F.xxhash64("k", "r"), F.lit(tasks_per_shard))
    (keyed.withColumn("shard", shard_of(cuts)).repartition(shards * tasks_per_shard, "shard", spread)
     .drop("k", "r").write.partitionBy("shard").parquet(folder))
