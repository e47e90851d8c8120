"""Removal of repeated passages: every byte covered by ``length`` bytes that also start anywhere else.

1. Every window of ``length`` bytes is assigned to its anchor, the least hash of the ``GRAM``-byte strings in it. Windows
   in a row with the same anchor form a piece. Equal windows have equal anchors, so they meet wherever they are.
2. Anchors are counted. A piece whose anchor occurs once cannot repeat anything; a bit table of fixed size, sent
   to all tasks, lets the others through. Where it is full it lets too many through, which costs time only.
3. Equal pieces collapse by hash while they are grouped, so copies cost one piece; all windows of such a piece repeat.
4. Different pieces of an anchor go to the same shard, of ``SHARD_BYTES`` about. Each shard sorts its suffixes by
   Larsson-Sadakane refinement and gets their common prefixes by Kasai's algorithm; a window whose neighbour shares
   ``length`` bytes repeats.
5. An anchor with more pieces than a shard holds is spread over several. These write their windows as sorted
   128-bit digests, divided by range, and the ranges are merged by binary search.
6. The places found go back to the texts by the hash of the piece, and overlapping windows are joined there.

Defined results: null and empty texts have no bytes and nothing to remove; matches never cross texts; equal texts and
repeated rows count as other places, so they go whole if they are long enough; what is left is bytes, as a cut may
fall into a character; other columns stay, and columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.batches import extended, slices
from holdfast.llm.shingles import mix
from holdfast.llm.suffixes import Pieces
from holdfast.workspace import materialise

LENGTH = 200
#: Bytes hashed for an anchor, at most; windows are longer.
GRAM = 32
SLICE_BYTES = 1 << 22
#: Text sorted by one task at a time.
SHARD_BYTES = 1 << 20
#: Bits of the table of repeated anchors (16 MB).
TABLE_BITS = 1 << 27
#: Hashes leave room for the place of a byte within a slice.
PLACE = np.uint64(26)
DIGEST = 16


class Anchors:
    """Anchors of all windows of many texts."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, max(1, length // 4))
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers, self.inverses = (
                np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, step))) for step in (self.base, self.inverse))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of the ``gram`` bytes from each place."""
        self._grow(len(data))
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64)
        ends = sums[self.gram - 1 :].copy()
        ends[1:] -= sums[: len(ends) - 1]
        return mix(ends * self.inverses[: len(ends)])

    def pieces(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, start and end of every piece of a text, in blocks as long as places can be held."""
        found = ([], [], [])
        data, step = np.frombuffer(text, np.uint8), SLICE_BYTES
        for at in range(0, max(len(data) - self.length + 1, 0), step):
            block = data[at : at + step + self.length - 1]
            for column, values in zip(found, self._block(block)):
                column.append(values + (0 if column is found[0] else at))
        if not found[0]:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(column) for column in found)

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width, windows = self.length - self.gram + 1, len(data) - self.length + 1
        ranked = self.hashes(data) >> PLACE << PLACE | np.arange(len(data) - self.gram + 1, dtype=np.uint64)
        padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max)
        padded[: len(ranked)] = ranked
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        heads = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        anchors = (least[heads] >> PLACE).astype(np.int64)
        return anchors, heads, np.append(heads[1:], windows) + self.length - 1


def _texts(batch: pa.RecordBatch) -> dict[tuple, list]:
    """Number and bytes of each different text of a batch."""
    found: dict[tuple, list] = {}
    for t1, t2, text in zip(*[batch.column(c).to_pylist() for c in ("t1", "t2", "text")]):
        found.setdefault((t1, t2), [0, text])[0] += 1
    return found


def anchor_counts(texts: DataFrame, length: int) -> DataFrame:
    """``anchor, n``: the number of pieces per anchor, already added up within each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in slices(batches, "text", SLICE_BYTES):
            found = _texts(batch)
            own = [anchors.pieces(text)[0] for _, text in found.values()]
            if sum(map(len, own)):
                times = np.repeat([n for n, _ in found.values()], list(map(len, own)))
                values, places = np.unique(np.concatenate(own), return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "anchor": values, "n": np.bincount(places, times, len(values)).astype(np.int64)})

    return texts.mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def repeated_anchors(counts: DataFrame) -> np.ndarray:
    """Bit table of the anchors that occur more than once; its size does not depend on the data."""
    bit = F.pmod("anchor", F.lit(TABLE_BITS))
    words = counts.filter("n > 1").groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(anchor, {TABLE_BITS}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint8)


def _digests(pieces: list[bytes]) -> list[bytes]:
    return [hashlib.blake2b(p, digest_size=DIGEST).digest() for p in pieces]


def pieces_of(texts: DataFrame, table: np.ndarray, length: int) -> DataFrame:
    """``t1, t2, first, piece, anchor, size, n, bytes`` for every piece whose anchor is in the table: its text, place, digest,
    anchor, length and the number of equal texts of the slice; ``bytes`` only at its first place in a slice."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(table)
    fields = [("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.int64()), ("piece", pa.binary()),
              ("anchor", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("bytes", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, bits = Anchors(length), sent.value
        for batch in slices(batches, "text", SLICE_BYTES):
            rows: list[tuple] = []
            seen: set[bytes] = set()
            for (t1, t2), (n, text) in _texts(batch).items():
                own, starts, ends = anchors.pieces(text)
                bit = own % TABLE_BITS
                passed = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                places = list(zip(own[passed].tolist(), starts[passed].tolist(), ends[passed].tolist()))
                for (anchor, a, b), digest in zip(places, _digests([text[a:b] for _, a, b in places])):
                    rows.append((t1, t2, a, digest, anchor, b - a, n, None if digest in seen else text[a:b]))
                    seen.add(digest)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(run, "t1 bigint, t2 bigint, first bigint, piece binary, anchor bigint, size int, n bigint, bytes binary")


def _spans(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that ``length`` bytes from each of the sorted places cover."""
    if not len(places):
        return places, places
    new = np.flatnonzero(np.diff(places) > length)
    return places[np.append(0, new + 1)], places[np.append(new, len(places) - 1)] + length


_FOUND = pa.schema([("piece", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                    ("anchor", pa.int64()), ("range", pa.int32()), ("digests", pa.binary()),
                    ("owners", pa.binary()), ("offsets", pa.binary())])
_FOUND_SQL = ("piece binary, starts array<int>, ends array<int>, anchor bigint, range int, digests binary, owners binary, "
              "offsets binary")


def _shard(table: pa.Table, length: int) -> pa.Table:
    """Runs that repeat within each piece of a shard; of a shared anchor's shard also the sorted windows by range."""
    pieces = table["bytes"].to_pylist()
    names, times = table["piece"].to_pylist(), np.array(table["n"].to_pylist())
    sorted_pieces = Pieces(pieces)
    twice = np.zeros(sorted_pieces.size, bool)
    twice[sorted_pieces.repeated(length)] = True
    twice[np.repeat(times > 1, sorted_pieces.ends - sorted_pieces.starts)] = True
    twice[sorted_pieces.left(np.arange(sorted_pieces.size)) < length] = False
    rows = []
    for k in np.unique(sorted_pieces.owner[twice]):
        a, b = sorted_pieces.starts[k], sorted_pieces.ends[k]
        starts, ends = _spans(np.flatnonzero(twice[a:b]), length)
        rows.append((names[k], starts.tolist(), ends.tolist(), None, None, None, None, None))
    ranges = table["ranges"][0].as_py()
    if ranges:
        windows = [(k, o) for k, p in enumerate(pieces) for o in range(len(p) - length + 1)]
        digests = np.array([hashlib.blake2b(pieces[k][o : o + length], digest_size=DIGEST).digest() for k, o in windows], f"S{DIGEST}")
        order = np.argsort(digests, kind="stable")
        of = (np.frombuffer(digests.tobytes(), ">u4")[:: DIGEST // 4][order].astype(np.int64) * ranges) >> 32
        owner, offset = np.array(windows, np.int32)[order].T
        anchor = table["anchor"][0].as_py()
        for r in range(ranges):
            a, b = np.searchsorted(of, [r, r + 1])
            if a < b:
                held = b"".join([names[k] for k in owner[a:b]])
                rows.append((None, None, None, anchor, r, digests[order[a:b]].tobytes(), held, offset[a:b].tobytes()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FOUND), _FOUND)], schema=_FOUND)


def _merge(table: pa.Table, length: int) -> pa.Table:
    """Pieces with windows of a range that occur in several shards: sorted runs are merged in pairs by binary search."""
    owners, offsets, runs, at = [], [], [], 0
    for digests, held, places in zip(*[table[c].to_pylist() for c in ("digests", "owners", "offsets")]):
        keys = np.frombuffer(digests, f"S{DIGEST}")
        owners.append(np.frombuffer(held, f"V{DIGEST}"))
        offsets.append(np.frombuffer(places, np.int32))
        runs.append((keys, np.arange(at, at + len(keys))))
        at += len(keys)
    twice = np.zeros(at, bool)
    while len(runs) > 1:
        left = [runs.pop()] if len(runs) % 2 else []
        for (a, of_a), (b, of_b) in zip(runs[::2], runs[1::2]):
            # Equal keys within a run are one string whose places the shard knows itself.
            low, high = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
            both = low < high
            twice[of_b[both]] = True
            reached = np.zeros(len(a) + 1, np.int32)
            np.add.at(reached, low[both], 1)
            np.add.at(reached, high[both], -1)
            twice[of_a[reached.cumsum()[:-1] > 0]] = True
            left.append((np.insert(a, high, b), np.insert(of_a, high, of_b)))
        runs = left
    hits: dict[bytes, list[int]] = {}
    if at:
        for owner, offset in zip(np.concatenate(owners)[twice], np.concatenate(offsets)[twice].tolist()):
            hits.setdefault(owner.tobytes(), []).append(offset)
    rows = []
    for piece, places in hits.items():
        starts, ends = _spans(np.unique(places), length)
        rows.append((piece, starts.tolist(), ends.tolist(), None, None, None, None, None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FOUND), _FOUND)], schema=_FOUND)


def repeated_runs(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``piece, starts, ends``: runs of repeated windows in the pieces, several rows for some."""
    distinct = materialise(
        pieces.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes")),
        "distinct-pieces")
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.octet_length("bytes")).alias("held"))
    rivals = materialise(shared.filter("k > 1"), "rival-anchors")
    total = rivals.agg(F.sum("held")).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    # Pieces of an anchor with no other pieces need no sorting.
    alone = distinct.filter("n > 1").join(rivals.select("anchor"), "anchor", "left_anti").select(
        "piece", F.array(F.lit(0)).alias("starts"), F.array(F.octet_length("bytes")).alias("ends"))
    parts = F.ceil(F.col("held") / (shard_bytes / 2))
    hot = parts > 1
    dealt = distinct.join(rivals, "anchor").select(
        "anchor", "piece", "n", "bytes",
        F.when(hot, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
        F.when(hot, F.pmod(F.xxhash64("piece"), parts)).otherwise(-1).cast("bigint").alias("part"),
        F.when(hot, 16 * parts).cast("bigint").alias("ranges"))

    def sort(table: pa.Table) -> pa.Table:
        return _shard(table, length)

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, length)

    found = materialise(dealt.groupBy("shard", "part").applyInArrow(sort, _FOUND_SQL), "shard-runs")
    merged = found.filter("range is not null").groupBy("anchor", "range").applyInArrow(merge, _FOUND_SQL)
    results = [found.filter("piece is not null"), merged]
    runs = alone
    for result in results:
        runs = runs.unionByName(result.select("piece", "starts", "ends"))
    return runs


def _hashes(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def remove_repeated(docs: DataFrame, text: str = "text", length: int = LENGTH, kept: str = "kept", n_bytes: str = "n_bytes",
                    n_removed: str = "n_removed", removed: str = "removed", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Adds the bytes that are left, the number of all and of the removed ones, and the removed runs (start, end)."""
    own = F.col(text).cast("binary")
    texts = docs.filter(F.octet_length(own) >= length).select(own.alias("text")).select(*_hashes("text"), "text")
    table = repeated_anchors(anchor_counts(texts, length))
    pieces = materialise(pieces_of(texts, table, length), "pieces")
    runs = materialise(repeated_runs(pieces, length, shard_bytes), "repeated-runs")
    # Equal texts lose the same bytes, so places are gathered per text, copies of it collapsing on the way.
    # Written first, so that the join below has exchanges of its own, whose large partitions Spark divides.
    places = materialise(pieces.select("t1", "t2", "first", "piece").join(runs, "piece").groupBy("t1", "t2").agg(
        F.collect_set(F.struct("first", "starts", "ends")).alias("_places")), "repeated-places")
    held = docs.drop(kept, n_bytes, n_removed, removed)
    names = held.columns
    row = held.select(F.struct(*names).alias("doc"), F.coalesce(own, F.lit(b"")).alias("text"))
    met = row.select("doc", "text", *_hashes("text")).join(places, ["t1", "t2"], "left").select("doc", "text", "_places")
    schema = T.StructType([met.schema["doc"], T.StructField(kept, T.BinaryType()), T.StructField(n_bytes, T.LongType()),
                           T.StructField(n_removed, T.LongType()),
                           T.StructField(removed, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for given, found in zip(batch.column("text").to_pylist(), batch.column("_places").to_pylist()):
                spans = joined([(p["first"] + a, p["first"] + b) for p in found or [] for a, b in zip(p["starts"], p["ends"])])
                left = [given[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(given), 0)])]
                out.append((b"".join(left), len(given), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans]))
            yield extended(batch, arrow, **dict(zip((kept, n_bytes, n_removed, removed), zip(*out))))

    result = met.mapInArrow(cut, schema)
    return result.select(*[F.col("doc").getField(c).alias(c) for c in names], kept, n_bytes, n_removed, removed)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
