"""Phrases whose words keep together, per language: best-first branch and bound over growing phrases.

A candidate has two or three words and occurs ``least`` times. Cutting it after its first words gives the counts of
both parts, and ``score`` is a million times the squared count over their product, for the worst cut. Candidates that
mostly occur inside a longer one are dropped; of the others the best ``most`` per language are wanted.

Counts of single words bound what a phrase can reach: it occurs no more often than its rarest word, and a part no
less often than the whole. A phrase of two words therefore scores at most the smaller of the two counts over the larger, and
one of three at most the least count over the larger of the first and the last. So the frontier is expanded best first, in
waves of falling bounds (``LEVELS``):

1. phrases whose bound lies in the wave are counted, all others are passed over;
2. the wave's phrases are scored; what that needs is counted in a second pass: the parts of three words, and every longer
   phrase around a phrase of two;
3. a language is settled as soon as ``most`` survivors reach the wave's level, as no phrase below it can score more.

The last wave has no lower bound, so a language with fewer survivors ends with all of them. Words are known in tasks by a table of
fixed size with the least and the largest count per hash cell: a shared cell loosens bounds, never results. Counts are
kept by spelling.

Defined results: a null language is ``und``; null and empty texts have no words; ties in score go to the larger count,
then to the smaller phrase in byte order; arithmetic is decimal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.batches import slices
from holdfast.workspace import materialise

UNKNOWN = "und"
LEAST, MOST, INSIDE = 10, 2000, 50
MILLION = 1_000_000
LEVELS = (250_000, 30_000, 4_000, 500, 0)
SLICE_BYTES = 1 << 21
#: Phrases counted by a task before it hands them on, and words of a language it remembers.
HELD, REMEMBERED = 300_000, 1_000_000
CELLS = 1 << 20
#: Bits of the tables of phrases wanted in the second pass (8 MB each).
BITS = 1 << 26
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_SEEN = "lang string, size int, phrase string, n bigint"


def tokens(text: str) -> list[bytes]:
    """Words in order; an empty one ends each piece."""
    out: list[bytes] = []
    for piece in text.encode().lower().translate(BREAKS).split(b"\n"):
        out += piece.split()
        out.append(b"")
    return out


class Hashes(dict):
    """Checksum of each word of a language; -1 between pieces."""

    def __init__(self, lang: str):
        super().__init__({b"": -1})
        self.seed = zlib.crc32(lang.encode() + b"\0")

    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self[b""] = -1
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Counts:
    """Counts by language and phrase, handed on as batches."""

    def __init__(self):
        self.held: dict[tuple[str, int], Counter] = {}

    def add(self, lang: str, size: int, phrases: list[bytes]) -> None:
        self.held.setdefault((lang, size), Counter()).update(phrases)

    def full(self) -> bool:
        return sum(map(len, self.held.values())) > HELD

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, size), counts in self.held.items():
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([size] * n, pa.int32()),
                 pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "size", "phrase", "n"])
        self.held.clear()


def _counted(texts: DataFrame, chosen) -> DataFrame:
    """``lang, size, phrase, n``: ``chosen`` gives, for the words of a language, sizes and lists of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = Counts(), {}
        for batch in slices(batches, "text", SLICE_BYTES):
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                of.setdefault(lang, []).extend(tokens(text))
            for lang, words in of.items():
                if lang not in known:
                    known[lang] = Hashes(lang)
                for size, phrases in chosen(known[lang], words):
                    counts.add(lang, size, phrases)
            if counts.full():
                yield from counts.batches()
        yield from counts.batches()

    return texts.select("lang", "text").mapInArrow(run, _SEEN).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` over all texts."""

    def chosen(hashes: Hashes, words: list[bytes]):
        yield 1, [w for w in words if w]

    return _counted(texts, chosen).select("lang", F.col("phrase").alias("word"), "n")


def _crc(word: Column) -> Column:
    return F.crc32(F.concat(F.col("lang"), F.lit("\0"), word))


def bounds(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest count of the frequent words per cell; the last cell, between pieces, has none."""
    rows = words.groupBy((_crc(F.col("word")) % CELLS).cast("int").alias("cell")).agg(
        F.min("n").alias("low"), F.max("n").alias("high")).toArrow()
    low, high = np.ones(CELLS + 1), np.zeros(CELLS + 1)
    low[rows["cell"].to_numpy()], high[rows["cell"].to_numpy()] = rows["low"].to_numpy(), rows["high"].to_numpy()
    return low, high


def _pairs(words: list[bytes], places: np.ndarray) -> list[bytes]:
    return [b"%b %b" % (words[i], words[i + 1]) for i in places.tolist()]


def _triples(words: list[bytes], places: np.ndarray) -> list[bytes]:
    return [b"%b %b %b" % (words[i], words[i + 1], words[i + 2]) for i in places.tolist()]


def wave(texts: DataFrame, table: tuple[np.ndarray, np.ndarray], level: float, ceiling: float) -> DataFrame:
    """Counts of the phrases whose bound is at least ``level`` and below ``ceiling``."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def chosen(hashes: Hashes, words: list[bytes]):
        low, high = sent.value
        own = hashes.of(words)
        cell = np.where(own < 0, CELLS, own % CELLS)
        low, high = low[cell], high[cell]
        least = np.minimum(high[:-1], high[1:])
        # The added thousandth covers the rounding of the division.
        bound = MILLION * np.minimum(least / np.maximum(low[:-1], low[1:]), 1) + 0.001
        yield 2, _pairs(words, np.flatnonzero((least > 0) & (bound >= level) & (bound < ceiling)))
        least = np.minimum(least[:-1], high[2:])
        bound = MILLION * np.minimum(least / np.maximum(low[:-2], low[2:]), 1) + 0.001
        yield 3, _triples(words, np.flatnonzero((least > 0) & (bound >= level) & (bound < ceiling)))

    return _counted(texts, chosen)


def _bit(one, two):
    return (one * 40503 + two * 60493) % BITS


def bit_table(pairs: DataFrame) -> np.ndarray:
    """One bit per hash of the pairs ``lang, u, v``; its size does not depend on their number."""
    bit = _bit(_crc(F.col("u")), _crc(F.col("v")))
    rows = pairs.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def around(texts: DataFrame, parts: np.ndarray, inner: np.ndarray) -> DataFrame:
    """Counts of the pairs in ``parts``, and of all phrases of three words around a pair in ``inner``."""
    sent = texts.sparkSession.sparkContext.broadcast((parts, inner))

    def chosen(hashes: Hashes, words: list[bytes]):
        parts, inner = sent.value
        own = hashes.of(words)
        whole = (own[:-1] >= 0) & (own[1:] >= 0)
        bit = _bit(own[:-1], own[1:])
        at, shift = bit >> 3, (bit & 7).astype(np.uint8)
        yield 2, _pairs(words, np.flatnonzero(whole & ((parts[at] >> shift & 1) > 0)))
        held = whole & ((inner[at] >> shift & 1) > 0)
        yield 3, _triples(words, np.flatnonzero(whole[:-1] & whole[1:] & (held[:-1] | held[1:])))

    return _counted(texts, chosen)


def _score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in decimals of 38 digits."""
    return F.expr(f"(cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * {MILLION}BD) div "
                  f"(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def _spelled(phrases: DataFrame) -> DataFrame:
    """Adds the words ``u, v`` and ``w`` of each phrase."""
    words = F.split("phrase", " ")
    return phrases.withColumns({"u": words[0], "v": words[1], "w": F.get(words, 2)})


def _with_counts(phrases: DataFrame, words: DataFrame, first: str, last: str) -> DataFrame:
    """Adds the counts of the first and the last word."""
    return phrases.join(words.toDF("lang", first, "n_first"), ["lang", first]).join(words.toDF("lang", last, "n_last"), ["lang", last])


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most: int = MOST,
         inside: int = INSIDE, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``most`` phrases of each language."""
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).filter("text <> ''")
    counted = materialise(word_counts(given), "words")
    totals = materialise(counted.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    words = materialise(counted.filter(F.col("n") >= least), "frequent-words")
    table = bounds(words)
    waiting = totals.select("lang")
    pairs = triples = scored = results = None
    ceiling = float("inf")

    def joined(one: DataFrame | None, two: DataFrame) -> DataFrame:
        """What has been found, for the languages that are not settled."""
        return (one.unionByName(two) if one is not None else two).join(waiting, "lang", "left_semi")

    for level in levels:
        texts = given.join(waiting, "lang", "left_semi")
        found = materialise(wave(texts, table, level, ceiling).filter(F.col("n") >= least).withColumnRenamed("n", "a"), "phrases")
        two = _with_counts(_spelled(found.filter("size = 2")), words, "u", "v").select(
            "lang", "phrase", "u", "v", "a", F.col("n_first").alias("l"), F.col("n_last").alias("r"), _score("a", "n_first", "n_last").alias("score"))
        three = _with_counts(_spelled(found.filter("size = 3")), words, "u", "w").select(
            "lang", "phrase", "u", "v", "w", "a", "n_first", "n_last",
            F.least(_score("a", "n_first", "a"), _score("a", "n_last", "a")).alias("reach"))
        pairs = materialise(joined(pairs, two), "pairs")
        triples = materialise(joined(triples, three), "triples")
        now_two = pairs.filter(F.col("score").between(level, min(ceiling, 2 * MILLION) - 1))
        now_three = triples.filter(F.col("reach").between(level, min(ceiling, 2 * MILLION) - 1))
        parts = now_three.select("lang", "u", "v").union(now_three.select("lang", "v", "w"))
        more = materialise(around(texts, bit_table(parts), bit_table(now_two)), "around")

        part = more.filter("size = 2").select("lang", "phrase", "n")
        split = now_three.withColumns({"uv": F.concat_ws(" ", "u", "v"), "vw": F.concat_ws(" ", "v", "w")})
        split = split.join(part.toDF("lang", "uv", "n_uv"), ["lang", "uv"]).join(part.toDF("lang", "vw", "n_vw"), ["lang", "vw"])
        split = split.withColumns({"one": _score("a", "n_first", "n_vw"), "two": _score("a", "n_uv", "n_last")})
        first = F.col("one") <= F.col("two")
        threes = split.select("lang", "phrase", "a", F.when(first, F.col("n_first")).otherwise(F.col("n_uv")).alias("l"),
                              F.when(first, F.col("n_vw")).otherwise(F.col("n_last")).alias("r"), F.least("one", "two").alias("score"))
        longer = _spelled(more.filter((F.col("size") == 3) & (F.col("n") >= least)))
        longer = longer.select("lang", F.explode(F.array(F.concat_ws(" ", "u", "v"), F.concat_ws(" ", "v", "w"))).alias("phrase"), "n")
        widest = longer.groupBy("lang", "phrase").agg(F.max("n").alias("n_longer"))
        twos = now_two.join(widest, ["lang", "phrase"], "left").filter(
            F.coalesce(100 * F.col("n_longer") < inside * F.col("a"), F.lit(True))).select(threes.columns)
        scored = materialise(joined(scored, threes.unionByName(twos)), "scored")

        reached = scored.filter(F.col("score") >= level)
        sizes = reached.groupBy("lang").agg(F.count("*").alias("k"))
        last = level == levels[-1]
        settled = waiting if last else materialise(sizes.filter(F.col("k") >= most).select("lang"), "settled")
        done = reached.join(settled, "lang", "left_semi")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = materialise(done.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most), "best-phrases")
        results = best if results is None else results.unionByName(best)
        if not last:
            waiting = materialise(waiting.join(settled, "lang", "left_anti"), "open-languages")
            if waiting.isEmpty():
                break
        ceiling = level
    return results.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
