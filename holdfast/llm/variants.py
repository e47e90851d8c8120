"""Spelling variants: words one edit apart, grouped under their most frequent form, by pivotal grams.

A word's bigrams are put in one order, rarest first. Its first ``EDITS * 2 + 1`` are its prefix; two disjoint ones
of the prefix, chosen by dynamic programming for the least total frequency, are its pivots. One edit leaves one of the
pivots whole, so of two words one edit apart, the one whose prefix ends first has a pivot in the other's prefix.
Position limits narrow the meeting: the gram stands at the same place, or is shifted by the difference in length,
and the half of the word on the other side of the edit is the same; gram, half and length are the join key.
Candidates are verified by edit distance.

Defined results: words are given once with their count; a word without near words stands alone; ties between
forms go to the smaller word in code-point order. Forms have at least ``FACTOR`` times the count of their variant, so
following them ends. Null and empty texts have no words; words shorter than ``LEAST_LENGTH`` take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import slices
from holdfast.workspace import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
EDITS, FACTOR = 1, 2
SLICE_BYTES = 1 << 21
#: Different words counted by a task before it hands them on.
HELD = 400_000
#: Gram frequencies are kept by hash in a table of this size, whatever the alphabet; any order of grams will do.
BUCKETS = 1 << 16


def word_counts(docs: DataFrame, text: str = "text", key: str | None = None, altered: Callable[[str, str], str] | None = None,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: runs of letters (A-Z in lower case) over all texts, added up within each task first.

    ``altered`` may change a run by ``key`` as text, null being empty, and the run.
    """
    given = docs.select(F.coalesce(F.col(key).cast("string") if key else F.lit(""), F.lit("")).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches, "text", SLICE_BYTES):
            for own, said in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                # Lower case of bytes is that of A-Z only.
                found = Counter(RUN.findall((said or "").encode().lower().decode()))
                for word, n in found.items():
                    if len(word) >= least_length:
                        counts[altered(own, word) if altered else word] += n
            if len(counts) > HELD:
                yield _counted(counts, least_length)
                counts.clear()
        yield _counted(counts, least_length)

    return given.filter("text is not null").mapInArrow(run, "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(counts: Counter, least: int) -> pa.RecordBatch:
    kept = [(w, n) for w, n in counts.items() if len(w) >= least]
    return pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """How often the bigrams of each hash bucket occur in the words."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    rows = words.filter(F.char_length("word") > 1).select(gram.alias("gram")).groupBy(
        (F.crc32("gram") % BUCKETS).cast("int").alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(BUCKETS, np.int64)
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table


def prefix_of(word: str, frequency: Callable[[str], int]) -> list[tuple[int, str, int]]:
    """Frequency, gram and place of the prefix grams in order; the last gram with all its places."""
    grams = sorted((frequency(word[i : i + 2]), word[i : i + 2], i) for i in range(len(word) - 1))
    size = 2 * EDITS + 1
    return grams[:size] + [g for g in grams[size:] if g[1] == grams[size - 1][1]]


def pivots_of(prefix: list[tuple[int, str, int]], number: int = EDITS + 1) -> list[tuple[int, str, int]]:
    """The ``number`` disjoint grams of least total frequency.

    ``best[i]`` holds total and choice among the first ``i`` grams by place; each round chooses one gram more.
    """
    grams = sorted(prefix, key=lambda g: g[2])
    before = [sum(other[2] <= g[2] - 2 for other in grams) for g in grams]
    best: list[tuple | None] = [(0, ())] * (len(grams) + 1)
    for _ in range(number):
        more: list[tuple | None] = [None]
        for i, gram in enumerate(grams):
            held = best[before[i]]
            options = [x for x in (more[i], held and (held[0] + gram[0], (*held[1], gram))) if x]
            more.append(min(options, default=None))
        best = more
    return list(best[-1][1]) if best[-1] else []


def indexed(words: DataFrame, table: np.ndarray) -> DataFrame:
    """``word, n, grams, last``: prefix grams with place and whether they are pivots, and the last prefix gram."""
    row = pa.struct([("gram", pa.string()), ("at", pa.int32()), ("pivot", pa.bool_())])
    end = pa.struct([("f", pa.int64()), ("gram", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def frequency(gram: str) -> int:
            if gram not in known:
                if len(known) > BUCKETS:
                    known.clear()
                known[gram] = int(table[zlib.crc32(gram.encode()) % BUCKETS])
            return known[gram]

        for batch in batches:
            grams, last = [], []
            for word in batch.column("word").to_pylist():
                prefix = prefix_of(word, frequency)
                chosen = set(pivots_of(prefix))
                grams.append([{"gram": g[1], "at": g[2], "pivot": g in chosen} for g in prefix])
                last.append({"f": prefix[-1][0], "gram": prefix[-1][1]})
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(grams, pa.list_(row)), pa.array(last, end)],
                names=["word", "n", "grams", "last"])

    return words.select("word", "n").mapInArrow(
        run, "word string, n bigint, grams array<struct<gram: string, at: int, pivot: boolean>>, last struct<f: bigint, gram: string>")


def _key(side: str, half: Column) -> Column:
    return F.xxhash64(F.col("g.gram"), F.lit(side), half, F.col("size"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``u, v, n_u, n_v`` of all words ``word, n`` one edit apart, each pair once."""
    listed = materialise(indexed(words, gram_frequencies(words)), "prefix-grams")
    length = F.char_length("word")
    each = listed.select("word", "n", "last", length.alias("len"), F.explode("grams").alias("g"))
    # ``size`` is the length of the pivot's word, which halves it; the other word is longer or shorter by one at most.
    asking = each.filter("g.pivot").withColumn("size", F.col("len"))
    asked = each.withColumn("size", F.explode(F.array(*[F.col("len") + d for d in range(-EDITS, EDITS + 1)])))

    def sides(rows: DataFrame) -> DataFrame:
        left = F.floor(F.col("size") / 2).cast("int")
        right = F.col("size") - left
        keys = F.array(_key("l", F.substr("word", F.lit(1), left)), _key("r", F.right("word", right)))
        return rows.select("word", "n", "last", "len", F.col("g.at").alias("at"), F.explode(keys).alias("key"))

    one = sides(asking).toDF("u", "n_u", "last_u", "len_u", "at_u", "key")
    two = sides(asked).toDF("v", "n_v", "last_v", "len_v", "at_v", "key")
    shift, longer = F.col("at_v") - F.col("at_u"), F.col("len_v") - F.col("len_u")
    met = one.join(two, "key").filter(
        (F.col("last_u") <= F.col("last_v")) & ((shift == 0) | (shift == longer)) & (F.levenshtein("u", "v", EDITS) == EDITS))
    swap = F.col("u") > F.col("v")
    return met.select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"),
        F.when(swap, F.col("n_v")).otherwise(F.col("n_u")).alias("n_u"),
        F.when(swap, F.col("n_u")).otherwise(F.col("n_v")).alias("n_v")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of each chain of forms, by steps that double in length."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = now.toDF("root", "next")
        stepped = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = materialise(stepped, "chains")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n``."""
    words = materialise(words.select("word", "n"), "words")
    pairs = materialise(near_pairs(words), "near-words")
    both = pairs.select("u", "v", "n_v").union(pairs.select("v", "u", "n_u")).toDF("word", "other", "n_other")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= FACTOR * F.col("n")
    judged = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
