"""Exact stratified split without shuffling the rows.

Rows of a class are ordered by a hash of seed and id, and the first ones form the test part. To
know where that order is cut, only counts per hash prefix are needed: each round counts prefixes
four digits longer inside the prefix that holds the cut. The split itself is then a comparison of
each row's hash with its class's cut, a narrow expression that works on streams as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import ID, SPLIT_SEED, TARGET, TEST_SHARE

STEP = 4
HASH_DIGITS = 32


@dataclass(frozen=True)
class SplitRule:
    """Per class, the hash prefix up to which rows are test rows."""

    seed: int
    cuts: dict[int, str]


def row_hash(seed: int) -> str:
    """Hash of seed and id as 32 hexadecimal digits."""
    return f"md5(concat('{seed}', ':', CAST({ID} AS STRING)))"


def test_sizes(counts: dict[int, int], share: float) -> dict[int, int]:
    """Test rows per class: ⌈share·n⌉ in all, divided by largest remainder, ties to the smaller class."""
    total = sum(counts.values())
    # A share such as 0.2 is not exact in binary; rounding first keeps 0.2·15 at 3.
    wanted = math.ceil(round(share * total, 9))
    exact = {c: wanted * n / total for c, n in counts.items()}
    sizes = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (sizes[c] - exact[c], c))
    for c in by_remainder[: wanted - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def fit_split(
    df: DataFrame, share: float = TEST_SHARE, seed: int = SPLIT_SEED, step: int = STEP
) -> SplitRule:
    """Where to cut each class. Ids must be unique, as they are after de-duplication."""
    keyed = df.selectExpr(f"{TARGET} AS class", f"{row_hash(seed)} AS hash").where(
        "class IS NOT NULL"
    )
    classes = keyed.groupBy("class").count().collect()
    left = test_sizes({row["class"]: row["count"] for row in classes}, share) if classes else {}

    cuts, prefix = {}, {c: "" for c, n in left.items() if n}
    for digits in range(step, HASH_DIGITS + step, step):
        if not prefix:
            break
        inside = " OR ".join(
            f"(class = {c} AND startswith(hash, '{start}'))" for c, start in prefix.items()
        )
        goal = "CASE class " + " ".join(f"WHEN {c} THEN {left[c]}L" for c in prefix) + " END"
        # At most 16^step rows per class.
        upto = Window.partitionBy("class").orderBy("start")
        found = (
            keyed.where(inside)
            .groupBy("class", F.expr(f"substring(hash, 1, {digits})").alias("start"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(upto))
            .where(f"upto >= {goal} AND upto - n < {goal}")
            .collect()
        )
        for row in found:
            c, need = row["class"], left[row["class"]] - (row["upto"] - row["n"])
            if need == row["n"] or digits >= HASH_DIGITS:
                cuts[c] = row["start"]
                del prefix[c]
            else:
                prefix[c], left[c] = row["start"], need
    return SplitRule(seed, cuts)


def stratified_split(df: DataFrame, rule: SplitRule | None = None) -> DataFrame:
    """Add ``split``: ``test`` up to the cut of the row's class, else ``train``."""
    rule = rule or fit_split(df)
    hashed = row_hash(rule.seed)
    tests = " ".join(
        f"WHEN {TARGET} = {c} AND substring({hashed}, 1, {len(cut)}) <= '{cut}' THEN 'test'"
        for c, cut in rule.cuts.items()
    )
    return df.withColumn("split", F.expr(f"CASE {tests} ELSE 'train' END" if tests else "'train'"))
