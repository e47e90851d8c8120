"""Removal of lines that appear on many sites.

Every line is known by a 128-bit hash. Its spread, the number of distinct sites it appears on, is
sketched by HyperLogLog per hash; the sketches of all tasks merge by aggregation. Lines whose estimate
lies near the threshold get an exact count of distinct sites. Lines at or above the threshold leave
every document, however much of it they make up.

Defined results: a null or empty text stays as it is; blank lines always stay; a null site is a site of
its own; equal lines within a document go together; equal texts lose the same lines, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.workspace import materialise

SITES = 8
#: Sketches have 2**LOG_REGISTERS registers; lines whose estimate is within this share of the
#: threshold (over six standard errors) are counted exactly.
LOG_REGISTERS = 11
NEAR = 0.15


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def lines_of(docs: DataFrame, text: str, site: str) -> DataFrame:
    """Hash of the text, site and hash of every line that is not blank, once for each document."""
    lines = F.array_distinct(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""))
    return docs.select(
        *_text_hashes(F.col(text)), F.coalesce(F.concat(F.lit("+"), F.col(site)), F.lit("-")).alias("site"),
        # The outer form, as for the other the planner would split the text a second time to filter by.
        F.explode_outer(lines).alias("line"),
    ).filter("line is not null").select("t1", "t2", "site", *_hashes(F.col("line")))


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """``h1, h2`` of the lines on at least ``sites`` distinct sites, written to a table."""
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)))
    low, high = sites * (1 - NEAR), sites * (1 + NEAR)
    judged = materialise(
        lines.groupBy("h1", "h2").agg(estimate.alias("spread")).filter(F.col("spread") >= low), "line-spread")
    near = judged.filter((F.col("spread") <= high)).select("h1", "h2")
    exact = (
        lines.join(near, ["h1", "h2"]).select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("h1", "h2")
    )
    return materialise(judged.filter(F.col("spread") > high).select("h1", "h2").unionByName(exact), "line-drops")


def remove_lines(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """The documents without spread lines, and ``lines_removed``, which replaces a column of that name;
    other columns as they were.

    Only hashes are shuffled by line. A hot line meets its row of the small table of spread lines
    in a join whose large partitions Spark divides. The lines to remove are gathered per text, to which copies add
    nothing, and meet the texts in a join of the same kind.
    """
    lines = lines_of(docs, text, site)
    drops = spread_lines(lines, sites)
    # Written first, so that the join below has exchanges of its own, whose large partitions Spark divides.
    found = materialise(
        lines.select("t1", "t2", "h1", "h2").join(drops, ["h1", "h2"])
        .groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("found")), "found-lines")
    held = docs.select(F.struct("*").alias("doc"), F.col(text).alias("given"))
    marked = held.select("doc", "given", *_text_hashes(F.col("given"))).join(found, ["t1", "t2"], "left")
    split = F.split("given", "\n")
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains("found", F.struct(*_hashes(x)))
    # A projection of its own: below, an extra column may have the name of one used inside the filter.
    lines_left = F.when(F.col("found").isNotNull(), F.filter(split, stays))
    judged = marked.select("doc", "given", F.size(split).alias("lines"), lines_left.alias("kept"))
    removed = F.when(F.col("kept").isNotNull(), F.col("lines") - F.size("kept")).otherwise(0)
    field = F.col("doc").getField
    return judged.select(
        *[F.coalesce(F.array_join("kept", "\n"), "given").alias(c) if c == text else field(c).alias(c) for c in docs.columns if c != "lines_removed"],
        removed.cast("bigint").alias("lines_removed"),
    )
