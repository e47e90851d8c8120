"""Near-duplicates: MinHash signatures, banding, verification on full sets, connected components.

Documents with equal shingle sets form a class and are represented by their smallest id. The bands of a
signature are the buckets of a representative. In a first round every member of a bucket is paired
with the bucket's hub, the member that meets most others; pairs pass a comparison of signatures and are
then confirmed on full sets, and components form. A second round takes the members of buckets that still
hold several components and joins those of different components on their rarest shingles, which misses
no similar pair. So a large group of near copies costs one pair per member and hub, and no pair that
could still join two components is left out. Nothing is capped.

A pair with a similarity of 0.85 shares a bucket except with probability (1 - 0.85**5)**32, below
1e-8, and one of 0.8 below 1e-5; a pair that similar fails the comparison of signatures with a
probability below 1e-6.

Defined results: texts without words are linked with nothing and have an empty set; rows that share a
doc_id are one document; rows without doc_id are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import slices
from holdfast.llm.components import components
from holdfast.llm.shingles import MinHasher, Shingler, fingerprint, mix
from holdfast.workspace import materialise

WIDTH = 5
BANDS, ROWS = 32, 5
#: Pairs go on to their full sets if their signatures agree in this share less than the threshold.
SLACK = 0.2
SLICE_BYTES = 1 << 18


def signed(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``doc_id, n, fp, sig, bands`` of each row: set size, fingerprint of the set, the low bytes of the
    signature, and a hash per band; the last three are null where the set is empty."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary()),
              ("bands", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(width), MinHasher(BANDS * ROWS)
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingler.sets([t or b"" for t in batch.column("text").to_pylist()])
            full = [s for s in sets if len(s)]
            sigs, bands = [], []
            if full:
                signatures = hasher.signatures(full)
                low = (signatures >> np.uint32(8)).astype(np.uint8)
                hashed = np.broadcast_to(salt, (len(full), BANDS))
                for k in range(ROWS):
                    hashed = mix(hashed ^ signatures.reshape(len(full), BANDS, ROWS)[:, :, k].astype(np.uint64))
                sigs, bands = [row.tobytes() for row in low], hashed.view(np.int64).tolist()
            place, rows = 0, []
            for s in sets:
                rows.append((fingerprint(s), sigs[place], bands[place]) if len(s) else (None, None, None))
                place += bool(len(s))
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                       *[pa.array([r[i] for r in rows], schema.field(2 + i).type) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    given = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, n bigint, fp binary, sig binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``node, shingles`` of ``node, text`` (text as bytes)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingler.sets([t or b"" for t in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], schema=schema)

    return docs.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def agreement(one: str, two: str) -> Column:
    """Share of equal bytes of two signatures."""
    return F.expr(f"aggregate(sequence(1, {BANDS * ROWS}), 0, (n, i) -> n + "
                  f"if(substring({one}, i, 1) = substring({two}, i, 1), 1, 0)) / {BANDS * ROWS}.0D")


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose signatures do not rule out the similarity."""
    sigs = nodes.select("node", "sig")
    return (
        pairs.join(sigs.toDF("u", "sig_u"), "u").join(sigs.toDF("v", "sig_v"), "v")
        .filter(agreement("sig_u", "sig_v") >= percent / 100 - SLACK).select("u", "v")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose full sets have ``100 * intersection >= percent * union``."""
    shared = F.size(F.array_intersect("set_u", "set_v"))
    union = F.size("set_u") + F.size("set_v") - shared
    return (
        pairs.join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v")
        .filter((shared > 0) & (100 * shared.cast("bigint") >= percent * union.cast("bigint")))
        .select("u", "v")
    )


def prefix_tokens(sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """``node, part, n, rest, shingle, inner, home`` of the shingles on which sets of different parts may meet.

    With the shingles of every set in one order, rarest first, two similar sets share one among the first
    ``n - ceil(n * percent / 100) + 1`` of each, and the rest behind their first shared one is long enough for the
    overlap that they need. In the smaller set that one lies further ahead still, as half of the union is at least
    its size: there the token is ``inner``. Shingles of one part only are left out. ``home`` is whether the part holds
    the shingle most often.
    """
    tokens = sets.select("node", F.explode("shingles").alias("shingle"))
    rarity = tokens.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = tokens.join(rarity, "shingle", "left").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("all"))
    first = F.expr(f"size(all) - cast(ceil(size(all) * {percent} / 100.0D) as int) + 1")
    found = ordered.join(parts, "node").select(
        "node", "part", F.size("all").alias("n"), F.posexplode(F.slice("all", F.lit(1), first)).alias("at", "token")
    ).filter("token.df > 1").select(
        "node", "part", "n", (F.col("n") - F.col("at")).alias("rest"), F.col("token.shingle").alias("shingle"))
    found = materialise(found.withColumn("inner", (100 + percent) * F.col("rest") >= 2 * percent * F.col("n")), "prefixes")
    held = found.groupBy("shingle", "part").agg(F.count("*").alias("m"))
    homes = held.groupBy("shingle").agg(
        F.max(F.struct("m", F.col("part").alias("most"))).alias("top"), F.count("*").alias("parts")
    ).filter("parts > 1").select("shingle", F.col("top.most").alias("most"))
    return materialise(found.join(homes, "shingle").withColumn("home", F.col("part") == F.col("most")).drop("most"), "meeting-prefixes")


def meetings(tokens: DataFrame) -> list[DataFrame]:
    """The joins, on the shingle alone, that compare an inner token ``u`` with a token ``v``; together they hold every
    pair of different parts and no pair within a shingle's home part."""
    names = ("node", "part", "n", "rest")
    inner = tokens.filter("inner").select("shingle", "home", *[F.col(c).alias(f"{c}_u") for c in names])
    every = tokens.select("shingle", "home", *[F.col(c).alias(f"{c}_v") for c in names])
    return [
        inner.filter("NOT home").drop("home").join(every.drop("home"), "shingle"),
        inner.filter("home").drop("home").join(every.filter("NOT home").drop("home"), "shingle"),
    ]


def between_parts(sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``u, v`` of different parts among ``node, shingles``, without a miss."""
    one, two = meetings(prefix_tokens(sets, parts, percent))
    enough = (100 + percent) * F.least("rest_u", "rest_v") >= percent * (F.col("n_u") + F.col("n_v"))
    smaller = F.struct("n_u", "node_u") < F.struct("n_v", "node_v")
    return one.unionByName(two).filter(smaller & (F.col("part_u") != F.col("part_v")) & enough).select(
        F.greatest("node_u", "node_v").alias("u"), F.least("node_u", "node_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text",
                    width: int = WIDTH) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    rows = materialise(signed(docs, key, text, width), "minhash")
    of_class = rows.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    classes = materialise(of_class, "classes")
    leading = rows.join(classes, (rows["fp"] == classes["fp"]) & (rows["doc_id"] == classes["node"])).select(
        "node", "sig", "bands")
    buckets = leading.select("node", F.explode("bands").alias("bucket"))
    counted = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = materialise(buckets.join(counted, "bucket"), "crowded-buckets")
    # Whoever meets most others is likely the text that the others are copies of.
    central = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = crowded.join(central, "node")
    hub = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("hub"))
    shared = materialise(weighed.join(hub, "bucket").select(
        "bucket", "node", "n", (-F.col("hub.minus")).alias("hub")), "bucket-hubs")
    meeting = shared.select("node").distinct()
    texts = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text).cast("binary").alias("text"))
    # A merge join at every size: the nodes that meet grow with the documents.
    sets = materialise(shingle_sets(texts.join(meeting.hint("merge"), "node"), width), "shingle-sets")

    pairs = shared.filter("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
    links = materialise(confirmed(alike(pairs.distinct(), leading, percent), sets, percent).unionByName(
        _one_document(rows, classes)), "links")
    parts = components(links)

    placed = shared.filter("n > 2").join(parts.toDF("node", "smallest"), "node", "left").select(
        "bucket", "node", F.coalesce("smallest", "node").alias("part"))
    divided = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    open_parts = materialise(placed.join(divided, "bucket").select("node", "part").distinct(), "open-parts")
    pending = between_parts(sets.join(open_parts.select("node"), "node"), open_parts, percent)
    more = materialise(confirmed(pending, sets, percent), "more-links")
    if not more.isEmpty():
        parts = components(parts.unionByName(more))

    # A component's smallest class node is its smallest document.
    named = rows.join(classes, "fp", "left").join(parts.toDF("node", "smallest"), "node", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.coalesce("smallest", "node"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one document, which has several where rows repeat a doc_id: each with the smallest."""
    held = rows.filter("fp is not null and doc_id is not null").join(classes, "fp").select("doc_id", "node")
    least = held.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("high")).filter("v < high")
    return held.join(least, "doc_id").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
