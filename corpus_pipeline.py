"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes the documents its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents; the last adds the token ids. Rows that share a doc_id or have none are
treated as the operators in ``holdfast/llm`` say.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontamination, languages, linededup, neardup, sentencepieces
from holdfast.llm.batches import short_batches
from holdfast.llm.queries import table, tokenizer_path
from holdfast.workspace import materialise

#: Similarity in percent at which documents count as near-duplicates.
SIMILAR = 80


def nested(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one structure beside the named columns, so that no other column can clash with those of a stage."""
    return docs.select(F.struct("*").alias("doc"), *columns)


def flat(rows: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of documents again, some of them replaced."""
    field = F.col("doc").getField
    return rows.select(*[replaced.get(c, field(c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and texts that the network holds to be in no learned language.

    The others keep the language they were given; those without one get the one that the network finds. Where
    nothing can be learned, as without any given language, all texts with a letter stay as they are.
    """
    network = languages.train(docs, other=True)
    if network is None:
        return docs.filter(F.rlike("text", F.lit(r"\p{L}")))
    found = languages.identify(nested(docs, "text", "lang"), network, into="found", score="score")
    return flat(found.filter(F.col("found") != languages.UNKNOWN), docs, lang=F.coalesce("lang", "found"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; the number of characters follows the text."""
    cleaned = linededup.remove_lines(nested(docs, "text", "source"))
    return flat(cleaned, docs, text=F.col("text"), n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without id all stay. Ids are whole numbers.

    Rows with equal doc_id and text are one document. Other texts of the same doc_id are documents of their own,
    known by 64 bits of hash where the id is reused.
    """
    texts = docs.filter("doc_id is not null").select("doc_id", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("h"))
    reused = materialise(
        texts.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high")
        .select(F.col("doc_id").alias("reused")), "reused-ids")
    rows = nested(docs, "doc_id", "text")
    nodes = rows.join(reused, rows["doc_id"] == reused["reused"], "left").withColumn(
        "node", F.when(F.col("reused").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    found = materialise(neardup.near_duplicates(nodes, percent=SIMILAR, key="node").select(
        F.col("doc_id").alias("node"), "component_id"), "groups")
    # Hashes have no order of ids, so groups with texts of reused ids look up their smallest id.
    hashed = materialise(nodes.filter("reused is not null").select("node", "doc_id").distinct(), "reused-texts")
    mixed = found.join(found.join(hashed, "node").select("component_id").distinct(), "component_id", "left_semi")
    keepers = materialise(
        mixed.join(hashed, "node", "left").groupBy("component_id")
        .agg(F.min(F.struct(F.coalesce("doc_id", "node").alias("id"), "node"))["node"].alias("keeper")), "keepers")
    drops = materialise(
        found.join(keepers, "component_id", "left").filter(F.col("node") != F.coalesce("keeper", "component_id"))
        .select(F.col("node").alias("dropped")).distinct(), "dropped")
    kept = nodes.join(drops, nodes["node"] == drops["dropped"], "left_anti")
    named = kept.filter("node is not null").dropDuplicates(["node"])
    return flat(named.unionByName(kept.filter("node is null")), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Texts are judged, whatever their id: another text of the same id, or of
    none, stays."""
    unit = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    found = decontamination.contained(docs.select(unit.alias("unit"), "text"), table(spark, sf_dir, "benchmark"), key="unit")
    leaks = materialise(found.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    rows = nested(docs, "text").withColumn("unit", unit)
    return flat(rows.join(leaks, rows["unit"] == leaks["leak"], "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids with begin and end, their number, and whether they decode to the text.

    The ids are written before they are decoded: a task that does both has two Python processes, each with a model.
    """
    model = tokenizer_path()
    with short_batches(spark):
        encoded = materialise(sentencepieces.encode(docs, model), "encoded")
    both = sentencepieces.decode(encoded, model)
    return both.withColumns({
        "n_tokens": sentencepieces.token_count("ids"),
        "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
    }).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: No SQL: the first and the last stage cannot be expressed. Tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with short_batches(spark) if stage is encode else nullcontext():
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
