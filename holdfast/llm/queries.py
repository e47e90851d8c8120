"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import chat, decontamination, languages, linededup, neardup, phrases, quality, secrets, sentencepieces, sharding, substrings, variants, vectorsearch
from holdfast.llm.oracles import ORACLES
from holdfast.workspace import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_path()
    both = sentencepieces.decode(sentencepieces.encode(docs, model).drop("text"), model)
    return both.select(
        "doc_id",
        sentencepieces.token_count("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        "ids_agree",
    )


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = linededup.remove_lines(docs)
    return cleaned.select(
        "doc_id", "lines_removed", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts().alias("parts")))
    back = chat.read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("under_loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of its own, so that every run scans every text of the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, new_path(spark, "secret-ledger"))
    base = F.filter("findings", lambda f: f["place"] < len(secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(rule.kind) for rule in secrets.BASE], F.sha2(secrets.spans(base), 256).alias("base_sha256"),
        secrets.spans(F.col("findings")).alias("spans"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contained(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_vectorsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectorsearch.top_k(vectors, F.col("vec_id") % 20 == 0)


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = languages.train(docs)
    return languages.identify(docs.select("doc_id", "text"), network).select(
        "doc_id", languages.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeated(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def mistyped(doc_id: str, run: str) -> str:
    """The run, in one of 97 documents without a letter: made misspellings."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % 97 == 0 else run


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.group_variants(variants.word_counts(docs, key="doc_id", altered=mistyped))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_linededup": op2_linededup,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_neardup": op6_neardup,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_vectorsearch": op9_vectorsearch,
    "op10_languages": op10_languages,
    "op11_suffixdedup": op11_suffixdedup,
    "op12_spellings": op12_spellings,
    "op13_collocations": op13_collocations,
}
