"""Secret scans over every version of every path, each distinct text scanned once per rule version.

A version's content address is the SHA-256 of its text. The ledger is a Parquet folder with one row
per scan of a blob: which rule versions ran and what they found. A run looks up which blob and
rule-version pairs are new, scans those only, appends to the ledger and joins the findings back to
all paths. Appending is one committed Spark job, so a lost executor leaves no half-written scan; a
repeated append does no harm.

Defined results: a null text counts as empty; several rows of one path are its versions, each with
its own findings; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import slices, texts
from holdfast.workspace import materialise

SLICE_BYTES = 4 << 20
LEDGER = ("blob binary, rules array<string>, "
          "findings array<struct<rule:string,start:bigint,end:bigint>>")


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its ``group`` has ``least`` characters. Texts without any of
    ``hints`` (compared in lower case) cannot match and are passed over."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the base kinds, in their order; the kinds after them are additions.
BASE = (
    Rule("assign", 1,
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    # A run of 16 or more is the same match as a whole run with at least 16 characters.
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("bearer", 1, r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]+=*)", 1, 20, ("bearer",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1, ("eyj",)),
)
RULES = BASE + ADDED


def _scanner(rules: tuple[Rule, ...]):
    compiled = {r.name: (re.compile(r.pattern, re.ASCII), r) for r in rules}

    def find(text: str, names: list[str]) -> list[dict]:
        found, lower = [], text.lower()
        for name in names:
            pattern, rule = compiled[name]
            if rule.hints and not any(hint in lower for hint in rule.hints):
                continue
            found += [{"rule": name, "start": m.start(), "end": m.end()}
                      for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
        return found

    return find


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blob, text, rules``: the named rules over each text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(LEDGER)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _scanner(rules)
        for batch in slices(batches, "text", SLICE_BYTES):
            names = batch.column("rules").to_pylist()
            found = [find(t, n) for t, n in zip(texts(batch, "text"), names)]
            yield pa.RecordBatch.from_arrays([
                batch.column("blob").cast(arrow.field(0).type), pa.array(names, arrow.field(1).type),
                pa.array(found, arrow.field(2).type)], schema=arrow)

    return blobs.select("blob", "text", "rules").mapInArrow(run, schema)


def read_ledger(spark, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the unseen pairs of ``versions`` (``blob, text``) and appends them to the ledger.

    Copies of a text meet before the shuffle, so a text with very many copies is one row per task.
    """
    spark = versions.sparkSession
    current = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    known = read_ledger(spark, ledger)
    if known is None:
        todo = blobs.withColumn("rules", current)
    else:
        ran = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("ran"))
        unseen = F.array_except(current, F.coalesce("ran", F.array().cast("array<string>")))
        todo = blobs.join(ran, "blob", "left").withColumn("rules", unseen).filter(F.size("rules") > 0)
    scan_blobs(todo, rules).write.mode("append").parquet(ledger)


def scan(df: DataFrame, ledger: str, key: str = "doc_id", text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version of a path: its key, ``blob`` and ``findings``, an array of ``start``,
    ``place`` of the kind among the rules, ``kind`` and ``end``, in that order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    versions = df.select(F.col(key), whole.alias("text"), F.unhex(F.sha2(whole, 256)).alias("blob"))
    paths = materialise(versions.select(F.col(key).alias("path"), "blob"), "secret-paths")
    update_ledger(versions.select("blob", "text"), ledger, rules)
    places = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    hits = (
        read_ledger(df.sparkSession, ledger)
        .select("blob", F.explode("findings").alias("hit"))
        .filter(F.col("hit.rule").isin([r.name for r in rules]))
        .select("blob", F.struct(
            F.col("hit.start").alias("start"), places[F.col("hit.rule")].alias("place"),
            kinds[F.col("hit.rule")].alias("kind"), F.col("hit.end").alias("end")).alias("hit"))
        .groupBy("blob").agg(F.sort_array(F.collect_set("hit")).alias("findings"))
    )
    none = F.array().cast(hits.schema["findings"].dataType)
    return paths.join(hits, "blob", "left").select(
        F.col("path").alias(key), "blob", F.coalesce("findings", none).alias("findings"))


def spans(findings: Column) -> Column:
    """``kind:start:end`` of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
