"""Reading learner tables and stored results."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import ID, MISSING_TOKENS, SOURCE_COLUMNS
from holdfast.functions.numbers import quoted, sql_text
from holdfast.workspace import materialise

RAW_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType())] + [T.StructField(c, T.StringType()) for c in SOURCE_COLUMNS]
)


_MISSING = ", ".join(sql_text(t) for t in MISSING_TOKENS)


def _missing_as_null(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.expr(f"CASE WHEN {quoted(c)} NOT IN ({_MISSING}) THEN {quoted(c)} END")
        for c, kind in df.dtypes if kind == "string"
    })


def _with_id(table: DataFrame) -> DataFrame:
    """The id as a number; where there is none, a hash of the other columns in the order of their names."""
    content = F.xxhash64(*[quoted(c) for c in sorted(table.columns) if c != ID])
    if ID not in table.columns:
        return table.select(content.alias(ID), "*")
    return table.withColumn(ID, F.col(ID).cast("bigint"))


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header to a table of text columns, the usual missing-value marks as null.

    Nothing is inferred from the data. Without an id column the id is a hash of the row's
    content, so it is the same on every read and copies of a row share it. All files of a folder have
    one header; a file with another one is an error, not a table with values under wrong names. A
    path that does not exist is an error.
    """
    table = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return _with_id(_missing_as_null(table.toDF(*[c.strip() for c in table.columns])))


def _headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, header``: the first line of each file that is not blank, written to a table."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0 AND trim(value) <> ''").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return materialise(first, "headers")


def _names(header: str) -> list[str]:
    return [c.strip() or f"_c{i}" for i, c in enumerate(next(csv.reader([header.removeprefix("\ufeff")])))]


def load_upload(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded CSV files, one file or a folder of them, for scoring: :func:`load_raw` for files whose
    columns differ in order or number.

    Columns go by the header of their own file; those that only other files have are null. Rows of a
    file without id get the hash of their content. Files that share a header are read together, so the
    folder is scanned once for the headers and once for each different one.
    """
    headers = _headers(spark, path)
    different = [r["header"] for r in headers.select("header").distinct().orderBy("header").collect()]
    if not different:
        raise ValueError(f"no header in {path}")
    tables = []
    for header in different:
        names = _names(header)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        rows = spark.read.schema(schema).option("header", True).csv(path)
        files = headers.where(F.col("header") == header).select(F.col("file").alias("_of"))
        own = rows.select("*", F.col("_metadata.file_path").alias("_file"))
        own = own.join(files, F.col("_file") == F.col("_of"), "left_semi").drop("_file")
        tables.append(_with_id(_missing_as_null(own)))
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), tables)


def stream_uploads(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same files as a stream.

    Files must have the id and the source columns in their order; one with another header is an
    error, not a table with values under wrong names.
    """
    stream = (
        spark.readStream.schema(RAW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
    )
    return _missing_as_null(stream)


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """``path`` of arriving files as a stream; their content is not read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return stream.load(path).select("path")


REJECTED = "file string, reason string, record string"
#: Columns that reading adds for a while; a file that names one of them is refused.
_ADDED = ("_unread", "_file", "_reason")


def _plain(path: str) -> str:
    """A path in the one spelling that file streams use."""
    return re.sub("^file:/+", "file:/", path)


def _refusal(names: list[str], needed: Sequence[Sequence[str]]) -> str | None:
    """Why a file with these columns cannot be read, if so."""
    if not names:
        return "no header"
    taken = [c.lower() for c in (*names, *_ADDED)]
    if len(set(taken)) < len(taken):
        return "a column name is used twice"
    absent = [spellings[-1] for spellings in needed if not set(spellings) & set(names)]
    return f"no column {', '.join(absent)}" if absent else None


def read_files(
    spark: SparkSession, files: Sequence[str], needed: Sequence[Sequence[str]] = ()
) -> tuple[list[DataFrame], DataFrame]:
    """Rows of the named CSV files, a written table for each different header, and ``file, reason, record`` of what
    cannot be read.

    A file is left out as a whole if it has no header, names a column twice or lacks a column of ``needed`` (each
    with its spellings); its ``record`` is the header. A row is left out if it has more or fewer cells than the header, or an id that is no
    number. The files of one header are read together, once and as paths. The driver sees one line per file, so
    the files should be those of one batch of a stream.
    """
    headers = {}
    if files:
        # Names of files are no patterns.
        literal = {f: re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in files}
        headers = {_plain(unquote(r["file"])): r["header"] for r in _headers(spark, list(literal.values())).collect()}
    refused, by_header = [], {}
    for f in files:
        header = headers.get(_plain(f))
        reason = _refusal(_names(header) if header else [], needed)
        if reason:
            refused.append((_plain(f), reason, header))
        else:
            by_header.setdefault(header, []).append(literal[f])
    rejected = spark.createDataFrame(refused, REJECTED)
    tables = []
    for header, paths in sorted(by_header.items()):
        names = _names(header)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, "_unread")])
        rows = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_unread").csv(paths)
        no_number = f"{ID} NOT IN ({_MISSING}) AND try_cast({ID} AS BIGINT) IS NULL" if ID in names else "false"
        read = materialise(rows.withColumns({
            "_file": F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"),
            "_reason": F.expr(f"CASE WHEN _unread IS NOT NULL THEN 'cells do not fit the header' WHEN {no_number} THEN 'the id is no number' END"),
        }), "upload")
        cells = F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("")) for c in names])
        rejected = rejected.unionByName(read.where("_reason IS NOT NULL").select(
            F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.coalesce("_unread", cells).alias("record")))
        tables.append(_with_id(_missing_as_null(read.where("_reason IS NULL").select(*map(quoted, names)))))
    return tables, rejected


def load_ml_datasets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; each reads only its own partition."""
    table = spark.read.parquet(path)
    return tuple(
        table.where(F.col("split") == part).drop("split") for part in ("train", "test")
    )
