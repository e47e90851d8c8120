"""Conversations as one text each, with a loss mask, in DataFrame functions only.

A turn's content is a list of typed parts. A visitor flattens them in order: text is escaped, image,
audio and document parts become placeholders and leave a record of their reference and the number
of tokens the placeholder stands for. The template is

    <s> <|turn|>role<|body|>content<|end|> ... </s>

without the blanks. Control strings inside texts are broken up reversibly: a backslash is doubled,
and ``\\-`` goes between the first character of a control string and the rest.

Defined results: null role or text counts as empty; parts of unknown type count as text; turns are
ordered by turn (null first), then role, then content, and repeated turns stay; a missing size of an
attachment counts as one unit. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, TURN, BODY, END, CLOSE = "<s>", "<|turn|>", "<|body|>", "<|end|>", "</s>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (BEGIN, CLOSE, "[INST]", "[/INST]", TURN, BODY, END, *PLACEHOLDERS.values())
#: Tokens per image patch side in pixels, per second of audio, per page of a document.
EXPANSION = {"patch": 14, "per_second": 25, "per_page": 512}
#: Turns are put together in blocks of so many before a conversation is, so that one very long
#: conversation is sorted and joined in many tasks.
BLOCK = 64
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

_FIRST = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_BEGUN = "|".join(sorted({re.escape(c[1:k]) for c in CONTROL for k in range(1, len(c))}))
_OPENING = f"([{_FIRST}])(?={_REST})"
_OPENING_OR_BEGUN = f"([{_FIRST}])(?={_REST}|(?:{_BEGUN})\\z)"


def escape(text: Column, opening: str = _OPENING) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, opening, r"$1\\-")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:-|(\\))", "$1")


def text_parts(text: str = "text") -> Column:
    """A list with one text part."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.col(text).alias("text"), none.cast("string").alias("ref"),
        none.cast("int").alias("width"), none.cast("int").alias("height"),
        none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
    ))


def _visit(part: Column, at: Column) -> Column:
    """A part's text or placeholder. A control string that the text ends in the middle of is broken up
    as well if a part follows, which could complete it."""
    whole = F.coalesce(part["text"], F.lit(""))
    flat = F.when(at < F.size("parts") - 1, escape(whole, _OPENING_OR_BEGUN)).otherwise(escape(whole))
    for kind, placeholder in PLACEHOLDERS.items():
        flat = F.when(part["type"] == kind, F.lit(placeholder)).otherwise(flat)
    return flat


def _tokens(part: Column, expansion: Mapping[str, int]) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(1)) / expansion["patch"])
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * expansion["per_second"]))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * expansion["per_page"])
        .cast("bigint")
    )


def format_conversations(turns: DataFrame, parts: str = "parts", trained: str = "assistant",
                         expansion: Mapping[str, int] = EXPANSION) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, parts``.

    ``formatted``: the text. ``loss``: for each turn where the text under the loss mask begins within
    the turn and its length, both in characters; the turn begins behind its ``<|turn|>``. ``attachments``:
    kind, reference and token count of each placeholder in order. ``expanded_tokens``: their sum.
    """
    whole = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    attached = F.transform(
        F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS)),
        lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p, expansion).alias("tokens")),
    )
    visited = whole.select(
        "conv_id", "turn", (F.floor(F.col("turn") / BLOCK)).alias("block"), "role",
        F.array_join(F.transform("parts", _visit), "").alias("content"), attached.alias("attached"),
    ).select(
        "conv_id", "block",
        F.struct("turn", "role", "content", "attached").alias("said"),
    )
    said = F.sort_array(F.collect_list("said"))
    blocks = visited.groupBy("conv_id", "block").agg(said.alias("said")).select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(F.transform("said", lambda s: F.concat(
                F.lit(TURN), escape(s["role"]), F.lit(BODY), s["content"], F.lit(END))), "").alias("formatted"),
            F.transform("said", lambda s: F.struct(
                (F.length(escape(s["role"])) + len(BODY)).cast("bigint").alias("start"),
                F.when(s["role"] == trained, F.length(s["content"])).otherwise(0).cast("bigint").alias("length"),
            )).alias("loss"),
            F.flatten(F.transform("said", lambda s: s["attached"])).alias("attachments"),
        ).alias("piece"),
    )
    pieces = F.sort_array(F.collect_list("piece"))
    joined = blocks.groupBy("conv_id").agg(pieces.alias("pieces"))
    return joined.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join("pieces.formatted", ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten("pieces.loss").alias("loss"),
        F.flatten("pieces.attachments").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text itself tells: ``turns`` (role and text) and ``under_loss``, the
    texts under the loss mask; all unescaped, placeholders left as they are."""
    said = F.slice(F.split("formatted", re.escape(TURN), -1), 2, 1 << 30)
    body = lambda s: F.split(s, re.escape(BODY), 2)
    return formatted.withColumn("said", said).withColumns({
        "turns": F.transform("said", lambda s: F.struct(
            unescape(F.get(body(s), F.lit(0))).alias("role"),
            unescape(F.substring_index(F.get(body(s), F.lit(1)), END, 1)).alias("text"),
        )),
        "under_loss": F.transform(
            F.filter(F.arrays_zip("said", "loss"), lambda z: z["loss"]["length"] > 0),
            lambda z: unescape(F.substring(
                z["said"], (z["loss"]["start"] + 1).cast("int"), z["loss"]["length"].cast("int"))),
        ),
    }).drop("said")
