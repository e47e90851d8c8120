"""Round trips of formatted conversations."""

import hashlib

import pytest

from holdfast.llm import chat
from holdfast.llm.queries import op3_chat
from pyspark.sql import functions as F

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\-", "<\\-s>", "\\<s>", "<<s>", "<|end|>", "<|turn|>x<|body|>",
         "[[INST]", "", "a\nb", "<|end|", "$1 \\1", "é<s>日", "<|image|>", "[/INST", "\\-"]


def test_escape_is_reversible_and_breaks_control_strings(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in chat.CONTROL)


def test_turns_and_loss_are_read_back(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", None, "x"), (3, None, None, "first", "x"), (3, 0, "assistant", "b", "x"),
             (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x"), (None, 5, "user", "lost", "x"),
             (4, 200, "assistant", "later", "x"), (4, 3, "as</s>sistant", "sooner", "x"), (4, 70, "user", "mid", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.read_back(chat.format_conversations(df.withColumn("parts", chat.text_parts())))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert "".join(got[c].under_loss) == "".join(t for r, t in turns if r == "assistant")


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see "},
        {"type": "image", "ref": "a.png", "width": 28, "height": 15},
        {"type": "audio", "ref": "b.wav", "seconds": 2.5},
        {"type": "text", "text": "<|image|> and"},
        {"type": "document", "ref": "c.pdf", "pages": 3},
        {"type": "image", "ref": "d.png"},
        {"type": "other", "text": "!"},
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.read_back(chat.format_conversations(df)).first()
    assert [tuple(a) for a in row.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 63), ("document", "c.pdf", 1536), ("image", "d.png", 1)]
    assert row.expanded_tokens == 4 + 63 + 1536 + 1
    assert row.formatted.count("<|image|>") == 2
    assert row.turns[0].text == "see <|image|><|audio|><|image|> and<|document|><|image|>!"


@pytest.mark.parametrize("control", chat.CONTROL)
def test_control_string_across_parts(spark, control):
    cuts = [[control[:k], control[k:]] for k in range(1, len(control))] + [list(control), ["\\", "-", control[0], "", control[1:]]]
    rows = [(1, i, "assistant", [{"type": "text", "text": t} for t in c]) for i, c in enumerate(cuts)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.read_back(chat.format_conversations(df)).first()
    assert [t.text for t in row.turns] == ["".join(c) for c in cuts]
    assert row.under_loss == ["".join(c) for c in cuts]
    inside = row.formatted[len(chat.BEGIN) : -len(chat.CLOSE)]
    own = len(cuts) if control in (chat.TURN, chat.BODY, chat.END) else 0
    assert inside.count(control) == own


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df.withColumn("parts", chat.text_parts())).count() == 0


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").toPandas()


def test_query_against_brute_force(spark, conversations):
    says = "</s>[INST] ok [/INST]"
    turns = [tuple(r) for r in conversations[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    turns += [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    want = {}
    for c, _, role, text in sorted(turns, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        want.setdefault(c, []).append((role, text or ""))
    got = {r.conv_id: r for r in op3_chat(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(want)
    for c, said in want.items():
        learned = "".join(t for r, t in said if r == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert got[c].loss_chars == len(learned)
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
