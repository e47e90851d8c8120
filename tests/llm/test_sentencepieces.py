"""Ids and texts against the sentencepiece library on whole texts."""

import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from holdfast.llm import sentencepieces
from holdfast.llm.sentencepieces import Agenda

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  a  b ", "a▁b", "\n", "\n\n  \n", "a\nb", "</s>[INST] ok <s>", "\x00x", "ﬁ Ａ", "\t",
       "\r\n", "😀​", "x" * 5000, " " * 3000, "▁▁▁ \n▁", "日本語のテキスト ë", "é é", "<0x41>", "ab" * 20000]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def agenda(library):
    return Agenda(library)


def whole(library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    return struct.pack(f"<{len(ids)}I", *ids)


def test_odd_texts(library, agenda):
    ids, agree = agenda.encode(ODD)
    assert all(agree)
    assert ids == [whole(library, text) for text in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("  ▁ab.,\n\tthe ingéßñ日😀\x00"), max_size=60))
def test_any_text(text):
    library = SentencePieceProcessor(model_file=MODEL)
    ids, agree = test_any_text.agenda.encode([text])
    assert agree == [True] and ids == [whole(library, text)]


test_any_text.agenda = Agenda(SentencePieceProcessor(model_file=MODEL))


def test_single_and_joint_merging_agree(agenda):
    cuts = ["▁thing", "▁▁▁x", "ation", "▁a", "b", "▁internationalisation"]
    assert agenda.merge_all(cuts) == [agenda.merge(cut) for cut in cuts]


def test_table(spark, library):
    rows = [(i, text, "kept") for i, text in enumerate([None, *ODD])] + [(1, "", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepieces.decode(sentencepieces.encode(df, MODEL), MODEL).collect()
    assert len(out) == len(rows)
    for row in out:
        assert row.ids_agree
        assert bytes(row.ids) == whole(library, row.text or "")
        assert row.decoded == library.decode(library.encode(row.text or ""))
    empty = sentencepieces.decode(sentencepieces.encode(df.limit(0), MODEL), MODEL)
    assert empty.count() == 0


def test_ids_are_those_of_the_agenda(library, monkeypatch):
    """A broken agenda changes the result, and the library tells."""
    broken = Agenda(library)
    monkeypatch.setattr(broken, "merge_all", lambda cuts: [b""] * len(cuts))
    ids, agree = broken.encode(["one text", "", "another"])
    assert ids == [broken.begin + broken.end] * 3
    assert agree == [False, True, False]


def test_whole_texts_are_checked(library):
    """Cuts that the library confirms, joined in a wrong way."""
    wrong = Agenda(library)
    wrong.known["▁b"] = wrong.merge("▁a")
    assert wrong.encode(["a b"])[1] == [False]


@pytest.mark.parametrize("change", [
    lambda m: m.normalizer_spec.__setattr__("remove_extra_whitespaces", True),
    lambda m: m.normalizer_spec.__setattr__("add_dummy_prefix", False),
    lambda m: m.normalizer_spec.__setattr__("precompiled_charsmap", b"x"),
    lambda m: m.trainer_spec.__setattr__("model_type", 1),
    lambda m: m.pieces[300].__setattr__("type", 4),
])
def test_models_with_other_rules_are_refused(spark, tmp_path, change):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    sentencepieces.require_supported(model.SerializeToString())
    change(model)
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="unsupported model"):
        sentencepieces.encode(spark.createDataFrame([("a",)], "text string"), str(tmp_path / "other.model"))
