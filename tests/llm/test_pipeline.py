"""Each stage of the pipeline against plain Python on its own input."""

import corpus_pipeline as pipeline
from sentencepiece import SentencePieceProcessor

from holdfast.llm import batches
from holdfast.llm.queries import tokenizer_path
from tests.llm.test_decontamination import brute as leaks_of
from tests.llm.test_linededup import brute as lines_of
from tests.llm.test_neardup import brute as components_of

DIR = "/root/testdata/sf0.001"


def written(df, folder):
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    odd = [(10**6, None, "en", "src1", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "12 34 !!", None, "src1", 8),
           (None, "these are words without an id", "en", "src2", 3), (10**6 + 3, benchmark[0][1], "en", "src3", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    state = {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, DIR), tmp_path / name)
        state[name] = (docs.collect(), out.collect())
        if name != "encode":
            assert out.columns == docs.columns
        docs = out

    given, got = state["language_id"]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in given if r.text and any(c.isalpha() for c in r.text))
    given, got = state["line_dedup"]
    want = lines_of([(r.doc_id, r.text, r.source) for r in given], 8)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert all(r.n_chars == len(r.text) for r in got)
    given, got = state["near_duplicates"]
    smallest = components_of([(r.doc_id, r.text) for r in given if r.doc_id is not None], 80)
    assert sorted(str(r.doc_id) for r in got) == sorted([str(i) for i, c in smallest.items() if i == c] + ["None"])
    given, got = state["decontaminate"]
    leaks = {d for d, *_ in leaks_of(list(enumerate(r.text for r in given)), benchmark)}
    assert 10**6 + 3 in {given[i].doc_id for i in leaks}
    assert sorted(map(str, got)) == sorted(str(r) for i, r in enumerate(given) if i not in leaks)
    given, got = state["encode"]
    library = SentencePieceProcessor(model_file=tokenizer_path())
    assert len(got) == len(given) and all(r.ids_agree and r.round_trip for r in got)
    for r in got:
        assert r.n_tokens == len(library.encode(r.text)) + 2


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_language_stage_rejects_and_keeps_given_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = docs.filter("doc_id % 2 = 0 and length(text) > 200").first()
    claimed = "en" if given.lang != "en" else "fr"
    odd = [(10**6, "Дети каждое утро ходят в школу, а родители едут на работу в большой город. " * 3, None, "src1", 0),
           (10**6 + 1, given.text, claimed, "src1", 0), (10**6 + 2, given.text, None, "src1", 0)]
    out = pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), DIR)
    got = {r.doc_id: r.lang for r in out.select("doc_id", "lang").collect()}
    assert 10**6 not in got
    assert got[10**6 + 1] == claimed and got[10**6 + 2] == given.lang


def test_language_stage_without_languages(spark):
    rows = [(1, "clean words", None, "src1", 11), (2, None, None, "src1", 0), (3, "12 !!", None, None, 5), (None, "é", None, "src2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.language_id(spark, docs, DIR)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_texts_of_a_reused_id_are_documents_of_their_own(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(1, a), (1, a), (5, a), (5, b), (2, b), (7, c), (7, d), (7, None), (8, d + " more"), (None, a), (9, "alone here")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "reused")
    out = pipeline.near_duplicates(spark, docs, DIR)
    assert out.columns == docs.columns
    want = [(1, a), (2, b), (7, c), (7, d), (7, None), (None, a), (9, "alone here")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_only_leaking_texts_go(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    rows = [(None, item), (None, "a clean text"), (1, "another clean text"), (5, item), (5, "a third clean text"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pipeline.decontaminate(spark, docs, DIR)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for r in rows if r[1] != item)


def test_extra_columns_stay(spark, tmp_path):
    """Columns named as those that the stages use inside."""
    extra = "reused int, node int, found_lang int, found_score int, found int, score int, lines_removed int, unit int, leak int, doc int, kept int, given int"
    plain = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    names = [c.split()[0] for c in extra.split(", ")]
    docs = written(plain.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(names)]), tmp_path / "extra")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(names).distinct().collect()} == {tuple(range(len(names)))}


def test_encoding_and_decoding_do_not_share_a_task(spark):
    """A task that did both would hold two Python processes, each with a model and its batches."""
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    out = pipeline.encode(spark, docs, DIR)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert all(r.round_trip for r in out.collect())


def test_batches_are_short_while_ids_are_written(spark, monkeypatch):
    seen, write = [], pipeline.materialise
    monkeypatch.setattr(pipeline, "materialise", lambda df, name: seen.append(int(spark.conf.get(batches.ROWS_SETTING))) or write(df, name))
    before = spark.conf.get(batches.ROWS_SETTING)
    pipeline.encode(spark, spark.createDataFrame([(1, "some words")], "doc_id long, text string"), DIR)
    assert seen == [batches.ROWS] and spark.conf.get(batches.ROWS_SETTING) == before
