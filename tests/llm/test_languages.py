"""Held-out accuracy of the network, its gradients, and its rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from holdfast.llm import languages
from holdfast.llm.queries import op10_languages

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = op10_languages(spark, DIR).toPandas()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").toPandas().set_index("doc_id")
    assert len(rows) == len(docs) and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    own = rows[rows.held_out]
    assert (own.lang_pred.to_numpy() == docs.lang[own.doc_id].to_numpy()).mean() > 0.98


def test_gradients():
    """Backpropagation against small differences of the loss."""
    draw = np.random.default_rng(1)
    d = languages.Direction(*[p.astype(float) for p in vars(languages.Direction.drawn(draw, 3)).values()])
    x, target = draw.integers(0, 5, (6, 4)), draw.normal(size=(6, 4, 3))

    def loss():
        return sum((s * t).sum() for s, t in zip(languages._run(d, x)[0], target))

    states, kept = languages._run(d, x)
    assert np.allclose(states[0], d.step(x[0], np.zeros((4, 3))))
    found = languages._learn(d, x, kept, list(target))
    for value, grad in zip((d.e, d.u, d.c), found):
        for place in list(np.ndindex(value.shape))[:60:7]:
            old = value[place]
            value[place] = old + 1e-5
            high = loss()
            value[place] = old - 1e-5
            low = loss()
            value[place] = old
            assert abs((high - low) / 2e-5 - grad[place]) < 1e-3


def small():
    text = {"xx": b"abc abd bca ", "yy": b"uvw vwu wvu "}
    windows = np.array([np.frombuffer((t * 20)[k : k + 64], np.uint8) for t in text.values() for k in range(12)])
    return languages.fit(windows, np.repeat([0, 1], 12), list(text), steps=60)


def test_odd_texts(spark):
    network = small()
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "abc"), (5, "vwu " * 30_000), (5, "abc bca"), (None, "uvw"), (6, "日本")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, score int")
    out = languages.identify(df, network).collect()
    assert [r.lang_pred for r in out][:7] == ["und", "und", "und", "xx", "yy", "xx", "yy"]
    assert out[7].lang_pred in ("xx", "yy")
    assert all(0 <= r.score <= 1 for r in out) and out[0].score == 0
    assert languages.identify(df.limit(0), network).count() == 0


def test_windows_do_not_depend_on_neighbours():
    network = small()
    texts = [b"abc " * 100, b"", b"uvw", b"abc uvw " * 50]
    together = network.documents(texts)
    for text, p in zip(texts, together):
        assert np.allclose(network.documents([text])[0], p, atol=1e-4)
        assert not text or abs(p.sum() - 1) < 1e-3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "xx"), (None, "abc", "xx")], "doc_id long, text string, lang string")
    network = languages.train(docs)
    assert network is None
    assert {r.lang_pred for r in languages.identify(docs, network).collect()} == {"und"}
    one = languages.train(spark.createDataFrame([(i, "abc def", "xx") for i in range(1, 9)], "doc_id long, text string, lang string"))
    assert one.languages == ["xx"]


def test_other_text_is_rejected(spark):
    """Gibberish and scripts not learned go; clean documents stay, and op10 has no such label."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert languages.train(docs, per_language=40).slack is None
    network = languages.train(docs, other=True)
    draw = random.Random(2)
    made = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 10))) for _ in range(60)) for _ in range(50)]
    made += ["Дети каждое утро ходят в школу, а родители едут на работу в большой город. " * 3]
    junk = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    out = languages.identify(junk, network).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out)
    clean = languages.identify(docs.filter(F.rlike("text", F.lit(r"\p{L}"))), network)
    assert clean.filter("lang_pred = 'und'").count() == 0


def test_few_documents_teach_no_other(spark):
    rows = [(i, f"plain words number {i}", "xx") for i in range(1, 40)]
    network = languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), other=True)
    assert network.slack is None and len(network.b) == 1


def test_held_out_documents_stay(spark):
    """The bound is fitted without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.rlike("text", F.lit(r"\p{L}")))
    network = languages.train(docs, other=True)
    apart = docs.filter(languages.held_out("doc_id"))
    changed = docs.withColumn("text", F.when(languages.held_out("doc_id"), F.lit("zq xvk jjw " * 80)).otherwise(F.col("text")))
    assert languages.train(changed, other=True).slack == network.slack
    assert apart.count() > 100 and languages.identify(apart, network).filter("lang_pred = 'und'").count() == 0
