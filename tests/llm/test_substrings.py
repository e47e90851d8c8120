"""Removal of repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from holdfast.llm import substrings
from holdfast.llm.suffixes import Pieces


def brute(texts, length):
    """For each text: bytes left, and the removed runs."""
    given = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in given for i in range(len(t) - length + 1))
    out = []
    for t in given:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).tolist()
        out.append((bytes(b for b, g in zip(t, gone) if not g), list(zip(edges[::2], edges[1::2]))))
    return out


def test_repeated_places_of_short_pieces():
    draw = random.Random(1)
    for _ in range(60):
        pieces = [bytes(draw.choices(b"ab\0", k=draw.randint(0, 30))) for _ in range(draw.randint(0, 8))]
        pieces += pieces[: draw.randint(0, 3)]
        for depth in (1, 3, 8, 12):
            seen = Counter(p[i : i + depth] for p in pieces for i in range(len(p) - depth + 1))
            starts = np.cumsum([0, *map(len, pieces)])
            want = [a + i for a, p in zip(starts, pieces) for i in range(len(p) - depth + 1) if seen[p[i : i + depth]] > 1]
            assert Pieces(pieces).repeated(depth).tolist() == want


def test_suffix_array_and_common_prefixes():
    pieces = [b"banana", b"bandana", b"banana", b"", b"an"]
    held = Pieces(pieces)
    order, rank = held.suffix_array()
    suffixes = [p[i:] for p in pieces for i in range(len(p))]
    assert order.tolist() == sorted(range(len(suffixes)), key=lambda i: (suffixes[i], i))
    assert (order[rank] == np.arange(len(order))).all()
    shared = held.common_prefixes(order, rank, 3)
    for slot in range(1, len(order)):
        one, two = suffixes[order[slot - 1]], suffixes[order[slot]]
        want = next((i for i in range(min(len(one), len(two), 3)) if one[i] != two[i]), min(len(one), len(two), 3))
        assert len(two) < 3 or shared[slot] == want


def texts_with_repeats(draw):
    words = ["alpha", "beta", "gamma", "über", "日本", "x", "\n"]
    passage = " ".join(draw.choices(words, k=30))
    texts = [None, "", "short", passage, passage, "a" * 100, "ab" * 60]
    for _ in range(60):
        own = " ".join(draw.choices(words, k=draw.randint(0, 40)))
        texts.append(own[: draw.randint(0, 60)] + passage[draw.randint(0, 20) :] + own if draw.random() < 0.6 else own)
    return texts


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 600])
def test_against_brute_force(spark, shard_bytes):
    """With shards of 600 bytes most anchors are spread over several, which are merged."""
    texts = texts_with_repeats(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = substrings.remove_repeated(docs, length=40, shard_bytes=shard_bytes)
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.removed], r.n_bytes, r.n_removed) for r in out.collect()}
    for i, (kept, spans) in enumerate(brute(texts, 40)):
        size = len((texts[i] or "").encode())
        assert got[i] == (kept, spans, size, size - len(kept)), i


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    texts = texts_with_repeats(random.Random(6))
    monkeypatch.setattr(substrings, "TABLE_BITS", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = substrings.remove_repeated(docs, length=40)
    got = {r.doc_id: bytes(r.kept) for r in out.collect()}
    assert got == {i: kept for i, (kept, _) in enumerate(brute(texts, 40))}


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(250))
    rows = [(1, text, "x", 5), (1, text, "x", 5), (None, text[:120], None, 6), (None, None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor string, n_bytes long")
    out = substrings.remove_repeated(docs)
    assert out.columns == ["doc_id", "text", "anchor", "kept", "n_bytes", "n_removed", "removed"]
    got = sorted((r.doc_id or 0, r.anchor or "", bytes(r.kept), r.n_bytes, r.n_removed) for r in out.collect())
    assert got == [(0, "", text[:120].encode(), 120, 0), (0, "t", b"", 0, 0), (1, "x", b"", 250, 250), (1, "x", b"", 250, 250)]
    assert substrings.remove_repeated(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from holdfast.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    import hashlib

    want = {d: (len((t or "").encode()), hashlib.sha256(kept).hexdigest(), len(spans))
            for (d, t), (kept, spans) in zip(docs, brute([t for _, t in docs], 200))}
    got = {r.doc_id: (r.n_bytes, r.kept_sha256, r.n_spans) for r in QUERIES["op11_suffixdedup"](spark, folder).collect()}
    assert got == want
    assert any(spans for _, _, spans in got.values())
