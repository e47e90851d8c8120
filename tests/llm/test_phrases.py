"""Phrases against brute force."""

import random
import re
from collections import Counter

import pytest

from holdfast.llm import phrases


def brute(rows, least, most, inside):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        candidates = {g: f for g, f in own.items() if len(g) > 1 and f >= least}
        kept = []
        for g, a in candidates.items():
            if len(g) == 2 and any(100 * f >= inside * a for h, f in candidates.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            score, k = min((10**6 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def corpus(seed):
    draw = random.Random(seed)
    common, rare = [f"w{i}" for i in range(6)], [f"Rare{i}é" for i in range(30)]
    fixed = [["new", "york", "city"], ["ad", "hoc"], ["of", "the", "the"], ["x y", "z"]]
    rows = [("en", None), (None, ""), ("xx", "one two"), ("und", "a b. a b! a\tb"), (None, "a b " * 12)]
    for _ in range(150):
        words = []
        for _ in range(draw.randint(0, 30)):
            words += draw.choice(fixed) if draw.random() < 0.15 else [draw.choice(common if draw.random() < 0.8 else rare)]
        breaks = [draw.choice((" ", " ", " ", "  ", "\t", ", ", ".", "\n")) for _ in words]
        rows.append((draw.choice(("en", "de", None)), "".join(w + b for w, b in zip(words, breaks))))
    return rows


@pytest.mark.parametrize("most", [5, 40, 2000])
def test_against_brute_force(spark, most):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.mine(docs, least=4, most=most, levels=(400_000, 50_000, 0))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, most, 50)


def test_shared_cells_and_bits_only_loosen_bounds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CELLS", 4)
    monkeypatch.setattr(phrases, "BITS", 64)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.mine(docs, least=4, most=20, levels=(400_000, 0))
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 20, 50)


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000L AS a", "5000000000000L AS l", "6000000000000L AS r")
    assert row.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * 16 // 30


def test_without_texts(spark):
    assert phrases.mine(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0
