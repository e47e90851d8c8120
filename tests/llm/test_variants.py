"""Spelling variants against brute force."""

import random
from itertools import combinations

from holdfast.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def test_against_brute_force(spark):
    draw = random.Random(3)
    words = {}
    for letters in ("ab", "abcé", "aâb"):
        for _ in range(150):
            words["".join(draw.choices(letters, k=draw.randint(5, 8)))] = draw.choice((3, 4, 6, 7, 12, 30, 100, 1000))
    words |= {"aaaaa": 9, "aaaaaa": 3, "aaaaaaa": 20, "zzzzz": 5}
    out = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect())) == brute(words)


def test_long_chains_end_at_their_root(spark):
    words = {"m" * 5 + "abcdefghijklmnop"[:k]: 3 * 2**k for k in range(12)}
    got = {r.word: r.root for r in variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"mmmmmabcdefghijk"}


def test_pivots_are_disjoint_and_of_least_frequency():
    draw = random.Random(4)
    for _ in range(300):
        places = sorted(draw.sample(range(9), draw.randint(3, 6)))
        prefix = [(draw.randint(1, 9), f"g{p}", p) for p in places]
        chosen = variants.pivots_of(prefix)
        pairs = [(a, b) for a, b in combinations(prefix, 2) if b[2] - a[2] >= 2]
        assert len(chosen) == 2 and chosen[1][2] - chosen[0][2] >= 2
        assert sum(c[0] for c in chosen) == min(a[0] + b[0] for a, b in pairs)


def test_words_of_texts(spark):
    rows = [(1, "Über ÜBER straße STRAße x×y a1bcdef Été"), (None, "word word WORD'word"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, variants.word_counts(docs, least_length=3, least_count=1).collect()))
    assert got == {"Über": 2, "straße": 2, "x×y": 1, "bcdef": 1, "Été": 1, "word": 4}
    marked = variants.word_counts(docs, key="doc_id", altered=lambda key, run: key + run, least_length=4, least_count=1)
    assert {"1straße", "word"} <= {r.word for r in marked.collect()}
    assert variants.group_variants(variants.word_counts(docs.limit(0))).count() == 0
