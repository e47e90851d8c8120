"""Near-duplicates against all pairs."""

import random
import re
from itertools import combinations

import pytest

from holdfast.llm import neardup
from holdfast.llm.components import components
from holdfast.llm.queries import op6_neardup


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def smallest_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, percent):
    """All pairs that share a shingle."""
    sets, holders = {}, {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    for i, own in sets.items():
        for s in set().union(*own):
            holders.setdefault(s, set()).add(i)
    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    edges = [(a, b) for a, b in pairs if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y)]
    return smallest_reachable(sets, edges)


def made():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for base in range(12):
        text = [draw.choice(words) for _ in range(draw.choice([30, 60, 120, 300]))]
        for copy in range(draw.choice([1, 3, 25])):
            own = list(text)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                own[draw.randrange(len(own))] = f"x{i}"
            rows.append((i, (" " if copy % 2 else "\n\t").join(own).upper() if copy % 3 else " ".join(own)))
            i += 1
    passage = " ".join(draw.choice(words) for _ in range(80))
    for _ in range(60):
        rows.append((i, passage + " " + " ".join(f"y{i}_{k}" for k in range(draw.randrange(40)))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "  \n"), (i + 3, "one two"), (i + 4, "ONE  two"), (i + 5, "two one"),
             (i + 6, "É a b c d e"), (i + 7, "é a b c d e"), (i + 8, "a " * 20000), (i + 9, "a " * 6)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_made_documents(spark, percent):
    rows = made()
    want = brute(rows, percent)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, bucket string")
    got = neardup.near_duplicates(df.repartition(5), percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(shingles(rows[r.doc_id][1]))


def test_repeated_and_missing_ids(spark):
    long, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, long), (1, long), (2, long), (None, long), (7, other), (7, long), (9, other), (8, "alone here")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out) == sorted(
        [("1", 1), ("1", 1), ("2", 1), ("None", None), ("7", 1), ("7", 1), ("9", 1), ("8", 8)])


def test_shared_id_that_leads_no_class(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, one), (5, two), (1, one), (2, two)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (2, 1, False), (5, 1, False), (5, 1, False)]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, draw.randrange(1001, 2000)) for _ in range(300)]
    edges += [(draw.randrange(3000, 3400), draw.randrange(3000, 3400)) for _ in range(200)] + [(5, 5)]
    nodes = {n for e in edges for n in e}
    want = smallest_reachable(nodes, edges)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: m for n, m in want.items() if n != m}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    want = brute(list(zip(docs.doc_id, docs.text)), 85)
    got = {r.doc_id: r.component_id for r in op6_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_words_of_one_pattern_differ():
    """The word of 1,024 letters that a polynomial modulo 2**64 takes for its complement."""
    from holdfast.llm.shingles import Shingler

    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    sets = Shingler().sets([one.encode(), two.encode(), one.upper().encode(), b"ab", b"ba", b"a b", b""])
    assert sets[0].tolist() == sets[2].tolist() != sets[1].tolist()
    assert len({s.tobytes() for s in sets[3:]}) == 4


def _open(spark, texts, parts):
    """Sets and parts of the second round; text k is node k."""
    nodes = spark.createDataFrame([(i, bytearray((t or "").encode())) for i, t in enumerate(texts)], "node bigint, text binary")
    return (neardup.shingle_sets(nodes), spark.createDataFrame(list(enumerate(parts)), "node bigint, part bigint"))


def _compared(sets, parts, percent):
    return sum(j.count() for j in neardup.meetings(neardup.prefix_tokens(sets, parts, percent)))


@pytest.mark.parametrize("percent", [80, 85])
def test_second_round_misses_no_pair(spark, percent):
    texts = [t for _, t in made()]
    draw = random.Random(percent)
    parts = [draw.randrange(9) for _ in texts]
    own = [shingles(t) for t in texts]
    want = {(v, u) for u, v in combinations(range(len(texts)), 2) if parts[u] != parts[v] and own[u]
            and 100 * len(own[u] & own[v]) >= percent * len(own[u] | own[v])}
    sets, placed = _open(spark, texts, parts)
    got = {tuple(r) for r in neardup.between_parts(sets, placed, percent).collect()}
    assert want <= got
    assert {tuple(r) for r in neardup.confirmed(neardup.between_parts(sets, placed, percent), sets, percent).collect()} == want


def _template(copies, own):
    """Texts that share 200 words and end with words of their own."""
    shared = [f"t{i}" for i in range(200)]
    return [" ".join(shared + [f"o{c}x{i}" for i in range(own)]) for c in range(copies)]


def test_texts_of_one_template_are_not_compared(spark):
    """No two are similar, and each is a part of its own."""
    for copies in (40, 160):
        sets, parts = _open(spark, _template(copies, 60), range(copies))
        assert _compared(sets, parts, 80) == 0


def test_outsiders_of_a_large_part_cost_a_row_per_member(spark):
    """Similar texts, all but one in one part: comparisons grow with the members, not with their square."""
    counts = []
    for copies in (40, 160):
        sets, parts = _open(spark, _template(copies, 10), [0] * (copies - 1) + [copies])
        counts.append(_compared(sets, parts, 80))
        assert neardup.between_parts(sets, parts, 80).count() == copies - 1
    assert 0 < counts[1] <= 5 * counts[0]
