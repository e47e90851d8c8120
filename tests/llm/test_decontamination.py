"""Containment against plain sets."""

import random
import re

from holdfast.llm import decontamination


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, percent=80):
    found, own = {}, {}
    for i, text in items:
        w = words(text)
        if w:
            own.setdefault(i, set()).update(grams(w, min(5, len(w))))
    for d, text in docs:
        w = words(text)
        for i, wanted in own.items():
            hit = {g for g in wanted if g in grams(w, len(g))}
            found.setdefault((d, i), set()).update(hit)
    return {(d, i, len(own[i]), len(hit)) for (d, i), hit in found.items() if 100 * len(hit) >= percent * len(own[i])}


def test_planted_passages(spark):
    draw = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([5, 6, 12, 20, 21, 40, 59, 200, 3, 1, 400])]
    items += [(50, None), (51, " \n"), (52, "Mixed CASE item of words é É with more of them in here"), (0, items[0][1])]
    docs = [(1000 + i, " ".join(say(draw.choice([0, 2, 50, 4000])))) for i in range(20)] + [(900, None), (901, "")]
    d = 0
    for _, text in items:
        for changed in range(5):
            w = words(text)
            for _ in range(changed):
                if w:
                    w[draw.randrange(len(w))] = "changed"
            around = say(draw.choice([0, 30, 3000]))
            docs.append((d, " ".join([*around, *[x.upper() for x in w], *say(20)])))
            d += 1
    docs += [(None, items[3][1]), (3, items[4][1])]
    d_frame = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, h int, item_id int").repartition(4)
    i_frame = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in decontamination.contained(d_frame, i_frame).collect()}
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    full = spark.createDataFrame([(1, "some words that are here for all to see")], docs)
    none = spark.createDataFrame([], docs)
    item = spark.createDataFrame([(1, "words that are here for all")], items)
    assert decontamination.contained(none, item).count() == 0
    assert decontamination.contained(full, spark.createDataFrame([], items)).count() == 0
    assert decontamination.contained(full, item).count() == 1


def test_rows_without_id_are_known_by_their_text(spark):
    item = [f"w{i}" for i in range(40)]
    halves = [(None, " ".join(item[:24])), (None, " ".join(item[16:])), (1, " ".join(item))]
    docs = spark.createDataFrame(halves, "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(item)), (None, "five other words of item"), (7, " ".join(item))], "item_id long, text string")
    got = sorted(map(str, map(tuple, decontamination.contained(docs, items).collect())))
    assert got == ["(1, 7, 36, 36)", "(1, None, 36, 36)"]
