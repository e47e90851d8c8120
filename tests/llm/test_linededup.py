"""Line removal against plain counting."""

from collections import defaultdict

from holdfast.llm import linededup


def brute(rows, sites):
    spread = defaultdict(set)
    for _, text, site in rows:
        for line in set((text or "").split("\n")):
            if line.strip(" "):
                spread[line].add(site)
    drop = {line for line, seen in spread.items() if len(seen) >= sites}
    out = []
    for i, text, _ in rows:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if x not in drop)
        out.append((i, text))
    return sorted(out, key=str)


def rows():
    out = [(None, "own words here\nall rights reserved", "s0"), (900, None, "s1"), (901, "", None)]
    for i in range(60):
        lines = [f"line of its own, number {i}", "all rights reserved", "", "  ", f"shared by {i % 12}"]
        if i % 5 == 0:
            lines += ["rare notice", "rare notice"]
        out.append((i, "\n".join(lines), f"s{i % 10}" if i % 7 else None))
    out += [(1000 + i, "a whole copied text\nwith two lines", f"s{i % 10}") for i in range(40)]
    out += [(5, "line twice with one id\nall rights reserved\nand more of its own", "s3")] * 2
    return out


def test_against_brute_force(spark):
    schema = "doc_id long, text string, source string"
    given = rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in given], schema + ", found int, id int")
    for sites in (2, 5, 8, 10):
        out = linededup.remove_lines(df, sites=sites)
        assert out.columns == [*df.columns, "lines_removed"]
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute(given, sites)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert linededup.remove_lines(empty).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    out = linededup.remove_lines(docs, sites=4).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == brute(given, 4)
    assert sum(r.lines_removed for r in out) > 0


def test_pages_of_boilerplate_and_copies_lose_it(spark):
    notice = "all rights reserved by the owners of this site"
    given = [(i, f"{notice}\nown {i}", f"s{i}") for i in range(10)]
    given += [(200, notice, "s1"), (201, f"{notice}\n{notice}", "s1"), (None, f"{notice}\nown 1", "s2"), (None, "other", "s2")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.text, r.lines_removed) for r in linededup.remove_lines(df).collect())
    want = [(str(i), f"own {i}", 1) for i in range(10)]
    assert got == sorted([*want, ("200", "", 1), ("201", "", 2), ("None", "own 1", 1), ("None", "other", 0)])


def test_pipeline_stage_cleans_pages_of_boilerplate(spark):
    import corpus_pipeline

    notice = "all rights reserved by the owners of this site"
    rows = [(i, f"{notice}\nown {i}", "en", f"s{i}", 0) for i in range(10)]
    rows += [(10 + i, f"{notice}\ncopied", "en", "s1", 0) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: (f"own {i}", 5) for i in range(10)} | {10: ("copied", 6), 11: ("copied", 6)}
