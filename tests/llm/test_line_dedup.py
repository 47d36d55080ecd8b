import random
from collections import defaultdict

import pytest
from graphloom.llm import line_dedup as L
from tables import docs


def brute(rows, least):
    """(doc_id, source, text) -> {doc_id: (text, removed)}; ids are distinct."""
    sites, first = defaultdict(set), {}
    for i, source, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            if key := line.strip(" \t\r"):
                sites[key].add(source or "")
                first.setdefault(key, (i, pos))
    out = {}
    for i, _, text in rows:
        keep = []
        for pos, line in enumerate(text.split("\n")):
            key = line.strip(" \t\r")
            if not key or len(sites[key]) < least or first[key] == (i, pos):
                keep.append(line)
        out[i] = "\n".join(keep), len(text.split("\n")) - len(keep)
    return out


@pytest.mark.parametrize("least", [2, 3, 8, 30])
def test_against_brute_force(spark, least):
    r = random.Random(least)
    lines = [f"line {k}" for k in range(40)] + ["", " ", "  line 1 ", "line 2\r"]
    rows = [(i, f"site{r.randrange(1 + i % 50)}", "\n".join(r.choice(lines) for _ in range(r.randrange(8)))) for i in range(400)]
    got = {x.doc_id: (x.text, x.removed) for x in L.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), least).collect()}
    assert got == brute([(i, s, t) for i, s, t in rows], least)


def test_counts_near_the_threshold_are_exact(spark):
    """Sketches of this size err by some percent; a line on 199 sites stays, one on 200 goes."""
    rows = [(i, f"site{i}", "on 199\non 200" if i < 199 else "on 200") for i in range(200)]
    got = {x.doc_id: x.text for x in L.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), 200).collect()}
    assert got == {i: "on 199\non 200" if i == 0 else "on 199" if i < 199 else "" for i in range(200)}


def test_awkward_rows(spark):
    rows = [(1, "menu\nown one"), (1, "menu\nown one"), (2, None), (None, "menu\nlost"), (3, ""), (4, "menu\n" * 100_000), (5, "menu\nmenu\nend\n"), (6, "\n\n")]
    table = docs(spark, rows)
    out = L.strip_boilerplate(table, 2)
    assert out.columns == [*table.columns, "_removed"]
    got = sorted(((x.doc_id or 0), x.text, x._removed) for x in out.collect() if x.text is not None)
    # rows: sources are null, s1, s2, s3, null, s1, s2, s3; equal rows are one document, whose first line is the first
    assert got == [(0, "menu\nlost", 0), (1, "menu\nown one", 0), (1, "menu\nown one", 0), (3, "", 0), (4, "", 100_000), (5, "end\n", 2), (6, "\n\n", 0)]
    assert [(x.doc_id, x._removed) for x in out.where("text IS NULL").collect()] == [(2, 0)]
    assert L.strip_boilerplate(table.limit(0)).count() == 0


def test_documents_without_source_are_one_site(spark):
    rows = [(i, None, "shared line") for i in range(20)]
    assert L.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), 2).where("removed > 0").count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    rows = [(1, "a", "menu\nA"), (1, "b", "menu\nB"), (2, "c", "menu\nC"), (2, "c", "menu\nC")]
    out = L.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), 3).collect()
    kept = [r.text for r in out if r.text.startswith("menu")]
    assert len(out) == 4 and len(kept) == 1 and kept[0][-1] in "AB"


def test_many_lines_in_linear_time(spark):
    rows = [(i, f"s{i}", "\n".join(f"line {k}" for k in range(200_000))) for i in range(3)]
    got = {r.doc_id: (r.text, r.removed) for r in L.strip_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), 3).collect()}
    assert got == {0: (rows[0][2], 0), 1: ("", 200_000), 2: ("", 200_000)}
