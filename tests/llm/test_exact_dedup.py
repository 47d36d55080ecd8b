import random
from collections import defaultdict

import pytest
from graphloom.llm import exact_dedup as E
from tables import as_set, docs


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            by[t].append(i)
    return sorted((i, min(own)) for own in by.values() if len(own) > 1 for i in own)


@pytest.mark.parametrize("first, growth", [(1, 1), (2, 2), (256, 4)])
def test_against_brute_force(spark, first, growth):
    r = random.Random(first)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(7))) for _ in range(60)] + ["é", "e", "éx", "é", "é ", "aaaaaaaa", "aaaaaaa"]
    rows = [(i, r.choice(texts)) for i in range(150)] + [(None, "a"), (500, None)]
    got = E.exact_duplicates(docs(spark, rows), first, growth)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_texts_that_part_late_or_end_at_a_level(spark):
    long = "same " * 100_000
    rows = [(1, long), (2, long + "!"), (3, long), (4, long[:-1]), (5, "x" * 256), (6, "x" * 256), (7, "x" * 257), (8, "x" * 255), (9, "x" * 1280), (10, "x" * 1280), (11, "é" * 128), (12, "é" * 128)]
    assert sorted(map(tuple, E.exact_duplicates(docs(spark, rows)).collect())) == brute(rows)


def test_awkward_rows(spark):
    assert sorted(map(tuple, E.exact_duplicates(docs(spark)).collect())) == [(1, 1), (6, 6), (7, 6), (9, 1), (9, 1)]
    assert E.exact_duplicates(docs(spark).limit(0)).count() == 0
    assert as_set(E.exact_duplicates(docs(spark, [(3, ""), (2, ""), (1, None), (0, None)]))) == {(2, 2), (3, 2)}
    assert sorted(map(tuple, E.exact_duplicates(docs(spark, [(3, "a"), (3, "a")])).collect())) == [(3, 3), (3, 3)]


def test_ids_that_repeat_join_no_groups(spark):
    a, b = "a" * 256, "b" * 256
    rows = [(1, a + "tail"), (1, b + "other"), (2, a + "x"), (3, b + "tail"), (4, a + "y")]
    assert E.exact_duplicates(docs(spark, rows)).count() == 0
    r = random.Random(8)
    texts = [h * 256 + m * r.choice((0, 1, 40, 300)) + t for h in "abc" for m in "xy" for t in ("", "tail", "other")]
    rows = [(r.randrange(6), r.choice(texts)) for _ in range(120)]
    want = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        if len(same) > 1:
            want.append((i, min(same)))
    assert sorted(map(tuple, E.exact_duplicates(docs(spark, rows)).collect())) == sorted(want)
    assert sorted(map(tuple, E.exact_duplicates(docs(spark, rows), first=2, growth=2).collect())) == sorted(want)
