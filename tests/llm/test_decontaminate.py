import random
import re

import pytest

from graphloom.llm import decontaminate as D
from graphloom.llm.common import plain, plain_spans
from tables import as_set, docs

ITEMS = [(1, "What is the capital of the largest country in the world by area?"), (2, "Short five word item here."), (3, "Too short."), (4, None), (5, ""), (None, "No id has this item of eight words."), (1, "What is the capital of the largest country in the world by area?")]


def bench(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "own") for i, t in rows], "item_id long, text string, start string")


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(text, items, window=D.WINDOW):
    own, found = words(text), set()
    for item, t in items:
        w = words(t or "")
        if item is None or not w:
            continue
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if any(tuple(own[k : k + n]) in grams for k in range(len(own) - n + 1)):
            found.add(item)
    return found


def test_offsets_are_those_of_the_original(spark):
    text = "Intro – so: WHAT is\tthe   “capital” of the… largest country, in the world by area? The end"
    (row,) = D.contamination(docs(spark, [(7, text)]), bench(spark)).collect()
    assert (row.doc_id, row.item_id) == (7, 1) and text[row.start : row.end] == "WHAT is\tthe   “capital” of the… largest country, in the world by area"
    wide = "İ\U0001f600 ß " + text
    (row,) = D.contamination(docs(spark, [(7, wide)]), bench(spark)).collect()
    assert wide[row.start : row.end].startswith("WHAT") and wide[row.start : row.end].endswith("area")


def test_whole_words_only_and_windows():
    a = D.automaton([(i, t) for i, t in ITEMS if t and i])
    assert D.spans("short five word item hereafter", a) == [] and D.spans("xshort five word item here", a) == []
    assert [s[0] for s in D.spans("a short FIVE-word item, here", a)] == [2]
    assert D.spans("is the capital of the largest country", a) == []  # seven words
    assert [s[0] for s in D.spans("is the capital of the largest country in", a)] == [1]
    text = "Short five word item here. And again: short five word item here."
    assert [text[s:e] for _, s, e in D.spans(text, a)] == ["Short five word item here"[:25], "short five word item here"]
    assert D.spans("anything", D.automaton([])) == []


def test_normalising_twice_gives_the_same():
    for t in ("A b C", "ÀÉ – x", "", "…", "a" * 10, "x y。z×÷w", "İstanbul", "\U0001f600 ok"):
        twice = plain_spans(t)[0]
        assert twice == plain(t) or twice.split() == plain(t).split() == []


def test_against_brute_force(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in b.collect()]
    r = random.Random(2)
    rows = [(x.doc_id, x.text) for x in d.collect()]
    for k, (i, t) in enumerate(items):  # the second half of each item, in other type, within another text
        w = t.split()
        rows.append((10_000 + k, f"{r.choice(rows)[1][:300]} - {' '.join(w[len(w) // 2 - 8 :]).upper()}; {r.choice(rows)[1][:200]}"))
    want = {(i, item) for i, t in rows for item in brute(t, items)}
    got = {(x.doc_id, x.item_id) for x in D.contamination(docs(spark, rows), b).collect()}
    assert got == want and len(want) > len(items) * 0.8
    left = {x.doc_id for x in D.drop_contaminated(docs(spark, rows), b).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}


def test_awkward_rows(spark):
    table, none = docs(spark), docs(spark).limit(0)
    assert D.contamination(table, bench(spark)).count() == 0 and D.contamination(none, bench(spark)).count() == 0
    for b in (bench(spark), bench(spark, [])):
        out = D.drop_contaminated(table, b)
        assert out.columns == table.columns and out.count() == table.count()
    bad = docs(spark, [(1, "short five word item here"), (1, "short five word item here"), (None, "short five word item here"), (2, None), (3, "x " * 100_000 + "short five word item here")])
    assert sorted(tuple(r)[:2] for r in D.contamination(bad, bench(spark)).collect()) == [(1, 2), (1, 2), (3, 2)]
    assert [r.doc_id for r in D.drop_contaminated(bad, bench(spark)).collect()] == [2]
    assert D.contamination(bad, bench(spark, [])).count() == 0 and as_set(D.contamination(docs(spark, [(2, None)]), bench(spark))) == set()


def test_short_items_are_found_whole(spark):
    b = bench(spark, [(1, "Who was he?"), (2, "Oslo"), (3, "..."), (4, "")])
    table = docs(spark, [(1, "They asked: WHO was -- he?"), (2, "in Oslo."), (3, "Osloer, who was"), (4, "..."), (5, None)])
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in D.contamination(table, b).collect()}
    assert got == {(1, 1, 12, 25), (2, 2, 3, 7)}
    assert {r.doc_id for r in D.drop_contaminated(table, b).collect()} == {3, 4, 5}


def test_benchmarks_do_not_mix_in_a_worker(spark):
    table = docs(spark, [(1, "short five word item here")])
    for k in range(4):
        assert D.contamination(table, bench(spark, [(k, "short five word item here")])).first().item_id == k
        assert D.contamination(table, bench(spark, [(k, "something else that is not there")])).count() == 0


def test_scripts_without_blanks(spark):
    b = bench(spark, [(1, "世界で一番面積の大きい国の首都はどこですか"), (2, "กรุงเทพมหานครเป็นเมืองหลวง"), (3, "首都は東京")])
    table = docs(spark, [(1, "問題：「世界で一番面積の大きい国の首都はどこですか」という。"), (2, "x กรุงเทพมหานครเป็นเมืองหลวง y"), (3, "一番面積の大きい国の人口"), (4, "日本の首都は東京だ"), (5, "世界で一番高い山")])
    got = {(r.doc_id, r.item_id): (r.start, r.end) for r in D.contamination(table, b).collect()}
    assert got == {(1, 1): (4, 25), (2, 2): (2, 28), (4, 3): (3, 8)}
    assert {r.doc_id for r in D.drop_contaminated(table, b).collect()} == {3, 5}


def test_windows_by_weight():
    assert D.windows([1] * 4, 3) == [(0, 3), (1, 4)] and D.windows([1, 1], 3) == [(0, 2)] and D.windows([], 3) == []
    assert D.windows([0.5] * 5, 2) == [(0, 4), (1, 5)] and D.windows([1, 0.5, 0.5, 1], 2) == [(0, 3), (1, 4)]
    assert D.windows([0.5, 1, 1, 0.5], 2) == [(0, 3), (1, 3)]


def test_a_table_without_text_is_an_error(spark):
    with pytest.raises(ValueError):
        D.drop_contaminated(docs(spark).drop("text"), bench(spark))
