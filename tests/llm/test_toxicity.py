from collections import Counter
from math import log

from graphloom.llm import toxicity as T
from graphloom.llm.common import labelled
from tables import docs, labels

LEXICON = {" idiot ": 4.0, " scum ": 4.0, " trash ": 4.0, " grobl": 3.0}
A = T.compiled(LEXICON)


def test_lookalikes_digits_and_case_are_folded():
    for text in ("idiot", "IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "idi​ot", "!id!ot?", "ΙDΙΟΤ"):
        assert T.rate(text, A)[1] == 1, text
    assert T.rate("idiotic patriot", A) == (0.0, 0) and T.rate("groblinking", A)[1] == 1


def test_exceptions_and_length():
    assert T.rate("put it in the trash can", A) == (0.0, 0)
    assert T.rate("you are trash", A) == (100 * 4.0 / T.LEAST_WORDS, 1)
    assert T.rate("trash " + "word " * 99, A) == (4.0, 1)
    assert T.rate("trash can trash", A)[1] == 1


def brute(text):
    """By words, without an automaton."""
    words = T.fold(text).split()
    safe = set()
    for phrase in T.EXCEPTIONS:
        p = T.fold(phrase).split()
        safe |= {i + k for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p for k in range(len(p))}
    found = [max([w for t, w in LEXICON.items() if f" {x} ".startswith(t)], default=0) for x in words]
    kept = [w for i, w in enumerate(found) if w and i not in safe]
    return 100 * sum(kept) / max(len(words), T.LEAST_WORDS), len(kept)


def test_against_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").collect()]
    texts += [f"{t[:200]} tra5h can scum, trash {t[:50]} Groblin trash-can" for t in texts[:40]]
    for t in texts:
        assert T.rate(t, A) == brute(t)


def test_held_out_labels(spark, sf_dir):
    """Fitted on half of the labelled rows, told on the other half; some labels are noise, so that no word of
    the document speaks for them."""
    d, known = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    told = T.toxicity(d, *T.fit(d, known.where("doc_id % 2 = 0"))).join(known.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = sum(r.toxic and r.label for r in told)
    assert hit >= 0.85 * sum(r.label for r in told) and hit >= 0.97 * sum(r.toxic for r in told)


def test_without_labels_the_seeds_count(spark):
    lexicon, threshold = T.fit(docs(spark), labels(spark))
    assert threshold == T.THRESHOLD and " idiot " in lexicon
    assert T.fit(docs(spark), labels(spark, [(1, 1, 1), (1, 1, 1)]))[1] == T.THRESHOLD
    assert T.fit(docs(spark).limit(0), labels(spark, [(1, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None)]))[1] == T.THRESHOLD


def test_awkward_rows(spark):
    table = docs(spark, [(1, "you idiot"), (1, "you idiot"), (None, "scum"), (2, None), (3, ""), (4, "fine words " * 50_000), (5, "fine words " * 50_000 + "idiot")])
    got = sorted((r.doc_id or 0, r.score, r.n_hits, r.toxic) for r in T.toxicity(table, LEXICON, 0.6).collect())
    assert got == [(0, 20.0, 1, True), (1, 20.0, 1, True), (1, 20.0, 1, True), (2, 0.0, 0, False), (3, 0.0, 0, False), (4, 0.0, 0, False), (5, round(400 / 100_001, 6), 1, False)]
    assert T.toxicity(table.limit(0), LEXICON, 0.6).count() == 0


def brute_fit(rows):
    """(lexicon, threshold) of (toxic, text), by plain counting; every threshold is tried."""
    rows = sorted(set(rows))
    n = Counter(k for k, _ in rows)
    seen = Counter(), Counter()
    for k, t in rows:
        own = set()
        for w in T.fold(t).split():
            if len(w) > 2:
                own |= {f" {w} "} | {" " + w[:m] for m in T.STEMS if len(w) > m}
        seen[k].update(own)
    odds = {t: log((y + 0.5) / (n[1] + 1)) - log((seen[0][t] + 0.5) / (n[0] + 1)) for t, y in seen[1].items() if y >= max(T.LEAST_DOCS, T.LEAST_SHARE * n[1])}
    learned = {t: w for t, w in odds.items() if w >= T.LEAST_ODDS}
    lexicon = {t: w for t, w in learned.items() if not any(p != t and len(p) >= 4 and t.startswith(p) and q >= w - 0.5 for p, q in learned.items())}
    lexicon |= {T.fold(w): max(v, lexicon.get(T.fold(w), 0)) for w, v in T.SEEDS.items()}
    a = T.compiled(lexicon)
    scores = [(T.rate(t, a)[0], k) for k, t in rows]
    best = max((2 * sum(k for s, k in scores if s >= cut) / (sum(s >= cut for s, _ in scores) + n[1]), cut) for cut in {s for s, _ in scores if s > 0})
    return lexicon, best[1], max((s for s, _ in scores if s < best[1]), default=0.0)


def test_fit_against_brute_force(spark, sf_dir):
    d, known = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.toxic, r.text) for r in d.join(known, "doc_id").select("toxic", "text").collect()]
    lexicon, threshold = T.fit(d, known)
    want, cut, below = brute_fit(rows)
    assert lexicon.keys() == want.keys() and all(abs(lexicon[t] - w) < 1e-9 for t, w in want.items())
    assert below <= threshold <= cut or sum(T.rate(t, T.compiled(want))[0] >= threshold for _, t in rows) > 0


def test_repeated_rows_do_not_exceed_the_bound(spark):
    rows = [(1, "you grobnik")] * 500 + [(2, f"fine text {k}") for k in range(500)] + [(3, "you grobnik"), (4, "fine")]
    known = labels(spark, [(1, 1, 1), (3, 1, 1), (2, 1, 0), (4, 1, 0)] * 3)
    assert sorted(r["count"] for r in labelled(docs(spark, rows), known, "toxic", 20).groupBy("toxic").count().collect()) == [1, 20]
