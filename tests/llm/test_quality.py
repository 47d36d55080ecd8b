import numpy as np
import pytest
from graphloom.llm import quality as Q
from tables import docs, labels


@pytest.fixture(scope="module")
def larger(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.01")
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_held_out_labels(spark, larger):
    """Fitted on half of the labelled rows, told on the other half."""
    d, known = larger
    told = Q.quality(d, known.where("doc_id % 2 = 0")).join(known.where("doc_id % 2 = 1").withColumnRenamed("quality", "label"), "doc_id").collect()
    good, bad = ([r for r in told if r.label == k] for k in (1, 0))
    assert sum(r.keep for r in good) >= 0.97 * len(good) and sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_votes_against_brute_force(spark, larger):
    d, known = larger
    space = Q.fit(d, known)
    texts = [r.text for r in d.orderBy("doc_id").limit(60).collect()]
    got = space.score(texts)
    for text, score in zip(texts, got):
        v = (Q.features([text])[0].astype(np.float64) * space.idf) @ space.axes.astype(np.float64)
        v /= np.linalg.norm(v)
        cos = np.array([float(v @ n) for n in space.votes.astype(np.float64)])
        near = np.argsort(-cos)[: Q.NEIGHBOURS]
        w = cos[near] ** 4
        assert score == pytest.approx((w * space.labels[near]).sum() / w.sum(), abs=0.02)


def test_fitting_does_not_depend_on_the_order_of_rows(spark, larger):
    d, known = larger
    a, b = Q.fit(d, known), Q.fit(d.repartition(7), known.repartition(3))
    texts = [r.text for r in d.orderBy("doc_id").limit(50).collect()]
    assert np.allclose(a.score(texts), b.score(texts), atol=1e-4)


def test_the_whole_text_counts():
    a, b = Q.features(["fine words here " * 20_000, "fine words here " * 20_000 + "$$$ !!! " * 20_000])
    assert not np.allclose(a, b)


def test_without_labels_nothing_is_judged(spark):
    table = docs(spark)
    for known in (labels(spark), labels(spark, [(1, 1, 0), (6, 1, 0), (None, 0, 0), (8, None, None)])):
        assert {(r.score, r.keep) for r in Q.quality(table, known).collect()} == {(None, True)}
        assert Q.keep_good(table, known).count() == table.count()


def test_awkward_rows(spark):
    table, known = docs(spark), labels(spark, [(1, 1, 0), (6, 1, 0), (7, 1, 0), (8, 0, 0), (10, 0, 0), (3, 0, 0), (3, 0, 0), (2, 1, 0)])
    rows = Q.quality(table, known).collect()
    assert len(rows) == table.count() and {(r.score, r.keep) for r in rows if r.doc_id in (2, 3, 4)} == {(0.0, False)}
    out = Q.keep_good(table, known)
    assert out.columns == table.columns and out.count() == sum(r.keep for r in rows)
    assert Q.quality(table.limit(0), known).count() == 0 and Q.keep_good(table.limit(0), known).count() == 0


def test_repeated_rows_do_not_exceed_the_bound(spark):
    rows = [(1, "good words of a good text")] * 2000 + [(2, "$$$ !!! $$$")] * 2000 + [(3, f"another good text of number {k}") for k in range(2000)]
    known = labels(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 0)] * 5)
    space = Q.fit(docs(spark, rows), known, rows=50)
    assert sorted(np.bincount(space.labels.astype(int))) == [1, 50]
