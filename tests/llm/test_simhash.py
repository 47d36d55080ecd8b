import random

import numpy as np
import pytest
from graphloom.llm import simhash as S
from pyspark.sql import functions as F
from tables import as_set, docs


def brute(signs: np.ndarray, most: int) -> set[tuple[int, int]]:
    bits = np.unpackbits(signs.view(np.uint8), axis=1).astype(np.int16)
    far = bits.sum(1)[:, None] + bits.sum(1)[None] - 2 * bits @ bits.T
    a, b = np.nonzero(np.triu(far <= most, 1))
    return set(zip(a.tolist(), b.tolist()))


def parts(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def vocabulary(seed, n=3000):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 11))) for _ in range(n)]


def table(spark, signs: np.ndarray):
    return spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(signs.view(np.int64))], "rep long, " + ", ".join(f"{c} long" for c in S._ALL))


def found(signs):
    return set().union(*(as_set(p) for p in S.similar(signs)))


def test_recall_against_all_pairs(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    r = random.Random(3)
    for t in texts[:80]:  # copies with one word in 12 put out
        texts.append(" ".join("edit" if r.random() < 1 / 12 else w for w in t.split()))
    signs = S.signatures(texts)
    distinct = np.unique(signs[(signs != 0).any(axis=1)], axis=0)
    apart = lambda p: [int(a ^ b).bit_count() for a, b in zip(distinct[p[0]], distinct[p[1]])]
    pairs = lambda most: {p for p in brute(distinct[:, : S.LANES].copy(), most) if max(apart(p)[: S.LANES]) <= S.LANE_BITS and sum(apart(p)[S.LANES :]) <= S.ORDER_BITS}
    want, sure, got = pairs(S.MAX_BITS), pairs(S.GUARANTEED), found(table(spark, distinct))
    assert len(sure) > 10 and sure <= got <= want and len(got) >= 0.98 * len(want)


def test_up_to_the_guarantee_no_pair_is_missed(spark):
    """Also where every segment but one differs in two bits."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, (60, S.LANES + S.ORDER_LANES), dtype=np.uint64)
    near = base.copy()
    for n, row in enumerate(near):
        for s in range(S.SEGMENTS):
            for at in r.choice(S.WIDTH, 1 if s == n % S.SEGMENTS else 2, replace=False):
                at += s * S.WIDTH
                row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    assert found(table(spark, np.concatenate([base, near]))) == {(i, i + 60) for i in range(60)}


def test_recall_in_each_band_up_to_the_threshold(spark):
    r = np.random.default_rng(11)
    far = np.repeat([10, 20, 30, S.GUARANTEED, 38, 44, 50, S.MAX_BITS, S.MAX_BITS + 1], 300)
    base = r.integers(0, 2**64, (len(far), S.LANES + S.ORDER_LANES), dtype=np.uint64)
    flips = np.argsort(np.argsort(r.random((len(far), S.LANES * 64)), axis=1), axis=1) < far[:, None]
    near = base.copy()
    near[:, : S.LANES] ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    got = found(table(spark, np.concatenate([base, near])))
    assert got <= {(i, i + len(far)) for i in range(len(far))}
    hit = np.isin(np.arange(len(far)), [a for a, _ in got])
    share = {int(d): hit[far == d].mean() for d in np.unique(far)}
    assert share.pop(S.MAX_BITS + 1) == 0
    least = {50: 0.95, S.MAX_BITS: 0.9}
    assert all(x >= (1 if d <= S.GUARANTEED else least.get(d, 0.98)) for d, x in share.items()), share


@pytest.mark.parametrize("block, small", [(S.BLOCK, S.SMALL), (S.BLOCK, 0), (150, 0), (7, S.SMALL)])
def test_no_pair_up_to_the_threshold_is_missed(spark, block, small):
    """Also where differing bits are spread evenly, so that wide segments differ in several each; a bit
    more in all, in a lane or in the order, and it is no pair.  Chains of pairs come once each."""
    r = np.random.default_rng(17)
    base = r.integers(0, 2**64, (90, S.LANES + S.ORDER_LANES), dtype=np.uint64)
    near = base.copy()
    spread = lambda n, bits: np.arange(n) * bits // n
    order = S.LANES * 64
    kinds = [
        (spread(S.MAX_BITS, order), True), (spread(S.MAX_BITS - 7, order), True), (spread(S.MAX_BITS + 1, order), False), ([*range(S.LANE_BITS), *range(64, 64 + S.LANE_BITS)], True), (range(S.LANE_BITS + 1), False),
        ([*spread(S.MAX_BITS, order), *(order + spread(S.ORDER_BITS, 128))], True), (order + spread(S.ORDER_BITS + 1, 128), False),
    ]
    for n, row in enumerate(near):
        for at in kinds[n % len(kinds)][0]:
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    chain = np.repeat(base[:1], 12, axis=0)
    for n, row in enumerate(chain):
        row[0] ^= np.uint64(2**n)
    rows = np.concatenate([base, near, chain])
    got = [tuple(x) for p in S.similar(table(spark, rows), block=block, small=small) for x in p.collect()]
    chained = [0, 90, *range(180, 192)]
    near_far = {(90, i): sum(int(a ^ b).bit_count() for a, b in zip(near[0], chain[i - 180])) <= S.MAX_BITS for i in chained[2:]}
    want = {(n, n + 90) for n in range(90) if kinds[n % len(kinds)][1]} | {(a, b) for a in chained for b in chained if a < b and near_far.get((a, b), True)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_wider_threshold_has_more_segments(spark):
    signs = np.random.default_rng(19).integers(0, 2**64, (2, S.LANES + S.ORDER_LANES), dtype=np.uint64)
    signs[1] = signs[0]
    signs[1, : S.LANES] ^= np.packbits(np.arange(320) % 4 == 0, bitorder="little").view(np.uint64)  # 80 bits, 16 in each lane
    for most, n in ((79, 0), (80, 1)):
        assert len({tuple(x) for p in S.similar(table(spark, signs), most, small=0) for x in p.collect()}) == n


def test_components_against_union_find(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 440)]
    got = as_set(S.components(spark.createDataFrame(pairs, "a long, b long")))
    assert got == {(x, y) for x, y in parts(p for p in pairs if p[0] != p[1]).items() if x != y}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_are_grouped_and_others_left_alone(spark):
    words, r = vocabulary(2), random.Random(9)
    base = [[r.choice(words) for _ in range(n)] for n in (30, 80, 200, 600, 2000)]
    rows = []
    for g, b in enumerate(base):
        rows.append((g * 100, " ".join(b)))
        rows.append((g * 100 + 1, " ".join(b).upper()))
        for k in range(2, 6):
            copy = list(b)
            for _ in range(max(1, len(b) // 40)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((g * 100 + k, " ".join(copy)))
    alone = [(1000 + i, " ".join(r.choice(words) for _ in range(r.choice((20, 60, 300))))) for i in range(60)]
    ids = lambda df: as_set(df.select("doc_id", "group_id"))
    found = S.near_duplicates(docs(spark, rows + alone))
    assert ids(found) == {(i, i // 100 * 100) for i, _ in rows}
    assert {x.n_same for x in found.where("doc_id % 100 < 2").collect()} == {1} and found.where("n_links < 3").count() == 0
    left = {x.doc_id for x in S.drop_near_duplicates(docs(spark, rows + alone)).collect()}
    assert left == {g * 100 for g in range(5)} | {i for i, _ in alone}


def test_the_same_words_in_another_order_are_no_copy(spark):
    words, r = vocabulary(4), random.Random(2)
    rows = []
    for i in range(20):
        a = [r.choice(words) for _ in range(60)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(r.sample(a, len(a))))]
    assert S.near_duplicates(docs(spark, rows)).count() <= 2


def test_rows_of_one_id_are_judged_each(spark):
    a, b = "first text about a quick brown fox and a lazy dog", "another story that tells of mountains rivers and valleys"
    left = lambda rows: sorted((x.doc_id, x.text) for x in S.drop_near_duplicates(docs(spark, rows)).collect())
    assert left([(1, a), (2, a), (2, b)]) == [(1, a), (2, b)]
    assert left([(1, a), (1, a), (1, b)]) == [(1, b), (1, a)]
    assert left([(1, b), (1, a), (2, a), (2, b)]) == [(1, b), (1, a)]


def test_awkward_rows(spark):
    rows = docs(spark)
    assert as_set(S.near_duplicates(rows).select("doc_id", "group_id")) == {(1, 1), (9, 1), (6, 6), (7, 6)}
    out = S.drop_near_duplicates(rows)
    assert out.columns == rows.columns and sorted(x.doc_id or 0 for x in out.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 12]
    assert S.near_duplicates(rows.limit(0)).count() == 0 and S.drop_near_duplicates(rows.limit(0)).count() == 0
    assert S.near_duplicates(rows.where("text IS NULL")).count() == 0
    with pytest.raises(ValueError):
        S.drop_near_duplicates(rows.drop("text"))


def test_a_signature_does_not_depend_on_the_batch():
    texts = ["one two three", "", "ß ß", "four " * 1000, "...", "b", "one two three"]
    assert (S.signatures(texts) == np.concatenate([S.signatures([t]) for t in texts])).all()


def test_thousands_of_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text in thousands of documents").alias("text"))
    assert S.near_duplicates(rows).agg(F.count("*"), F.max("group_id"), F.min("n_same"), F.max("n_links")).first() == (3000, 0, 2999, 0)
