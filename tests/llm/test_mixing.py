import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from graphloom.llm import mixing as M
from same import assert_same
from tables import docs


def quotas(sizes: dict[str, int], weights: dict[str, float], seats: int) -> Counter:
    """Seat by seat to the highest quotient among the sources that have blocks left."""
    won: Counter = Counter()
    for _ in range(seats):
        best = max((s for s in sizes if won[s] < sizes[s]), key=lambda s: (weights.get(s, 1) / (2 * won[s] + 1), [-ord(c) for c in s]), default=None)
        if best is None:
            break
        won[best] += 1
    return won


def brute(rows, weights, budget, block, shard_docs, seed):
    """rows: (id, source, tokens), the text being that many words."""
    shards = len(rows) // shard_docs + 1
    groups = defaultdict(list)
    for i, source, n in rows:
        o = md5(f"{seed}:{i}:{md5(('w ' * n).encode()).hexdigest()}".encode()).hexdigest()
        groups[int(o[:8], 16) % shards, source].append((o, i, n))
    placed, units = {}, defaultdict(dict)
    for (shard, source), own in groups.items():
        total, begins = 0, []
        for _, i, n in sorted(own):
            placed[i] = shard, source, total // block
            begins.append(total // block)
            total += n
        begins = sorted(set(begins))
        ends = [*begins[1:], max(-(-total // block), begins[-1] + 1)]
        units[shard][source] = {b: e - b for b, e in zip(begins, ends)}
    chosen = set()
    for shard, by in units.items():
        by = {s: u for s, u in by.items() if weights.get(s, 1) > 0}
        sizes = {s: sum(u.values()) for s, u in by.items()}
        for source, q in quotas(sizes, weights, int(sum(sizes.values()) * budget + 0.5)).items():
            filled = 0
            for b in sorted(by[source], key=lambda b: md5(f"{seed}:{shard}:{source}:{b}".encode()).hexdigest()):
                filled += by[source][b]
                if filled - by[source][b] / 2 <= q:
                    chosen.add((shard, source, b))
    return {i: p for i, p in placed.items() if p in chosen}


@pytest.mark.parametrize("weights, budget", [({"s1": 3.0, "s2": 0.5}, 0.4), ({"s0": 0.0}, 0.7), ({}, 1.0), ({"s1": 100.0}, 0.1)])
def test_against_brute_force(spark, weights, budget):
    r = random.Random(4)
    rows = [(i, f"s{min(r.randrange(6), 3)}", r.choice((0, 1, 5, 40, 200))) for i in range(400)]
    df = spark.createDataFrame([(i, "w " * n, s) for i, s, n in rows], "doc_id long, text string, source string")
    got = {x.doc_id: (x.shard, x.source, x.block) for x in M.mix(df, weights, budget, 50, 100, 3).collect()}
    assert got == brute(rows, weights, budget, 50, 100, 3) and got


def test_shares_follow_the_weights_where_there_is_enough(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    n = Counter(x.source for x in M.mix(df, {"s0": 2.0, "s1": 1.0, "s2": 1.0}, 0.5, 100, 10**6, 1).collect())
    assert n["s0"] == 750 and n["s1"] == n["s2"] == 370 or abs(n["s0"] / sum(n.values()) - 0.5) < 0.01


def test_awkward_rows(spark, duck):
    table = docs(spark)
    out = M.mix(table, {}, 1.0)
    assert out.columns == [*table.columns, "_shard", "_block", "_tokens"] and out.count() == table.count()
    assert {r._tokens for r in out.where("text IS NULL").collect()} == {0}
    assert M.mix(table.limit(0)).count() == 0
    assert M.mix(table, {}, 0.0).count() == 0
    assert M.mix(table, {"s1": 0.0}, 1.0).where("source = 's1'").count() == 0


def test_equals_sql_with_many_small_shards(spark, duck, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sql = M.SQL.replace(f"// {M.SHARD_DOCS} ", "// 20 ").replace(f"/ {M.BLOCK_TOKENS}", "/ 500")
    assert_same(M.mix(df, block_tokens=500, shard_docs=20).drop("text"), duck, sql)


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9])
def test_quotas_are_met_where_documents_are_longer_than_blocks(spark, budget):
    df = spark.createDataFrame([(i, "w " * 20_000, "s0") for i in range(40)], "doc_id long, text string, source string")
    assert abs(M.mix(df, {}, budget).count() - 40 * budget) <= 2


def test_rows_without_id_spread_over_the_shards(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i, f"w {i}", "s") for i in range(600)], "doc_id long, text string, source string")
    n = Counter(r.shard for r in M.mix(df, {}, 1.0, shard_docs=60).collect())
    assert len(n) == 11 and max(n.values()) < 90 and sum(n.values()) == 600


def test_tokens_of_scripts_without_blanks_and_of_a_column(spark):
    df = spark.createDataFrame([(1, "東京は大きい city", "s", 70), (2, "กรุงเทพ", "s", None)], "doc_id long, text string, source string, n long")
    assert {r.doc_id: r.tokens for r in M.mix(df, {}, 1.0).collect()} == {1: 7, 2: 7}
    assert {r.doc_id: r.tokens for r in M.mix(df, {}, 1.0, counted="n").collect()} == {1: 70, 2: 0}
