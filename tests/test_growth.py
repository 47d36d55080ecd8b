"""What a task holds doesn't grow with the input."""

from graphloom.operators import validate
from graphloom.sources import shared


def test_compared_edges_spread_with_their_input(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "edges")
    spark.range(5000).selectExpr("id AS seq", "'a' || id AS source", "'b' || id % 7 AS target", "'calls' AS type").write.parquet(at)
    edges = spark.read.parquet(at)
    n_bytes = sum(p.stat().st_size for p in (tmp_path / "edges").glob("*.parquet"))
    monkeypatch.setattr(shared, "SPREAD_BYTES", n_bytes // 20)
    found = validate.edge_changes(edges, edges.where("seq <> 3"))
    assert found.rdd.getNumPartitions() >= 40 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tuple(r) for r in found.collect()] == [("edge_removed", "a3 calls b3")]


def test_tags_come_in_small_batches(spark):
    import pyarrow as pa

    from graphloom.operators import extract_html

    class Files:
        select = where = lambda self, *columns: self
        mapInArrow = lambda self, run, ddl: run

    run = extract_html.tags(Files())
    pages = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(["<a href='x'>" * n for n in (12_000, 0, 13_000)])], ["path", "content"])
    sizes = [b.num_rows for b in run(iter([pages]))]
    assert sum(sizes) == 25_000 and max(sizes) <= 10_000


def test_ordered_walk_chooses_edges_by_id(spark, monkeypatch):
    from graphloom.operators import traverse

    rows = [(i, s, t, "calls") for i, (s, t) in enumerate([("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("X", "A"), (None, "A")])]
    edges = spark.createDataFrame(rows, "seq long, source string, target string, type string")
    nodes, real, kinds = spark.createDataFrame([(x, "F") for x in "ABCD"], "id string, node_type string"), type(edges).join, []
    monkeypatch.setattr(type(edges), "join", lambda self, other, on=None, how=None: kinds.append(how) or real(self, other, on, how))
    by_id = sorted(map(tuple, traverse.reach_ordered(nodes, edges, "A", 2).collect()))
    assert "left_semi" not in kinds and by_id == [("B", 1, "calls", "F"), ("C", 2, "calls", "F")]
    monkeypatch.setattr(traverse, "LISTED", 0)
    assert sorted(map(tuple, traverse.reach_ordered(nodes, edges, "A", 2).collect())) == by_id and "left_semi" in kinds
