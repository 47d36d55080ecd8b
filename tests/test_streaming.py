"""A stream of files against the graph that is built from all of them at once."""

from graphloom.graph import CodeGraph
from graphloom.streaming.follow import absorb, follow, latest

DDL = "language string, path string, content string"
A, B = "class Base:\n    pass\n", "from a import Base\n\n\nclass Child(Base):\n    pass\n"


def test_batches_replace_and_remove_files(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "graph")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(DDL).parquet(source)
    for rows in ([("python", "a.py", A), ("python", "s.py", "x = 1")], [("python", "b.py", B), ("python", "s.py", None), (None, "lost", "x")]):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(source)
        follow(stream, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    got = latest(spark, out)
    files = spark.createDataFrame([("a.py", A), ("b.py", B)], "path string, content string")
    want = CodeGraph.from_files({"python": files})
    assert {r.id for r in got.nodes.collect()} == {r.id for r in want.nodes.collect()}
    ends = lambda g: {(r.source, r.target, r.type) for r in g.edges.collect()}
    assert ends(got) == ends(want) and ("b.py::Child", "a.py::Base", "extends") in ends(got)
    absorb(spark.createDataFrame([("python", "b.py", B), ("python", "s.py", None)], DDL), 1, out)  # a batch that runs again
    assert ends(latest(spark, out)) == ends(want)
