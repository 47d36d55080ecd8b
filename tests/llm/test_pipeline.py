import corpus_pipeline as P
import pytest
from graphloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from graphloom.llm.common import read
from tables import as_set, docs


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What each stage got and gave, written and read again."""
    out, now = [], read(spark, sf_dir, "documents")
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        stage(spark, now, sf_dir).write.parquet(path)
        out.append((name, now, now := spark.read.parquet(path)))
    return out


def test_stages(steps):
    assert [s[0] for s in steps] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert all(set(after.columns) == set(before.columns) for _, before, after in steps[:-1])


def test_each_stage_does_what_its_operator_says(spark, sf_dir, steps):
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    by = {name: (before, after) for name, before, after in steps}
    before, after = by["quality"]
    assert ids(after) == ids(quality.quality(before, read(spark, sf_dir, "labels")).where("keep"))
    before, after = by["line_dedup"]
    want = {r.doc_id: r.text for r in line_dedup.strip_boilerplate(before).where("removed = 0 OR trim(text) <> ''").collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want and after.where("n_chars <> length(text)").count() == 0
    before, after = by["near_dedup"]
    assert ids(after) == ids(before) - ids(simhash.near_duplicates(before).where("doc_id <> group_id"))
    before, after = by["decontamination"]
    assert ids(after) == ids(before) - ids(decontaminate.contamination(before, read(spark, sf_dir, "benchmark")))
    before, after = by["mixing"]
    assert as_set(after.select("doc_id", "block")) == as_set(mixing.mix(before).select("doc_id", "block"))


def test_run_gives_what_the_stages_give(spark, sf_dir, steps):
    assert as_set(P.run(spark, sf_dir).select("doc_id", "text")) == as_set(steps[-1][2].select("doc_id", "text"))


@pytest.mark.parametrize("at", range(5))
def test_awkward_rows(spark, sf_dir, at):
    name, stage = P.STAGES[at]
    table = docs(spark)
    out = stage(spark, table, sf_dir)
    assert out.columns[: len(table.columns)] == table.columns and out.count() <= table.count()
    assert stage(spark, table.limit(0), sf_dir).count() == 0
    twice = stage(spark, table.unionAll(table), sf_dir)
    assert name == "mixing" or twice.count() <= 2 * table.count()
