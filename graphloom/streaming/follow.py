"""Source files that arrive as a stream, kept as an enriched graph.

Each batch makes one version of the graph: files that came replace those of the same path, a null
content removes one, and nodes of files that didn't change keep their roles.  A version is named by its
batch, so a batch that runs again after a failure writes the same version again.  The last ``KEPT``
versions stay.  A batch without changes makes no new graph; otherwise only files that came, and Python
files whose imports mean something else now, are parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import CodeGraph
from ..operators.rules import RULES, Rule
from ..sources.shared import scratch, spool

LANGUAGES = ("css", "html", "python")
KEPT = 3


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(done(f"{path}/{n}/whole/_SUCCESS")))


def latest(spark: SparkSession, path: str) -> CodeGraph | None:
    """The graph as of the last batch."""
    if not (known := _versions(spark, path)):
        return None
    return CodeGraph.load(spark, f"{path}/v{known[-1]}", spark.read.parquet(f"{path}/v{known[-1]}/files"))


def absorb(batch: DataFrame, number: int, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """One batch of (language, path, content) into the version of that number.  Of equal paths in a
    batch the greatest content counts; rows without path or of no known language are left out; where no
    file is left the version is an empty graph."""
    with scratch():
        _absorb(batch, number, path, rules)


def _absorb(batch: DataFrame, number: int, path: str, rules: tuple[Rule, ...]) -> None:
    spark = batch.sparkSession
    came = batch.where(F.col("path").isNotNull() & F.col("language").isin(*LANGUAGES)).groupBy("language", "path").agg(F.max("content").alias("content"))
    before = [v for v in _versions(spark, path) if v < number]
    out = f"{path}/v{number}"
    files = came.where("content IS NOT NULL")
    if before:
        known = spark.read.parquet(f"{path}/v{before[-1]}/files")
        came = spool(came, "came")
        same = came.join(known.withColumnRenamed("content", "had"), ["language", "path"], "left").where(~F.col("content").eqNullSafe(F.col("had")))
        if same.isEmpty():
            return
        files = known.join(came, ["language", "path"], "left_anti").unionByName(came.where("content IS NOT NULL"))
    files.write.mode("overwrite").parquet(f"{out}/files")
    files = spark.read.parquet(f"{out}/files")
    graph = CodeGraph.from_files({k: files.where(F.col("language") == k).select("path", "content") for k in LANGUAGES}, parsed=f"{out}/parsed", before=f"{path}/v{before[-1]}/parsed" if before else None)
    old = CodeGraph.load(spark, f"{path}/v{before[-1]}") if before else None
    (graph.enrich_from(old, rules) if old else graph.enrich(rules)).save(out)
    spark.range(1).write.mode("overwrite").parquet(f"{out}/whole")
    for v in before[: -KEPT + 1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def follow(files: DataFrame, path: str, checkpoint: str, rules: tuple[Rule, ...] = RULES, **trigger) -> StreamingQuery:
    """Keep the graph of a stream of (language, path, content) below path."""
    trigger = trigger or {"availableNow": True}
    return files.writeStream.foreachBatch(lambda batch, number: absorb(batch, number, path, rules)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
