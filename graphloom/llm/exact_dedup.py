"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive runs of UTF-8 bytes, most significant first.  Each level gives
its groups numbers of their own, so its key is the number of the group above and the next bytes:
groups that come down to one document drop out, groups whose text has ended are duplicates, the
others go one level down.  Bytes themselves are compared; no digest is involved.  A level's counts
are aggregated on the map side, and where one group holds much of the rows the join with its number
is split by Spark's handling of skew, as the side of the groups has one row for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import need, read, spool, unspool

#: Bytes of the first level; each level reads GROWTH times as many as the one before.
FIRST, GROWTH = 256, 4


def exact_duplicates(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(doc_id, group_id) for every row whose text occurs more than once; group_id is the smallest
    doc_id of those that have that text.

    Rows without doc_id or text belong to no group; empty texts are equal to each other; a row
    that is there twice is a group of its two rows; other columns are ignored; an empty table
    gives no rows.  A doc_id in several rows with other texts is in the group of each of them (and two
    groups of which it is the smallest have the same group_id).  No length of text and no size of
    group is treated apart.
    """
    rest = F.encode("text", "UTF-8")
    level = need(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lit(0).cast("long").alias("part"), rest.alias("rest"))
    width, done, before = first, [], None
    while True:
        keyed = level.select("doc_id", "part", F.substring("rest", 1, width).alias("run"), "rest")
        groups = keyed.groupBy("part", "run").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        groups = spool(groups.withColumn("number", F.monotonically_increasing_id()), "radix-groups")
        split = keyed.join(groups, ["part", "run"]).select("doc_id", "group_id", F.col("number").alias("part"), F.expr(f"substring(rest, {width + 1}, length(rest))").alias("rest"), (F.length("run") < width).alias("ended"))
        split = spool(split, "radix")
        unspool(groups)
        if before is not None:
            unspool(before)
        done.append(spool(split.where("ended").select("doc_id", "group_id"), "radix-done"))
        level, before = split.where("NOT ended").select("doc_id", "part", "rest"), split
        if level.isEmpty():
            unspool(before)
            break
        width *= growth
    return reduce(DataFrame.unionAll, done)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_duplicates() of all documents."""
    return exact_duplicates(read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, group_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
) WHERE n > 1
"""
