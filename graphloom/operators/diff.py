"""What changed between two graphs, and what that means for enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .traverse import containment


def file_status(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, status) of file nodes: ADDED, REMOVED, UNCHANGED for equal hashes, else MODIFIED; so is a
    file whose hash is missing."""
    left, right = (df.where("node_type = 'File'").groupBy("id").agg(F.max("hash").alias(h)) for df, h in ((new, "new_hash"), (old, "old_hash")))
    both = left.withColumn("in_new", F.lit(True)).join(right.withColumn("in_old", F.lit(True)), "id", "full_outer")
    return both.select("id", _status(F.col("in_new").isNotNull(), F.col("in_old").isNotNull(), F.col("new_hash") == F.col("old_hash")).alias("status"))


def _status(in_new: Column, in_old: Column, same: Column) -> Column:
    return F.when(~in_old, "ADDED").when(~in_new, "REMOVED").when(F.coalesce(same, F.lit(False)), "UNCHANGED").otherwise("MODIFIED")


def node_status(new: DataFrame, old: DataFrame, new_edges: DataFrame, compat: bool = False) -> DataFrame:
    """(id, status) of all nodes.  A node that is in both graphs has the status of the file that owns it
    (a new file makes it MODIFIED); one that no file owns is MODIFIED.  compat: if it is not the same in
    both, it has no status (null)."""
    owners = containment(new, new_edges)
    files = file_status(new, old).select(F.col("id").alias("owner"), F.col("status").alias("owner_status"))
    left, right = new.select("id").distinct().withColumn("in_new", F.lit(True)), old.select("id").distinct().withColumn("in_old", F.lit(True))
    both = left.join(right, "id", "full_outer").join(owners, "id", "left").join(files, "owner", "left")
    loose = F.lit("MODIFIED")
    if compat:
        common = [c for c in new.columns if c in old.columns and c not in ("id", "seq")]
        image = F.to_json(F.struct(*common))
        same = new.select("id", image.alias("x")).intersect(old.select("id", image.alias("x"))).select("id", F.lit(True).alias("same"))
        both, loose = both.join(same, "id", "left"), F.when(F.col("same"), "MODIFIED")
    owned = F.when(F.col("owner_status") == "UNCHANGED", "UNCHANGED").when(F.col("owner_status").isin("ADDED", "MODIFIED"), "MODIFIED").otherwise(loose)
    return both.select("id", F.when(F.col("in_new").isNull(), "REMOVED").when(F.col("in_old").isNull(), "ADDED").otherwise(owned).alias("status"))


def first_run(new: DataFrame) -> DataFrame:
    """Node statuses where there is no graph to compare with."""
    return new.select("id", F.lit("ADDED").alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.where("status IS NOT NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def partition(raw: DataFrame, status: DataFrame, old: DataFrame) -> DataFrame:
    """(id, action): preserve a node that is UNCHANGED and in the old graph, enrich all others."""
    known = old.select("id").distinct().withColumn("known", F.lit(True))
    met = raw.select("id").distinct().join(status, "id", "left").join(known, "id", "left")
    keep = (F.coalesce("status", F.lit("MODIFIED")) == "UNCHANGED") & F.col("known").isNotNull()
    return met.select("id", F.when(keep, "preserve").otherwise("enrich").alias("action"))


def incremental(raw: DataFrame, status: DataFrame, old: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, semantic_roles, action): old roles of the preserved nodes, new ones (id, semantic_roles) of
    the others; preserved rows come from the old graph."""
    acted = partition(raw, status, old)
    before = old.select("id", F.col("semantic_roles").alias("old_roles"))
    after = roles.select("id", F.col("semantic_roles").alias("new_roles"))
    both = acted.join(before, "id", "left").join(after, "id", "left")
    chosen = F.when(F.col("action") == "preserve", F.col("old_roles")).otherwise(F.col("new_roles"))
    return both.select("id", F.coalesce(chosen, F.array().cast("array<string>")).alias("semantic_roles"), "action")


def enrichment_counts(done: DataFrame) -> DataFrame:
    """preserved, enriched and roles_applied (roles of the enriched) of what incremental() gives."""
    new = F.col("action") == "enrich"
    return done.agg(F.count_if(~new).alias("preserved"), F.count_if(new).alias("enriched"), F.coalesce(F.sum(F.when(new, F.size("semantic_roles"))), F.lit(0)).cast("long").alias("roles_applied"))
