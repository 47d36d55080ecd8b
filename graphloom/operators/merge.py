"""Fragments of a graph, one per language, merged into one graph with canonical ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import first_filled

#: Edge columns that aren't carried as properties.
_KEYS = ("edge", "from", "to", "type", "source", "target")


def union(fragments: list[DataFrame]) -> DataFrame:
    """All rows of the fragments; ``fragment`` is the place in the list; missing columns are null."""
    ranked = [f.withColumn("fragment", F.lit(i)) for i, f in enumerate(fragments)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def canonical_id(nodes: DataFrame) -> Column:
    """File:path for files; an id that holds :: as it is; type:path::name where there is a path; else
    type:name."""
    kind, name, path = F.coalesce("node_type", F.lit("Unknown")), F.coalesce("name", F.lit("Unnamed")), F.nullif("file_path", F.lit(""))
    return (
        F.when(path.isNotNull() & (kind == "File"), F.concat(F.lit("File:"), path))
        .when(F.col("id").contains("::"), F.col("id"))
        .when(path.isNotNull(), F.concat(kind, F.lit(":"), path, F.lit("::"), name))
        .otherwise(F.concat(kind, F.lit(":"), name))
    )


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per canonical id: the last one's values, the first one's place (seq)."""
    own = nodes.withColumns({"raw_id": F.col("id"), "node_type": F.coalesce("node_type", F.lit("Unknown"))})
    own = own.withColumn("id", canonical_id(nodes))
    last = Window.partitionBy("id").orderBy(F.desc("fragment"), F.desc("seq"))
    every = Window.partitionBy("id")
    own = own.withColumns({"nth": F.row_number().over(last), "place": F.min(F.struct("fragment", "seq")).over(every)})
    return own.where("nth = 1").withColumns({"fragment": F.col("place.fragment"), "seq": F.col("place.seq")}).drop("nth", "place", "raw_id")


def aliases(nodes: DataFrame, compat: bool = False) -> DataFrame:
    """(fragment, alias, id): what the fragments' edges call a node.  An alias is a raw id within its
    own fragment.  compat: names are aliases too, all fragments share them (fragment is null) and the
    last writer wins, a node's raw id coming after its name."""
    own = nodes.select("fragment", "seq", "name", F.col("id").alias("raw"), canonical_id(nodes).alias("id"))
    by_id = own.where("raw <> ''").select("fragment", "seq", F.lit(1).alias("slot"), F.col("raw").alias("alias"), "id")
    if not compat:
        return by_id.groupBy("fragment", "alias").agg(F.max_by("id", "seq").alias("id"))
    by_name = own.select("fragment", "seq", F.lit(0).alias("slot"), F.coalesce("name", F.lit("Unnamed")).alias("alias"), "id")
    return by_name.unionAll(by_id).groupBy("alias").agg(F.max_by("id", F.struct("fragment", "seq", "slot")).alias("id")).select(F.lit(None).cast("int").alias("fragment"), "alias", "id")


def merge_edges(edges: DataFrame, known: DataFrame, compat: bool = False) -> DataFrame:
    """Edges (fragment, seq, edge, from, to, ...) between canonical ids; an end without an alias stays
    as it is.  Of equal (type, source, target) the first one stays, with its properties."""
    out = edges
    for raw, name in (("from", "source"), ("to", "target")):
        side = known.select(F.col("fragment").alias("of"), F.col("alias").alias(f"raw_{name}"), F.col("id").alias(f"id_{name}"))
        on = F.col(f"`{raw}`") == F.col(f"raw_{name}")
        out = out.join(side, on if compat else on & (F.col("fragment") == F.col("of")), "left").withColumn(name, F.coalesce(f"id_{name}", F.col(f"`{raw}`"))).drop("of", f"raw_{name}", f"id_{name}")
    kind = first_filled("edge", "type") if "type" in edges.columns else F.col("edge")
    more = [c for c in edges.columns if c not in (*_KEYS, "fragment", "seq")]
    out = out.select("fragment", "seq", "source", "target", kind.alias("type"), *more)
    first = Window.partitionBy("type", "source", "target").orderBy("fragment", "seq")
    return out.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def merge(nodes: list[DataFrame], edges: list[DataFrame], ambiguities: list[DataFrame], compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ambiguities) of all fragments; (fragment, seq) is the order."""
    every = union(nodes)
    return merge_nodes(every), merge_edges(union(edges), aliases(every, compat), compat), union(ambiguities)
