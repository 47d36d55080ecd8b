"""Walks over a graph: dependencies and impact up to a depth, and containment.

A walk is a loop of joins between the frontier and the edges.  Each hop keeps one row per node, so
the frontier never outgrows the nodes; hops are written to the shared folder, so a walk's plan stays
as long as one hop's and lost executors cost no more than a hop.  Edges are read for each hop, not
copied: a graph that was built or loaded has them as a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schema import OWNERSHIP
from ..sources.shared import spool, unspool

#: Edges that the ordered walk may gather on the driver.
ORDERED_EDGES = 1_000_000
#: Nodes within reach up to which edges are chosen by their ids, before they are joined or aggregated.
LISTED = 1_000


def reach(edges: DataFrame, start: str, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth, relation): what is within ``depth`` hops of start, at its least depth; relation is
    the type of the first edge (by seq) that leads there at that depth.  The start itself is in the
    result if a cycle leads back to it."""
    here, there = ("target", "source") if reverse else ("source", "target")
    own = edges.select(F.col(here).alias("here"), F.col(there).alias("there"), "type", "seq").where("there IS NOT NULL")
    hops: list[DataFrame] = []
    for k in range(1, depth + 1):
        met = own.where(F.col("here") == start) if k == 1 else own.join(hops[-1].select(F.col("id").alias("here")), "here")
        hop = met.groupBy(F.col("there").alias("id")).agg(F.min_by(F.struct("type", "seq"), "seq").alias("first")).select("id", F.lit(k).alias("depth"), F.col("first.type").alias("relation"))
        if hops:
            hop = hop.join(reduce(DataFrame.unionAll, hops).select("id"), "id", "left_anti")
        if depth > 1:
            hop = spool(hop, "hop")
            if hop.isEmpty():
                unspool(hop)
                break
        hops.append(hop)
    if not hops:
        return edges.sparkSession.createDataFrame([], "id string, depth int, relation string")
    return reduce(DataFrame.unionAll, hops)


def _typed(found: DataFrame, nodes: DataFrame) -> DataFrame:
    kinds = nodes.select("id", "node_type")
    return found.join(kinds, "id", "left").select("id", "depth", "relation", F.coalesce("node_type", F.lit("Unknown")).alias("node_type"))


def dependencies(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """What start uses, up to ``depth`` hops away."""
    return _typed(reach(edges, start, depth), nodes)


def impact(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """What uses start."""
    return _typed(reach(edges, start, depth, reverse=True), nodes)


def ordered_walk(edges: list[tuple[str, str, str]], start: str, depth: int) -> dict[str, tuple[int, str]]:
    """The historical depth-first walk over (source, target, type) in the graph's order: a node that
    was expanded once is not expanded again, even if it was met at the limit, and what is found
    deeper overwrites what was found before."""
    out_of: dict[str, list[tuple[str, str]]] = {}
    for source, target, kind in edges:
        out_of.setdefault(source, []).append((target, kind))
    expanded: set[str] = set()

    def expand(node: str, level: int) -> dict[str, tuple[int, str]]:
        if level >= depth or node in expanded:
            return {}
        expanded.add(node)
        found: dict[str, tuple[int, str]] = {}
        for target, kind in out_of.get(node, ()):
            if target not in found:
                found[target] = level + 1, kind
                found |= expand(target, level + 1)
        return found

    return expand(start, 0)


def reach_ordered(nodes: DataFrame, edges: DataFrame, start: str, depth: int, reverse: bool = False) -> DataFrame:
    """dependencies() or impact() as the order-dependent walk gives them.  It runs on the driver over
    the edges that leave what is within reach, ORDERED_EDGES at most."""
    here, there = ("target", "source") if reverse else ("source", "target")
    near = reach(edges, start, max(depth - 1, 0), reverse).select(F.col("id").alias("near"))
    near = near.unionAll(edges.sparkSession.createDataFrame([(start,)], "near string")).distinct()
    listed = [r.near for r in near.limit(LISTED + 1).collect()]
    own = edges.where(F.col(here).isin(listed)) if len(listed) <= LISTED else edges.join(near, F.col(here) == F.col("near"), "left_semi")
    own = own.where(F.col(there).isNotNull())
    rows = own.orderBy("seq").select(here, there, "type").limit(ORDERED_EDGES + 1).collect()
    if len(rows) > ORDERED_EDGES:
        raise ValueError(f"over {ORDERED_EDGES} edges are within reach; use the breadth-first walk")
    found = ordered_walk([tuple(r) for r in rows], start, depth)
    out = edges.sparkSession.createDataFrame([(k, d, t) for k, (d, t) in found.items()], "id string, depth int, relation string")
    return _typed(out, nodes)


def containment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, owner): the file that a node belongs to along edges of ownership.  Of several owners the
    nearest counts, then the first by (seq of the owner's file, owner); nodes that no file reaches
    have no row.  It ends when a level owns nothing new, however deep the nesting."""
    step = edges.where(F.col("type").isin(*OWNERSHIP)).select(F.col("source").alias("here"), F.col("target").alias("there"))
    files = nodes.where("node_type = 'File'").groupBy("id").agg(F.min("seq").alias("rank")).select("id", F.col("id").alias("owner"), "rank")
    found = frontier = spool(files, "owners")
    while True:
        met = step.join(frontier, F.col("here") == F.col("id")).groupBy("there").agg(F.min(F.struct("rank", "owner")).alias("first"))
        frontier = spool(met.select(F.col("there").alias("id"), "first.owner", "first.rank").join(found.select("id"), "id", "left_anti"), "owners")
        if frontier.isEmpty():
            unspool(frontier)
            return found.select("id", "owner")
        found = found.unionAll(frontier)
