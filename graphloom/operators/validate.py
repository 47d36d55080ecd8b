"""Checks of graphs: shape, vocabulary, allowed edges, equality of structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import CONFIDENCES, EDGE_RULES, NODE_TYPES, edge_rules
from ..sources.shared import spread


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, with which one: side is source or target (source first)."""
    ids = nodes.select("id").distinct()
    no_source = edges.join(ids, edges["source"] == ids["id"], "left_anti").withColumn("side", F.lit("source"))
    with_source = edges.join(ids, edges["source"] == ids["id"], "left_semi")
    return no_source.unionByName(with_source.join(ids, with_source["target"] == ids["id"], "left_anti").withColumn("side", F.lit("target")))


def _typed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.groupBy("id").agg(F.max_by("node_type", "seq").alias("node_type"))
    left, right = kinds.toDF("source", "source_type"), kinds.toDF("target", "target_type")
    return edges.join(left, "source").join(right, "target")


def schema_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes that the schema doesn't allow."""
    typed = _typed(nodes, edges)
    rules = F.broadcast(edge_rules(edges.sparkSession).toDF("type", "source_type", "target_type"))
    return typed.join(rules, ["type", "source_type", "target_type"], "left_anti").select("source", "target", "type", "source_type", "target_type")


def _found(df: DataFrame, *checks: tuple[str, str, Column, Column]) -> DataFrame:
    """(severity, issue, subject) for each check (issue, severity, whether a row has it, subject), in one
    pass over df."""
    issues = F.filter(F.array(*(F.when(wrong, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), subject.alias("subject"))) for issue, severity, wrong, subject in checks)), lambda x: x.isNotNull())
    return df.select(F.explode(issues).alias("i")).select("i.*")


def _ends(side: int) -> Column:
    """Edge type -> the node types it may leave (0) or reach (1)."""
    return F.create_map(*(x for e, ends in EDGE_RULES.items() for x in (F.lit(e), F.array(*map(F.lit, ends[side])))))


def validate(nodes: DataFrame, edges: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """(severity, issue, subject): everything wrong with a graph.  One row for each wrong node, edge,
    end of an edge or ambiguity.  Nodes and ambiguities are read once for it, edges are joined once
    with the types of their ends."""
    subject = F.concat_ws(" ", *(F.coalesce(c, F.lit("?")) for c in ("source", "type", "target")))
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    named, typed = ~missing("id"), ~missing("node_type")
    kinds = nodes.where(named & typed).groupBy("id").agg(F.coalesce(F.max_by("node_type", "seq"), F.max("node_type")).alias("kind"))
    met = edges.select("source", "target", "type").join(kinds.toDF("source", "source_type"), "source", "left").join(kinds.toDF("target", "target_type"), "target", "left")
    whole = ~missing("type") & ~missing("source") & ~missing("target")
    known = whole & F.col("type").isin(*EDGE_RULES)
    both = known & F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    required = missing("id") | F.col("kind").isNull() | F.col("reason").isNull() | F.col("confidence").isNull()
    return (
        _found(
            nodes,
            ("missing node id", "error", ~named, F.coalesce("name", F.lit("?"))),
            ("missing node type", "error", named & ~typed, F.col("id")),
            ("unknown node type", "error", named & typed & ~F.col("node_type").isin(*NODE_TYPES), F.col("id")),
        )
        .unionAll(
            _found(
                met,
                ("malformed edge", "error", ~whole, subject),
                ("unknown edge type", "error", whole & ~F.col("type").isin(*EDGE_RULES), subject),
                ("orphan source", "error", known & F.col("source_type").isNull(), subject),
                ("orphan target", "error", known & F.col("source_type").isNotNull() & F.col("target_type").isNull(), subject),
                ("source type not allowed", "error", both & ~F.array_contains(_ends(0)[F.col("type")], F.col("source_type")), subject),
                ("target type not allowed", "error", both & ~F.array_contains(_ends(1)[F.col("type")], F.col("target_type")), subject),
            )
        )
        .unionAll(_found(ambiguities, ("malformed ambiguity", "error", required, F.coalesce("id", F.lit("?"))), ("unusual confidence", "warning", ~required & ~F.col("confidence").isin(*CONFIDENCES), F.col("id"))))
    )


def counts(nodes: DataFrame, edges: DataFrame, ambiguities: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, ambiguity_count, errors, status."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    errors = problems.agg(F.count_if(F.col("severity") == "error").alias("errors"))
    out = n(nodes, "node_count").crossJoin(n(edges, "edge_count")).crossJoin(n(ambiguities, "ambiguity_count")).crossJoin(errors)
    return out.withColumn("status", F.when(F.col("errors") > 0, "fail").otherwise("pass"))


def node_changes(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """(violation, detail): nodes that enrichment lost, invented or gave another type, by one aggregation
    over both graphs."""
    kind = F.coalesce("node_type", F.lit("\0"))
    both = raw.select("id", kind.alias("before"), F.lit(None).cast("string").alias("after")).unionAll(enriched.select("id", F.lit(None).cast("string"), kind))
    seen = both.groupBy("id").agg(*(f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("least", F.min), ("most", F.max))))
    same = (F.col("least_before") == F.col("most_before")) & (F.col("least_after") == F.col("most_after")) & (F.col("least_before") == F.col("least_after"))
    violation = F.when(F.col("least_after").isNull(), "node_removed").when(F.col("least_before").isNull(), "node_added").when(~same, "node_type_changed")
    return seen.select(violation.alias("violation"), F.col("id").alias("detail")).where("violation IS NOT NULL AND detail IS NOT NULL")


def edge_changes(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """(violation, detail): edges that only one of two graphs has, by one aggregation over both."""
    both = _keys(raw).withColumn("side", F.lit(0)).unionAll(_keys(enriched).withColumn("side", F.lit(1)))
    # Hardly any rows are equal on one side, so they meet first and are aggregated once.
    seen = spread(both, "source", "target", "type").groupBy("source", "target", "type").agg(F.min("side").alias("first"), F.max("side").alias("last")).where("first = last")
    return seen.select(F.when(F.col("first") == 0, "edge_removed").otherwise("edge_added").alias("violation"), F.concat_ws(" ", "source", "type", "target").alias("detail"))


def _keys(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "type")


def edges_removed(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    return _keys(raw).subtract(_keys(enriched))


def edges_added(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    return _keys(enriched).subtract(_keys(raw))


def equivalence(raw: tuple[DataFrame, DataFrame, DataFrame], enriched: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(violation, detail) of two graphs (nodes, edges, ambiguities) that should have one structure:
    no row if they have.  Edges are compared as sets."""
    counted = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((raw[0], "n0"), (enriched[0], "n1"), (raw[2], "a0"), (enriched[2], "a1"))]
    line = counted[0].crossJoin(counted[1]).crossJoin(counted[2]).crossJoin(counted[3])
    sizes = F.array(*(F.when(F.col(a) != F.col(b), F.struct(F.lit(name).alias("violation"), F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")).alias("detail"))) for a, b, name in (("n0", "n1", "node_count"), ("a0", "a1", "ambiguity_count"))))
    counts = line.select(F.explode(F.filter(sizes, lambda x: x.isNotNull())).alias("v")).select("v.*")
    return counts.unionAll(node_changes(raw[0], enriched[0])).unionAll(edge_changes(raw[1], enriched[1]))


def first_violations(violations: DataFrame, n: int = 5) -> DataFrame:
    """The first ones, for a log."""
    return violations.orderBy("violation", "detail").limit(n)
