"""Questions about a graph: search, locate, read, call graph, statistics, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_filled, last_part
from ..sources.files import file_lines

#: Fields that key:value may name.
FIELDS = ("id", "node_type", "name", "file_path", "hash", "line_start", "line_end", "docstring", "is_async", "analysis_confidence")
LIMIT = 50


def attribute_query(query: str) -> tuple[str, str] | None:
    """(key, value) of a query key:value; None for one that is plain text or has a ::."""
    if ":" not in query or "::" in query:
        return None
    key, _, value = query.lower().partition(":")
    return key, value


def in_attributes(key: str, value: str) -> Column:
    return F.coalesce(F.lower(F.col("attributes")[key]), F.lit("")) == value if value == "" else F.coalesce(F.lower(F.col("attributes")[key]) == value, F.lit(False))


def in_decorators(value: str) -> Column:
    return F.coalesce(F.exists("signature.decorators", lambda d: F.lower(d).contains(value)), F.lit(False))


def in_field(key: str, value: str) -> Column:
    return F.coalesce(F.lower(F.col(key).cast("string")), F.lit("")) == value if key in FIELDS else F.lit(value == "")


def search(nodes: DataFrame, query: str, node_type: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Nodes whose name or id contains the query, or that have key:value as an attribute, decorator
    (keys decorator and @) or field; the first ones in the graph's order."""
    asked = attribute_query(query)
    if asked:
        key, value = asked
        hit = in_field(key, value)
        if "attributes" in nodes.columns:
            hit = hit | in_attributes(key, value)
        if key in ("decorator", "@") and "signature" in nodes.columns:
            hit = hit | in_decorators(value)
    else:
        hit = F.coalesce(F.lower("name").contains(query.lower()), F.lit(False)) | F.lower("id").contains(query.lower())
    if node_type:
        hit = hit & (F.lower("node_type") == node_type.lower())
    found = nodes.where(hit)
    return found.orderBy("seq").limit(limit) if limit else found


def details(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node with that id, the first one if there are several; no row if there is none."""
    return nodes.where(F.col("id") == node_id).orderBy("seq").limit(1)


def locate(nodes: DataFrame, node_id: str) -> DataFrame:
    return details(nodes, node_id).select("id", F.coalesce("file_path", F.lit("N/A")).alias("file"), "line_start", "line_end", "docstring")


def read_content(nodes: DataFrame, files: DataFrame, node_id: str) -> DataFrame:
    """(id, path, mode, label, content, error): the lines of the node, the whole file for a node
    without lines.  The path is the node's, else what stands before :: in its id."""
    path = F.coalesce("file_path", F.when(F.col("id").contains("::"), F.regexp_replace(F.substring_index("id", "::", 1), "^File:", "")))
    node = details(nodes, node_id).select("id", path.alias("path"), "line_start", "line_end")
    lines = file_lines(files).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    # Only the node's own file is split into lines.
    wanted = lines.join(F.broadcast(node.select("path")), "path", "left_semi")
    first, last, n = F.coalesce("line_start", F.lit(1)), F.coalesce("line_end", F.size("lines")), F.size("lines")
    full = F.col("line_start").isNull()
    error = F.when(F.col("path").isNull(), "No file path for node").when(F.col("lines").isNull(), "File not found").when(~full & (F.col("line_start") > n), "Start line is beyond the end")
    body = F.when(full, F.array_join("lines", "\n")).otherwise(F.array_join(F.slice("lines", first, F.greatest(F.least(last, n) - first + 1, F.lit(0))), "\n"))
    label = F.when(full, "full").otherwise(F.concat(F.col("line_start").cast("string"), F.lit("-"), F.coalesce(F.col("line_end").cast("string"), F.lit("None"))))
    return node.join(wanted, "path", "left").select("id", "path", F.when(full, "full_file").otherwise("lines").alias("mode"), label.alias("label"), F.when(error.isNull(), body).alias("content"), error.alias("error"))


def normalize_edges(edges: DataFrame) -> DataFrame:
    """source, target and type, whatever an edge calls them (an empty value counts as none); other
    columns stay."""
    names = {"source": ("source", "from"), "target": ("target", "to"), "type": ("type", "relation_type", "edge")}
    out, used = {}, set()
    for name, ways in names.items():
        there = [w for w in ways if w in edges.columns]
        used.update(there)
        out[name] = first_filled(*(F.col(f"`{w}`") for w in there)) if len(there) > 1 else F.col(f"`{there[0]}`") if there else F.lit(None).cast("string")
    return edges.select(*(c.alias(n) for n, c in out.items()), *(c for c in edges.columns if c not in used))


def _calls(nodes: DataFrame, edges: DataFrame, node_id: str, this: str, other: str, name: str) -> DataFrame:
    found = edges.where((F.col("type") == "calls") & (F.col(this) == node_id)).select("seq", F.col(other).alias(name), "call_line")
    node = nodes.select(F.col("id").alias(name), F.col("name").alias("known"), F.col("node_type").alias("kind"))
    return found.join(node, name, "left").select("seq", name, F.coalesce("known", last_part(name, "::")).alias(f"{name}_name"), F.coalesce("kind", F.lit("Unknown")).alias(f"{name}_type"), "call_line")


def calls_out(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """What a node calls, with names, types and lines."""
    return _calls(nodes, edges, node_id, "source", "target", "target").drop("seq")


def calls_in(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """What calls a node."""
    return _calls(nodes, edges, node_id, "target", "source", "source").withColumnsRenamed({"source": "caller", "source_name": "caller_name", "source_type": "caller_type"}).drop("seq")


def call_graph(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Both directions in one table: direction, node, name, node_type, call_line."""
    out = calls_out(nodes, edges, node_id).toDF("node", "name", "node_type", "call_line").select(F.lit("outgoing").alias("direction"), "*")
    into = calls_in(nodes, edges, node_id).toDF("node", "name", "node_type", "call_line").select(F.lit("incoming").alias("direction"), "*")
    return out.unionAll(into)


def call_graph_summary(edges: DataFrame, node_id: str) -> DataFrame:
    own = edges.where(F.col("type") == "calls")
    return own.agg(F.count_if(F.col("source") == node_id).alias("outgoing_count"), F.count_if(F.col("target") == node_id).alias("incoming_count")).select(F.lit(node_id).alias("node_id"), "outgoing_count", "incoming_count")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def stats_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def list_files(nodes: DataFrame, compat: bool = True) -> DataFrame:
    """Distinct files of the nodes, sorted; unless compat, also templates, stylesheets and files that
    only an id names."""
    path = F.col("file_path")
    if not compat:
        named = F.when(F.col("node_type").isin("Template", "Stylesheet"), F.col("name")).when(F.col("id").contains("::"), F.substring_index("id", "::", 1))
        path = F.coalesce(F.nullif(path, F.lit("")), named)
    return nodes.select(path.alias("file_path")).where("file_path <> ''").distinct().orderBy("file_path")


def coverage_sets(nodes: DataFrame, edges: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """(aspect, value): the node types, edge types and kinds of ambiguities that occur."""
    parts = ((nodes, "node_type", "node"), (edges, "type", "edge"), (ambiguities, "kind", "ambiguity"))
    out = [df.select(F.lit(a).alias("aspect"), F.col(c).alias("value")).distinct() for df, c, a in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


def coverage_missing(found: DataFrame, expected: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Expected (aspect, value) that don't occur; accepted (value, kind): ambiguities of that kind
    stand for an edge."""
    missing = expected.select("aspect", "value").subtract(found.select("aspect", "value"))
    if accepted is not None:
        excused = accepted.join(found.where("aspect = 'ambiguity'").select(F.col("value").alias("kind")), "kind", "left_semi").select(F.lit("edge").alias("aspect"), "value")
        missing = missing.join(excused, ["aspect", "value"], "left_anti")
    return missing
