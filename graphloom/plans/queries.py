"""The registered queries over the derived graph, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import layer, relative_module_column
from ..operators import diff, extract_css, extract_html, extract_python, file_profile, merge, overlay, query, rules, traverse, validate
from ..schema import EDGE_RULES, NODE_TYPES, TRIPLES
from ..sources.files import file_lines, scan_files
from . import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _with(**ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " "


_G = _with(nodes=D.NODES, edges=D.EDGES)
_GA = _with(nodes=D.NODES, edges=D.EDGES, ambs=D.AMBIGUITIES)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- questions -----------------------------------------------------------------------------

_SHOWN = ("id", "node_type", "name")


def _search(name: str, q: str, where: str, node_type: str | None = None, limit: int | None = 50) -> None:
    @register(name, _G + f"SELECT id, node_type, name FROM nodes WHERE {where} ORDER BY seq" + (f" LIMIT {limit}" if limit else ""))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.search(D.nodes(spark, sf_dir), q, node_type, limit).select(*_SHOWN)


_search("search_text", "ia", "contains(lower(name), 'ia') OR contains(lower(id), 'ia')")
_search("search_typed", "1", "(contains(lower(name), '1') OR contains(lower(id), '1')) AND lower(node_type) = 'function'", "function")
_search("search_attr", "pseudo_state:HOVER", "state = 'hover'")
_search("search_attr_map", "tag:Brand#11", "tag = 'brand#11'", limit=None)
_search("search_decorator", "decorator:login", "contains(lower(decorator), 'login')", limit=None)
_search("search_prop", "is_async:true", "CAST(is_async AS VARCHAR) = 'true'", limit=None)


@register("details", _G + "SELECT id, node_type, name, file_path, hash, line_start, line_end, docstring, is_async FROM nodes WHERE id = 'nation:7'")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.details(D.nodes(spark, sf_dir), "nation:7").select("id", "node_type", "name", "file_path", "hash", "line_start", "line_end", "docstring", "is_async")


@register("locate", _G + "SELECT id, coalesce(file_path, 'N/A') AS file, line_start, line_end, docstring FROM nodes WHERE id = 'nation:7'")
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.locate(D.nodes(spark, sf_dir), "nation:7")


@register("read_snippet", "SELECT 'doc:1' AS id, 'docs/1' AS path, 'lines' AS mode, '2-3' AS label, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS content, CASE WHEN len(string_split(text, chr(10))) < 2 THEN 'Start line is beyond the end' END AS error FROM documents WHERE doc_id = 1")
def read_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "SELECT 'docs/' || CAST(doc_id AS STRING) AS path, text AS content, doc_id FROM documents")
    nodes = docs.select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("path").alias("file_path"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))
    return query.read_content(nodes, docs, "doc:1")


@register("file_lines", "SELECT doc_id, CAST(i AS INT) AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_lines(D.table(spark, sf_dir, "SELECT doc_id AS path, text AS content FROM documents")).withColumnRenamed("path", "doc_id")


@register("content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import content_hash as hashed

    return D.table(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", hashed("text").alias("hash"))


@register("scan_files")
def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_files(spark, sf_dir, "*.parquet", content=False)


@register("load_graph", _G + "SELECT id, node_type, name FROM nodes")
def load_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph, written to the shared folder and loaded as a saved one."""
    from ..graph import CodeGraph
    from ..sources.shared import shared_dir

    path = f"{shared_dir(spark)}/graphloom/graph-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    CodeGraph(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), D.ambiguities(spark, sf_dir)).save(path)
    return CodeGraph.load(spark, path).nodes.select(*_SHOWN)


@register("edge_normalize", _with(fe=D.FRAGMENT_EDGES) + "SELECT from_id AS source, to_id AS target, edge AS type, call_line FROM fe")
def edge_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = D.table(spark, sf_dir, D.FRAGMENT_EDGES).select(F.lit("").alias("source"), F.col("from_id").alias("from"), F.col("to_id").alias("to"), "edge", "call_line")
    return query.normalize_edges(raw)


def _walk(start: str, depth: int, here: str, there: str) -> str:
    return _G + f""",
hops AS (
  SELECT '{start}' AS id, 0 AS depth
  UNION
  SELECT e.{there}, h.depth + 1 FROM hops h JOIN edges e ON e.{here} = h.id WHERE h.depth < {depth}),
least AS (SELECT id, min(depth) AS depth FROM hops WHERE depth > 0 GROUP BY id),
rel AS (SELECT l.id, l.depth, min_by(e.type, e.seq) AS relation FROM least l JOIN edges e ON e.{there} = l.id
  JOIN (SELECT id, min(depth) AS depth FROM hops GROUP BY id) p ON p.id = e.{here} AND p.depth = l.depth - 1 GROUP BY l.id, l.depth)
SELECT r.id, CAST(r.depth AS INT) AS depth, r.relation, coalesce(n.node_type, 'Unknown') AS node_type FROM rel r LEFT JOIN nodes n ON n.id = r.id"""


@register("impact", _walk("part:1", 3, "target", "source"))
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impact(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), "part:1", 3)


@register("dependencies", _walk("nation:7", 3, "source", "target"))
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.dependencies(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), "nation:7", 3)


@register("dependencies_ordered")
def dependencies_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach_ordered(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), "customer:1", 2)


_OUT = "SELECT target, n.name AS target_name, n.node_type AS target_type, call_line FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'customer:1' AND e.type = 'calls'"
_IN = "SELECT source AS caller, n.name AS caller_name, n.node_type AS caller_type, call_line FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'supplier:1' AND e.type = 'calls'"


@register("call_graph_out", _G + _OUT)
def call_graph_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.calls_out(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), "customer:1")


@register("call_graph_in", _G + _IN)
def call_graph_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.calls_in(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), "supplier:1")


_BOTH = _with(nodes=D.NODES, edges=D.CALL_EDGES)


@register("call_graph", _BOTH + f"SELECT 'incoming' AS direction, caller AS node, caller_name AS name, caller_type AS node_type, call_line FROM ({_IN}) x UNION ALL SELECT 'outgoing', * FROM ({_OUT.replace('customer:1', 'supplier:1')}) y")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.call_graph(D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.CALL_EDGES), "supplier:1")


@register("call_graph_summary", _BOTH + "SELECT 'supplier:1' AS node_id, count(*) FILTER (WHERE source = 'supplier:1') AS outgoing_count, count(*) FILTER (WHERE target = 'supplier:1') AS incoming_count FROM edges WHERE type = 'calls'")
def call_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.call_graph_summary(D.edges(spark, sf_dir, D.CALL_EDGES), "supplier:1")


@register("stats", _G + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.stats(D.nodes(spark, sf_dir), D.edges(spark, sf_dir))


@register("stats_by_type", _G + "SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.stats_by_type(D.nodes(spark, sf_dir))


@register("list_files", _G + "SELECT DISTINCT file_path FROM nodes WHERE file_path <> '' ORDER BY file_path")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.list_files(D.nodes(spark, sf_dir))


@register("list_files_all", _with(fn=D.FRAGMENT_NODES) + "SELECT DISTINCT f AS file_path FROM (SELECT CASE WHEN coalesce(file_path, '') <> '' THEN file_path WHEN node_type IN ('Template', 'Stylesheet') THEN name WHEN contains(id, '::') THEN string_split(id, '::')[1] END AS f FROM fn) WHERE f <> ''")
def list_files_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.list_files(D.table(spark, sf_dir, D.FRAGMENT_NODES), compat=False)


_SETS = "SELECT DISTINCT 'node' AS aspect, node_type AS value FROM nodes UNION ALL SELECT DISTINCT 'edge', type FROM edges UNION ALL SELECT DISTINCT 'ambiguity', kind FROM ambs"


@register("coverage_sets", _GA + _SETS)
def coverage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.coverage_sets(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), D.ambiguities(spark, sf_dir))


_EXPECTED = [("node", t) for t in NODE_TYPES] + [("edge", t) for t in EDGE_RULES]
_EXPECTED_SQL = ", ".join(f"('{a}', '{v}')" for a, v in _EXPECTED)
_EXCUSED = [("extends", "inheritance_target_unproven"), ("decorates", "decorator_unknown"), ("imports", "import_module_unknown"), ("renders_template", "dynamic_value_unresolved")]


@register("coverage_missing", _GA + f"SELECT a AS aspect, v AS value FROM (VALUES {_EXPECTED_SQL}) x(a, v) EXCEPT SELECT * FROM ({_SETS})")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.coverage_missing(coverage_sets(spark, sf_dir), spark.createDataFrame(_EXPECTED, "aspect string, value string"))


@register("coverage", _GA + f"SELECT a AS aspect, v AS value FROM (VALUES {_EXPECTED_SQL}) x(a, v) EXCEPT SELECT * FROM ({_SETS}) EXCEPT SELECT 'edge', e FROM (VALUES {', '.join(map(str, _EXCUSED))}) y(e, k) WHERE k IN (SELECT kind FROM ambs)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.coverage_missing(coverage_sets(spark, sf_dir), spark.createDataFrame(_EXPECTED, "aspect string, value string"), spark.createDataFrame(_EXCUSED, "value string, kind string"))


# ---- merging -------------------------------------------------------------------------------

_M = _with(fn=D.FRAGMENT_NODES, fe=D.FRAGMENT_EDGES) + """, own AS (
  SELECT fragment, seq, id AS raw, coalesce(node_type, 'Unknown') AS node_type, name, file_path, docstring,
    CASE WHEN file_path IS NOT NULL AND node_type = 'File' THEN 'File:' || file_path WHEN contains(id, '::') THEN id
      WHEN file_path IS NOT NULL THEN coalesce(node_type, 'Unknown') || ':' || file_path || '::' || name ELSE coalesce(node_type, 'Unknown') || ':' || name END AS id FROM fn),
merged AS (SELECT id, first(node_type ORDER BY fragment DESC, seq DESC) AS node_type, first(docstring ORDER BY fragment DESC, seq DESC) AS docstring, min((fragment, seq)) AS place FROM own GROUP BY id),
alias AS (SELECT fragment, raw AS alias, max_by(id, seq) AS id FROM own GROUP BY fragment, raw),
joined AS (
  SELECT e.fragment, e.seq, coalesce(a.id, from_id) AS source, coalesce(b.id, to_id) AS target, edge AS type, call_line FROM fe e
  LEFT JOIN alias a ON a.fragment = e.fragment AND a.alias = from_id LEFT JOIN alias b ON b.fragment = e.fragment AND b.alias = to_id),
medges AS (SELECT source, target, type, call_line FROM joined QUALIFY row_number() OVER (PARTITION BY type, source, target ORDER BY fragment, seq) = 1)
"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    n, e = D.table(spark, sf_dir, D.FRAGMENT_NODES), D.table(spark, sf_dir, D.FRAGMENT_EDGES).withColumnsRenamed({"from_id": "from", "to_id": "to"})
    split = lambda df: [df.where(F.col("fragment") == i).drop("fragment") for i in (0, 1)]
    return split(n), split(e)


@register("merge_union", _M + "SELECT fragment, seq, id, name FROM fn")
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union(_parts(spark, sf_dir)[0]).select("fragment", "seq", "id", "name")


@register("merge_nodes", _M + "SELECT id, node_type, docstring, struct_extract(place, 1) AS fragment, struct_extract(place, 2) AS seq FROM merged")
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_nodes(merge.union(_parts(spark, sf_dir)[0])).select("id", "node_type", "docstring", "fragment", "seq")


@register("merge_alias", _M + "SELECT fragment, alias, id FROM alias")
def merge_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.aliases(merge.union(_parts(spark, sf_dir)[0]))


@register("merge_alias_compat", _M + "SELECT alias, max_by(id, (fragment, seq, slot)) AS id FROM (SELECT fragment, seq, 0 AS slot, name AS alias, id FROM own UNION ALL SELECT fragment, seq, 1, raw, id FROM own) x GROUP BY alias")
def merge_alias_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.aliases(merge.union(_parts(spark, sf_dir)[0]), compat=True).drop("fragment")


@register("merge_edges", _M + "SELECT * FROM medges")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _parts(spark, sf_dir)
    return merge.merge_edges(merge.union(e), merge.aliases(merge.union(n))).select("source", "target", "type", "call_line")


@register("merge", _M + "SELECT 'node' AS part, id AS a, node_type AS b, docstring AS c, NULL::INT AS call_line FROM merged UNION ALL SELECT 'edge', source, target, type, call_line FROM medges")
def merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _parts(spark, sf_dir)
    nodes, edges, _ = merge.merge(n, e, [D.ambiguities(spark, sf_dir)])
    shown = nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("node_type").alias("b"), F.col("docstring").alias("c"), F.lit(None).cast("int").alias("call_line"))
    return shown.unionAll(edges.select(F.lit("edge"), "source", "target", "type", "call_line"))


# ---- changes -------------------------------------------------------------------------------


@register("diff_files", _with(new=D.NEW_FILES, old=D.OLD_FILES) + "SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'ADDED' WHEN n.id IS NULL THEN 'REMOVED' WHEN n.hash = o.hash THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM new n FULL JOIN old o ON n.id = o.id")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.file_status(D.table(spark, sf_dir, D.NEW_FILES), D.table(spark, sf_dir, D.OLD_FILES))


_OWN = """, step AS (SELECT source, target FROM edges WHERE type IN ('defines', 'contains_member', 'contains_class', 'contains_method', 'contains_variable')),
owned AS (SELECT id, id AS owner FROM nodes WHERE node_type = 'File' UNION SELECT s.target, o.owner FROM owned o JOIN step s ON s.source = o.id)"""
_DIFF = _with(nodes=D.NODES, edges=D.EDGES, old=D.OLD_NODES) + _OWN + """,
files AS (SELECT n.id, CASE WHEN o.id IS NULL THEN 'ADDED' WHEN n.hash = o.hash THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status FROM nodes n LEFT JOIN old o ON n.id = o.id AND o.node_type = 'File' WHERE n.node_type = 'File'),
status AS (
  SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'REMOVED' WHEN o.id IS NULL THEN 'ADDED' WHEN f.status = 'UNCHANGED' THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status
  FROM nodes n FULL JOIN old o ON n.id = o.id LEFT JOIN owned w ON w.id = n.id LEFT JOIN files f ON f.id = w.owner)
"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.node_status(D.nodes(spark, sf_dir), D.nodes(spark, sf_dir, D.OLD_NODES), D.edges(spark, sf_dir))


@register("containment", _G + _OWN + " SELECT id, owner FROM owned")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.containment(D.nodes(spark, sf_dir), D.edges(spark, sf_dir))


@register("diff_nodes", _DIFF + "SELECT * FROM status")
def diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@register("diff_stats", _DIFF + "SELECT status, count(*) AS n FROM status GROUP BY status")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.status_counts(_status(spark, sf_dir))


_ACT = _DIFF + ", acted AS (SELECT n.id, CASE WHEN s.status = 'UNCHANGED' AND n.id IN (SELECT id FROM old) THEN 'preserve' ELSE 'enrich' END AS action FROM nodes n JOIN status s ON s.id = n.id)"


@register("enrich_partition", _ACT + "SELECT * FROM acted")
def enrich_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.partition(D.nodes(spark, sf_dir), _status(spark, sf_dir), D.nodes(spark, sf_dir, D.OLD_NODES))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = D.nodes(spark, sf_dir, D.OLD_NODES).withColumn("semantic_roles", F.when(F.col("node_type") == "Method", F.array(F.lit("Kept"))).otherwise(F.array().cast("array<string>")))
    new = D.nodes(spark, sf_dir).where("node_type = 'Class'").select("id", F.array(F.lit("DataModel")).alias("semantic_roles"))
    return diff.incremental(D.nodes(spark, sf_dir), _status(spark, sf_dir), old, new)


_DONE = _ACT + ", done AS (SELECT a.id, a.action, CASE WHEN a.action = 'preserve' THEN (CASE WHEN n.node_type = 'Method' THEN 'Kept' END) WHEN n.node_type = 'Class' THEN 'DataModel' END AS r FROM acted a JOIN nodes n ON n.id = a.id)"


@register("enrich_incremental", _DONE + "SELECT id, action, coalesce(r, '') AS roles FROM done")
def enrich_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incremental(spark, sf_dir).select("id", "action", F.array_join("semantic_roles", ",").alias("roles"))


@register("enrich_stats", _DONE + "SELECT count(*) FILTER (WHERE action = 'preserve') AS preserved, count(*) FILTER (WHERE action = 'enrich') AS enriched, count(*) FILTER (WHERE action = 'enrich' AND r IS NOT NULL) AS roles_applied FROM done")
def enrich_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.enrichment_counts(_incremental(spark, sf_dir))


# ---- checks --------------------------------------------------------------------------------

_B = _with(nodes=D.NODES, edges=D.BAD_EDGES, ambs=D.AMBIGUITIES) + f", rules AS (SELECT * FROM (VALUES {', '.join(map(str, TRIPLES))}) r(type, a, b))"
_TYPED = ", typed AS (SELECT e.*, s.node_type AS source_type, t.node_type AS target_type FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target)"


@register("orphan_edges", _B + "SELECT source, target, type, CASE WHEN source NOT IN (SELECT id FROM nodes) THEN 'source' ELSE 'target' END AS side FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target IS NULL OR target NOT IN (SELECT id FROM nodes)")
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.orphan_edges(D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.BAD_EDGES)).select("source", "target", "type", "side")


@register("schema_violations", _B + _TYPED + "SELECT source, target, type, source_type, target_type FROM typed WHERE (type, source_type, target_type) NOT IN (SELECT * FROM rules)")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.schema_violations(D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.BAD_EDGES))


_PROBLEMS = _B + _TYPED + """, subject AS (SELECT *, coalesce(source, '?') || ' ' || coalesce(type, '?') || ' ' || coalesce(target, '?') AS s FROM edges),
whole AS (SELECT * FROM subject WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL),
known AS (SELECT * FROM whole WHERE type IN (SELECT type FROM rules)),
problems AS (
  SELECT 'error' AS severity, 'malformed edge' AS issue, s AS subject FROM subject WHERE source IS NULL OR target IS NULL OR type IS NULL
  UNION ALL SELECT 'error', 'unknown edge type', s FROM whole WHERE type NOT IN (SELECT type FROM rules)
  UNION ALL SELECT 'error', 'orphan source', s FROM known WHERE source NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'error', 'orphan target', s FROM known WHERE source IN (SELECT id FROM nodes) AND target NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'error', 'source type not allowed', source || ' ' || type || ' ' || target FROM typed WHERE type IN (SELECT type FROM rules) AND (type, source_type) NOT IN (SELECT type, a FROM rules)
  UNION ALL SELECT 'error', 'target type not allowed', source || ' ' || type || ' ' || target FROM typed WHERE type IN (SELECT type FROM rules) AND (type, target_type) NOT IN (SELECT type, b FROM rules)
  UNION ALL SELECT 'error', 'malformed ambiguity', id FROM ambs WHERE reason IS NULL
  UNION ALL SELECT 'warning', 'unusual confidence', id FROM ambs WHERE reason IS NOT NULL AND confidence NOT IN ('heuristic', 'structural_violation', 'unresolved'))
"""


def _problems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    own = D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.BAD_EDGES), D.ambiguities(spark, sf_dir)
    return (*own, validate.validate(*own))


@register("validate_graph", _PROBLEMS + "SELECT * FROM problems")
def validate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir)[3]


@register("validate_counts", _PROBLEMS + "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM ambs) AS ambiguity_count, count(*) AS errors, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status FROM problems WHERE severity = 'error'")
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.counts(*_problems(spark, sf_dir))


@register("validate_rules")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(rules.check_rules(rules.RULES, NODE_TYPES), "severity string, place string, problem string")


_E = _with(nodes=D.NODES, edges=D.EDGES, ambs=D.AMBIGUITIES, onodes=D.OTHER_NODES, oedges=D.OTHER_EDGES)
_CHANGED = "SELECT 'node_removed' AS violation, id AS detail FROM nodes WHERE id NOT IN (SELECT id FROM onodes) UNION ALL SELECT 'node_added', id FROM onodes WHERE id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'node_type_changed', n.id FROM nodes n JOIN onodes o ON n.id = o.id WHERE n.node_type <> o.node_type"
_GONE, _NEW = "SELECT source, target, type FROM edges EXCEPT SELECT source, target, type FROM oedges", "SELECT source, target, type FROM oedges EXCEPT SELECT source, target, type FROM edges"


@register("equivalence_nodes", _E + _CHANGED)
def equivalence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.node_changes(D.nodes(spark, sf_dir), D.nodes(spark, sf_dir, D.OTHER_NODES))


@register("edges_removed", _E + _GONE)
def edges_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.edges_removed(D.edges(spark, sf_dir), D.edges(spark, sf_dir, D.OTHER_EDGES))


@register("edges_added", _E + _NEW)
def edges_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.edges_added(D.edges(spark, sf_dir), D.edges(spark, sf_dir, D.OTHER_EDGES))


@register("equivalence", _E + f"{_CHANGED} UNION ALL SELECT 'edge_removed', source || ' ' || type || ' ' || target FROM ({_GONE}) UNION ALL SELECT 'edge_added', source || ' ' || type || ' ' || target FROM ({_NEW}) UNION ALL SELECT 'node_count', a || ' ' || b FROM (SELECT (SELECT count(*) FROM nodes) AS a, (SELECT count(*) FROM onodes) AS b) WHERE a <> b")
def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubts = D.ambiguities(spark, sf_dir)
    return validate.equivalence((D.nodes(spark, sf_dir), D.edges(spark, sf_dir), doubts), (D.nodes(spark, sf_dir, D.OTHER_NODES), D.edges(spark, sf_dir, D.OTHER_EDGES), doubts))


@register("first_violations", f"{_E} SELECT violation, detail FROM ({_CHANGED} UNION ALL SELECT 'edge_removed', source || ' ' || type || ' ' || target FROM ({_GONE}) UNION ALL SELECT 'edge_added', source || ' ' || type || ' ' || target FROM ({_NEW}) UNION ALL SELECT 'node_count', a || ' ' || b FROM (SELECT (SELECT count(*) FROM nodes) AS a, (SELECT count(*) FROM onodes) AS b) WHERE a <> b) ORDER BY violation, detail LIMIT 5")
def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.first_violations(equivalence(spark, sf_dir))


# ---- roles ---------------------------------------------------------------------------------

_R = _with(nodes=D.NODES, edges=D.ROLE_EDGES, ambs=D.AMBIGUITIES)


def _rule(name: str, r: rules.Rule, sql: str, loose: bool = False) -> None:
    @register(name, _R + sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.Matcher(D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.ROLE_EDGES), D.ambiguities(spark, sf_dir), loose).matches(r)


_BY = "SELECT DISTINCT n.id FROM nodes n JOIN edges e ON e.{here} = n.id AND e.type = '{type}' JOIN nodes o ON o.id = e.{there} WHERE n.node_type = '{kind}' AND {test}"
_rule("role_inheritance", rules.rule("x", "Class", "R", inherits=["NATION_0", "NATION_1"]), _BY.format(here="source", there="target", type="extends", kind="Class", test="o.name IN ('NATION_0', 'NATION_1')"))
_rule("role_path", rules.rule("x", "Function", "R", file_pattern="asia"), _BY.format(here="target", there="source", type="defines", kind="Function", test="contains(o.file_path, 'asia')"))
_rule("role_path_glob", rules.rule("x", "Function", "R", file_pattern="src/a*/views.py"), _BY.format(here="target", there="source", type="defines", kind="Function", test="o.file_path LIKE 'src/a%/views.py'"))
_rule("role_decorator", rules.rule("x", "Function", "R", decorated_by=["Supplier#000000001", "other"]), _BY.format(here="target", there="source", type="decorates", kind="Function", test="o.name IN ('Supplier#000000001', 'other')"))
_rule("role_calls", rules.rule("x", "Method", "R", calls=["Supplier#000000001", "Supplier#000000002"]), _BY.format(here="source", there="target", type="calls", kind="Method", test="o.name IN ('Supplier#000000001', 'Supplier#000000002')"))
_rule("role_name", rules.rule("x", "Class", "R", function_name=["NATION_1", "NATION_2", "PERU"]), "SELECT id FROM nodes WHERE node_type = 'Class' AND name IN ('NATION_1', 'NATION_2', 'PERU')")
_rule("role_args", rules.rule("x", "Function", "R", has_argument=["request"]), "SELECT id FROM nodes WHERE node_type = 'Function' AND arg = 'request'")
_rule(
    "role_import", rules.rule("x", "Class", "R", requires_import="AFR"),
    """, f AS (SELECT target AS id, min_by(source, seq) AS file FROM edges WHERE type = 'defines' GROUP BY target)
    SELECT n.id FROM nodes n JOIN f ON f.id = n.id WHERE n.node_type = 'Class' AND f.file IN (SELECT e.source FROM edges e JOIN nodes o ON o.id = e.target WHERE e.type = 'imports' AND contains(o.name, 'AFR'))""",
)
_rule(
    "role_loose", rules.rule("x", "Class", "R", inherits=["models.Model"]),
    "SELECT id FROM nodes WHERE node_type = 'Class' AND id IN (SELECT source_scope FROM ambs WHERE kind = 'inheritance_target_unproven' AND contains(expression, 'models.Model'))", loose=True,
)

_SET = (
    rules.rule("a", "Class", "Heir", inherits=["NATION_0", "NATION_1"]),
    rules.rule("a", "Class", "Named", function_name=["NATION_1", "NATION_2"]),
    rules.rule("b", "Function", "View", has_argument=["request"], file_pattern="views"),
    rules.rule("b", "Function", "Signal", decorators=["receiver"]),
    rules.rule("b", "Class", "Named", function_name=["NATION_2", "PERU"]),
    rules.rule("c", "Variable", "Component", contains_attribute=["pseudo_state"]),
)
_HITS = """, hits AS (
  SELECT DISTINCT n.id, 0 AS r, 'Heir' AS role FROM nodes n JOIN edges e ON e.source = n.id AND e.type = 'extends' JOIN nodes o ON o.id = e.target WHERE o.name IN ('NATION_0', 'NATION_1')
  UNION ALL SELECT id, 1, 'Named' FROM nodes WHERE node_type = 'Class' AND name IN ('NATION_1', 'NATION_2', 'PERU')
  UNION ALL SELECT DISTINCT n.id, 2, 'View' FROM nodes n JOIN edges e ON e.target = n.id AND e.type = 'defines' JOIN nodes o ON o.id = e.source WHERE n.node_type = 'Function' AND n.arg = 'request' AND contains(o.file_path, 'views')
  UNION ALL SELECT id, 3, 'Signal' FROM nodes WHERE node_type = 'Function' AND decorator = '@receiver(...)'
  UNION ALL SELECT id, 5, 'Component' FROM nodes WHERE node_type = 'Variable' AND state IS NOT NULL)
"""


@register("semantic_roles", _R + _HITS + "SELECT id, string_agg(role, ',' ORDER BY r) AS roles FROM hits GROUP BY id")
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.roles(D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.ROLE_EDGES), D.ambiguities(spark, sf_dir), _SET, loose=False)
    return found.select("id", F.array_join("semantic_roles", ",").alias("roles"))


@register("roles_loose", _R + """, hits AS (
  SELECT id, 0 AS r, 'DataModel' AS role FROM nodes WHERE node_type = 'Class' AND id IN (SELECT source_scope FROM ambs WHERE kind = 'inheritance_target_unproven' AND contains(expression, 'models.Model'))
  UNION ALL SELECT id, 1, 'Signal' FROM nodes WHERE node_type = 'Function' AND id IN (SELECT target FROM edges WHERE type = 'decorates' AND contains(source, 'supplier'))
  UNION ALL SELECT id, 2, 'Client' FROM nodes WHERE node_type = 'Method' AND (id IN (SELECT source FROM edges JOIN nodes o ON o.id = target WHERE type = 'calls' AND contains(o.name, '0001')) OR id IN (SELECT source_scope FROM ambs WHERE kind = 'call_target_unknown' AND contains(expression, '0001')))
) SELECT id, string_agg(role, ',' ORDER BY r) AS roles FROM hits GROUP BY id""")
def roles_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (rules.rule("d", "Class", "DataModel", inherits=["models.Model"]), rules.rule("d", "Function", "Signal", decorated_by=["supplier"]), rules.rule("d", "Method", "Client", calls=["0001"]))
    found = rules.roles(D.nodes(spark, sf_dir), D.edges(spark, sf_dir, D.ROLE_EDGES), D.ambiguities(spark, sf_dir), own)
    return found.select("id", F.array_join("semantic_roles", ",").alias("roles"))


# ---- second level --------------------------------------------------------------------------

_L = _with(nodes=D.NODES, edges=D.EDGES, ambs=D.AMBIGUITIES, l2=D.LEVEL2, res=D.RESOLVED)
_PENDING = """SELECT *, reason <> 'unchanged' AS pending FROM (SELECT n.id, coalesce(n.file_path, n.name) AS file_path, n.hash AS current_hash,
  CASE WHEN l.id IS NULL THEN 'new_file' WHEN NOT l.said THEN 'not_enriched' WHEN l.at_hash <> n.hash THEN 'hash_changed' ELSE 'unchanged' END AS reason FROM nodes n LEFT JOIN l2 l ON l.id = n.id WHERE n.node_type = 'File')"""


@register("l2_pending", _L + _PENDING)
def l2_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.pending(D.nodes(spark, sf_dir), D.level2(spark, sf_dir))


@register("l2_pending_full", _L + "SELECT id, file_path, hash AS current_hash, 'full_mode' AS reason, true AS pending FROM nodes WHERE node_type = 'File'")
def l2_pending_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.pending(D.nodes(spark, sf_dir), D.level2(spark, sf_dir), "full")


@register("l2_pending_summary", _L + f"SELECT count(*) AS total_files, count(*) FILTER (WHERE pending) AS pending_enrichment, count(*) FILTER (WHERE NOT pending) AS skipped FROM ({_PENDING})")
def l2_pending_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.pending_summary(l2_pending(spark, sf_dir))


@register("l2_stats", _L + """SELECT t AS nodes_total, e AS nodes_enriched, t - e AS nodes_pending, round(e / t * 100, 1) AS coverage_percent, a AS ambiguities_total, r AS resolved, u AS unresolved, a - r - u AS not_processed FROM (
  SELECT (SELECT count(*) FROM nodes) AS t, (SELECT count(*) FROM l2 WHERE said) AS e, (SELECT count(*) FROM ambs) AS a, (SELECT count(*) FROM res WHERE said AND status = 'resolved') AS r, (SELECT count(*) FROM res WHERE said AND status IS DISTINCT FROM 'resolved') AS u)""")
def l2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.stats(D.nodes(spark, sf_dir), D.ambiguities(spark, sf_dir), D.level2(spark, sf_dir), D.resolved(spark, sf_dir))


@register("l2_validate", _L + """SELECT 'warning' AS severity, 'missing intent' AS issue, id AS subject FROM l2 WHERE said AND intent IS NULL UNION ALL SELECT 'warning', 'missing summary', id FROM l2 WHERE said AND summary IS NULL
UNION ALL SELECT 'error', 'missing status', id FROM res WHERE said AND status IS NULL UNION ALL SELECT 'error', 'missing target', id FROM res WHERE said AND status = 'resolved' AND target IS NULL""")
def l2_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.validate(D.level2(spark, sf_dir), D.resolved(spark, sf_dir))


@register("l2_fields", _L + "SELECT id, 'intent' AS field FROM l2 WHERE said AND intent IS NULL UNION ALL SELECT id, 'summary' FROM l2 WHERE said AND summary IS NULL UNION ALL SELECT id, 'complexity_score' FROM l2 WHERE said AND (complexity IS NULL OR complexity < 1 OR complexity > 5)")
def l2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.check_fields(D.level2(spark, sf_dir))


@register("l2_confidence", _L + "SELECT id, 'resolved below the confidence limit' AS issue FROM res WHERE said AND status = 'resolved' AND sure < 0.7 UNION ALL SELECT id, 'target is no node' FROM res WHERE said AND status = 'resolved' AND target IS NOT NULL AND target NOT IN (SELECT id FROM nodes) UNION ALL SELECT id, 'target is no node' FROM res WHERE said AND status = 'resolved' AND target IS NULL")
def l2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.check_confidence(D.resolved(spark, sf_dir), D.nodes(spark, sf_dir))


_KEYS = "SELECT CAST(n_nationkey AS INT) AS rank, 'nation:' || CAST(n_nationkey AS STRING) AS key, 'about ' || n_name AS intent FROM nation UNION ALL SELECT 100 + CAST(s_suppkey AS INT), 'x:' || CAST(s_suppkey AS STRING), 'tail ' || s_name FROM supplier UNION ALL SELECT 50, 'x:1::Supplier#000000001', 'named'"


@register("l2_apply", _with(nodes=D.NODES, keyed=_KEYS) + """, tails AS (SELECT *, string_split(key, ':')[-1] AS tail FROM keyed), called AS (SELECT *, string_split(tail, '::')[-1] AS called FROM tails),
met AS (SELECT n.id, k.rank, k.intent FROM nodes n JOIN called k ON k.key = n.id UNION ALL SELECT n.id, k.rank, k.intent FROM nodes n JOIN called k ON k.called = n.name AND contains(n.id, k.tail)),
one AS (SELECT id, min_by(intent, rank) AS intent FROM met GROUP BY id)
SELECT n.id, coalesce(o.intent, 'Part of a demo: ' || n.name) AS intent, coalesce(n.hash, 'unknown') AS at_hash FROM nodes n LEFT JOIN one o ON o.id = n.id WHERE o.id IS NOT NULL OR contains(n.file_path, 'views')""")
def l2_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    record = F.struct("intent", none.cast("string").alias("summary"), none.cast("int").alias("complexity_score"), none.cast("array<string>").alias("domain_tags"), none.cast("boolean").alias("pure_logic"), none.cast("array<string>").alias("side_effects"), none.cast("string").alias("enriched_at_hash"), none.cast("string").alias("enriched_at"))
    records = D.table(spark, sf_dir, _KEYS).select("rank", "key", record.alias("llm_enrichment"))
    return overlay.apply_records(D.nodes(spark, sf_dir), records, "views").select("id", "llm_enrichment.intent", F.col("llm_enrichment.enriched_at_hash").alias("at_hash"))


@register("resolve_ambiguity", _GA + """SELECT id, CASE WHEN kind = 'call_target_unknown' AND contains(expression, 'render') THEN 'resolved' WHEN kind IN ('import_module_unknown', 'schema_violation', 'mapping_violation') THEN 'unresolved' END AS status,
CASE WHEN kind = 'call_target_unknown' AND contains(expression, 'render') THEN 'django.shortcuts.render' END AS target FROM ambs""")
def resolve_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.resolve_ambiguities(D.ambiguities(spark, sf_dir)).select("id", "llm_resolution.status", F.col("llm_resolution.probable_target").alias("target"))


@register("l2_context", _GA + _OWN + """, members AS (SELECT owner, count(DISTINCT id) AS n_nodes FROM owned GROUP BY owner),
touched AS (SELECT owner, count(*) AS n_edges, sum(length(s)) AS edge_chars FROM (SELECT DISTINCT owner, source || '>' || target || '>' || type AS s FROM (SELECT *, source AS id FROM edges UNION ALL SELECT *, target FROM edges) e JOIN owned o ON o.id = e.id) GROUP BY owner),
words AS (SELECT id, unnest(list_distinct(regexp_extract_all(expression, '\\w+'))) AS w FROM ambs),
could AS (SELECT w.id, count(DISTINCT n.id) AS n FROM words w JOIN nodes n ON n.name = w.w GROUP BY w.id),
doubts AS (SELECT owner, count(DISTINCT a.id) AS n_ambiguities, sum(coalesce(c.n, 0)) AS n_candidates FROM ambs a JOIN owned o ON o.id = a.source_scope LEFT JOIN could c ON c.id = a.id GROUP BY owner)
SELECT m.owner, n_nodes, coalesce(n_edges, 0) AS n_edges, CAST(coalesce(edge_chars, 0) AS BIGINT) AS edge_chars, coalesce(n_ambiguities, 0) AS n_ambiguities, CAST(coalesce(n_candidates, 0) AS BIGINT) AS n_candidates FROM members m LEFT JOIN touched USING (owner) LEFT JOIN doubts USING (owner)""")
def l2_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.context(D.nodes(spark, sf_dir), D.edges(spark, sf_dir), D.ambiguities(spark, sf_dir))
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + f(x))
    chars = total("edges", lambda e: F.length(F.concat_ws(">", e["source"], e["target"], e["type"])))
    each = found.select("owner", F.size("node_ids").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), chars.alias("edge_chars"), F.size("ambiguities").cast("long").alias("n_ambiguities"), total("ambiguities", lambda a: F.size(a["candidates"])).alias("n_candidates"))
    return each.groupBy("owner").agg(*(F.sum(c).alias(c) for c in each.columns[1:]))


@register("l2_candidates", _GA + """, words AS (SELECT id, unnest(list_distinct(regexp_extract_all(expression, '\\w+'))) AS w FROM ambs) SELECT DISTINCT w.id AS ambiguity, n.id AS candidate FROM words w JOIN nodes n ON n.name = w.w""")
def l2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.candidates(D.nodes(spark, sf_dir), D.ambiguities(spark, sf_dir))


# ---- extraction ----------------------------------------------------------------------------


@register("resolve_module", _with(modules=D.MODULES, req=D.REQUESTS) + ", parts AS (SELECT module, string_split(module, '/') AS p FROM modules), ends AS (SELECT module, array_to_string(p[i:], '/') AS guess FROM (SELECT module, p, unnest(range(1, len(p) + 1)) AS i FROM parts)) SELECT path, r.guess, exact, min(module) AS module FROM req r JOIN ends e ON e.guess = r.guess AND (NOT exact OR e.guess = module) GROUP BY ALL")
def resolve_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_python.resolve_modules(D.table(spark, sf_dir, D.REQUESTS), D.table(spark, sf_dir, D.MODULES))


_REL = "SELECT l_orderkey, l_linenumber, 'src/a' || CAST(l_partkey AS STRING) || '/b/m.py' AS base, l_linenumber AS level, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'x.y' || CAST(l_suppkey AS STRING) END AS module FROM lineitem"


@register("resolve_relative", _with(r=_REL) + "SELECT l_orderkey, l_linenumber, CASE WHEN level - 1 <= len(p) - 1 THEN array_to_string(list_concat(p[:len(p) - level], CASE WHEN module IS NULL THEN [] ELSE [replace(module, '.', '/')] END), '/') END AS target FROM (SELECT *, string_split(base, '/') AS p FROM r)")
def resolve_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = relative_module_column(F.col("base"), F.col("level"), F.col("module"))
    return D.table(spark, sf_dir, _REL).select("l_orderkey", "l_linenumber", target.alias("target"))


@register("py_nodes", """WITH m AS (SELECT n_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT 'nations/n' || n_nationkey || '.py' AS id, 'File' AS node_type, NULL::INT AS line_start FROM nation UNION ALL SELECT 'nations/n' || n_nationkey || '.py::N' || n_nationkey, 'Class', 5 FROM nation
UNION ALL SELECT 'nations/n' || n_nationkey || '.py::N' || n_nationkey || '::key', 'Variable', 6 FROM nation UNION ALL SELECT 'nations/n' || n || '.py::N' || n || '::c' || k, 'Method', CAST(5 + 2 * r AS INT) FROM m
UNION ALL SELECT 'lib/suppliers.py', 'File', NULL UNION ALL SELECT 'lib/suppliers.py::serve', 'Function', 1 UNION ALL SELECT 'lib/suppliers.py::s' || s_suppkey, 'Function', CAST(1 + 4 * row_number() OVER (ORDER BY s_suppkey) AS INT) FROM supplier""")
def py_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_python.fragments(D.python_files(spark, sf_dir))
    return found.select(F.explode("nodes").alias("n")).select("n.id", "n.node_type", "n.line_start")


_FROM = "'nations/n' || n_nationkey || '.py'"


@register("py_edges", f"""WITH m AS (SELECT n_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)
SELECT 'defines' AS edge, {_FROM} AS source, {_FROM} || '::N' || n_nationkey AS target, NULL::INT AS call_line FROM nation UNION ALL SELECT 'contains_member', {_FROM} || '::N' || n_nationkey, {_FROM} || '::N' || n_nationkey || '::key', NULL FROM nation
UNION ALL SELECT 'contains_member', 'nations/n' || n || '.py::N' || n, 'nations/n' || n || '.py::N' || n || '::c' || k, NULL FROM m UNION ALL SELECT 'calls', 'nations/n' || n || '.py::N' || n || '::c' || k, 'lib/suppliers.py::serve', CAST(6 + 2 * r AS INT) FROM m
UNION ALL SELECT 'imports', {_FROM}, 'lib/suppliers.py', NULL FROM nation UNION ALL SELECT 'imports', {_FROM}, 'lib/suppliers.py::serve', NULL FROM nation UNION ALL SELECT 'defines', 'lib/suppliers.py', 'lib/suppliers.py::serve', NULL
UNION ALL SELECT 'defines', 'lib/suppliers.py', 'lib/suppliers.py::s' || k, NULL FROM s UNION ALL SELECT 'calls', 'lib/suppliers.py::s' || k, 'lib/suppliers.py::serve', CAST(2 + 4 * r AS INT) FROM s""")
def py_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_python.extract(D.python_files(spark, sf_dir))
    return found.select(F.explode("edges").alias("e")).select("e.edge", F.col("e.from").alias("source"), F.col("e.to").alias("target"), "e.call_line")


@register("py_ambiguities", f"SELECT 'import_module_unknown' AS kind, {_FROM} AS source_scope, 'json' AS expression FROM nation UNION ALL SELECT 'schema_violation', {_FROM} || '::N' || n_nationkey, 'writes_to -> writes_to' FROM nation")
def py_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_python.extract(D.python_files(spark, sf_dir))
    return found.select(F.explode("ambiguities").alias("a")).select("a.kind", "a.source_scope", "a.expression")


def _scoped(*rows: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(r)} FROM (SELECT 'mods/m' || s_suppkey || '.py' AS p, s_suppkey AS k FROM supplier)" for r in rows)


@register("py_details", _scoped(
    ("p AS id", "'File' AS node_type", "NULL::INT AS line_start", "NULL::INT AS line_end", "'About ' || k || '.' AS docstring", "NULL AS args", "NULL AS defaults", "NULL AS decorators", "NULL AS returns"),
    ("p || '::x'", "'Variable'", "2", "2", "NULL", "NULL", "NULL", "NULL", "NULL"), ("p || '::g'", "'Function'", "6", "9", "NULL", "''", "''", "''", "NULL"), ("p || '::g::y'", "'Variable'", "7", "7", "NULL", "NULL", "NULL", "NULL", "NULL"),
    ("p || '::C'", "'Class'", "12", "23", "NULL", "NULL", "NULL", "NULL", "NULL"), ("p || '::C::z'", "'Variable'", "13", "13", "NULL", "NULL", "NULL", "NULL", "NULL"),
    ("p || '::C::m'", "'Method'", "16", "19", "'Method ' || k || '.'", "'self,g,b'", "CAST(k AS VARCHAR)", "''", "'int'"), ("p || '::C::n'", "'Method'", "22", "23", "NULL", "'c'", "'t'", "'@staticmethod'", "NULL")))
def py_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, docstrings and signatures; of variables that are bound twice the first."""
    found = extract_python.fragments(D.scoped_files(spark, sf_dir)).select(F.explode("nodes").alias("n"))
    listed = (F.array_join(F.col(f"n.signature.{c}"), ",").alias(c) for c in ("args", "defaults", "decorators"))
    return found.select("n.id", "n.node_type", "n.line_start", "n.line_end", "n.docstring", *listed, "n.signature.returns")


@register("py_scopes", _scoped(("'calls' AS edge", "p || '::C::m' AS source", "p || '::C::n' AS target", "18 AS call_line"), ("'calls'", "p || '::C::n'", "p || '::g'", "23"), ("'writes_to'", "p || '::g'", "p || '::g::y'", "NULL"), ("'writes_to'", "p || '::g'", "p || '::g::y'", "NULL")))
def py_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are those of the nearest scope; a parameter hides the function of its name."""
    found = extract_python.extract(D.scoped_files(spark, sf_dir)).select(F.explode("edges").alias("e")).where("e.edge IN ('calls', 'writes_to')")
    return found.select("e.edge", F.col("e.from").alias("source"), F.col("e.to").alias("target"), "e.call_line")


@register("html_links", "SELECT page_id, h AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of anchors; of the parser's view only those that a script's text can't hold."""
    found = extract_html.attribute_matches(extract_html.tags(D.html_files(spark, sf_dir)))
    page = F.regexp_extract("path", r"page/(\d+)", 1).cast("long")
    return found.where("tag = 'a'").select(page.alias("page_id"), F.col("value").alias("href"))


def _shop(*rows: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT 'shop/' || s_suppkey || '.html' AS path, {', '.join(f'{v} AS {n}' for n, v in r)} FROM supplier" for r in rows)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html.links(extract_html.tags(D.shop_files(spark, sf_dir)))


_attr = lambda line, edge, value: (("line", str(line)), ("edge", f"'{edge}'"), ("value", value))


@register("html_attr_rules", _shop(_attr(2, "calls_api", "'/cart'"), _attr(2, "targets_element", "'#cart'"), _attr(3, "calls_api", "'/more'"), _attr(3, "triggers_event", "'revealed'")))
def html_attr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("by_attribute AND outcome = 'edge'").select("path", "line", "edge", "value")


@register("html_tag_rules", _shop(_attr(1, "links_static_asset", "'/s' || s_nationkey || '.css'"), _attr(1, "links_static_asset", "'logo.png'"), _attr(2, "submits_form", "'/buy/' || s_suppkey"), _attr(3, "links_static_asset", "'/og.png'")))
def html_tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("NOT by_attribute AND outcome = 'edge'").select("path", "line", "edge", "value")


@register("html_external", _shop((("expression", "'https://x.example/' || s_name"),), (("expression", "'//cdn.example/x.js'"),)))
def html_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("outcome = 'external_reference_unmodeled'").select("path", F.col("value").alias("expression"))


@register("html_dynamic", _shop((("expression", "'{{ url }}'"),)))
def html_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("outcome = 'dynamic_value_unresolved'").select("path", F.col("value").alias("expression"))


_node = lambda kind, name, method: (("kind", f"'{kind}'"), ("name", name), ("method", method))


@register("html_nodes", _shop(
    (("kind", "'Template'"), ("name", "'shop/' || s_suppkey || '.html'"), ("method", "NULL::VARCHAR")), _node("StaticAsset", "'/s' || s_nationkey || '.css'", "NULL"), _node("StaticAsset", "'logo.png'", "NULL"), _node("StaticAsset", "'/og.png'", "NULL"),
    _node("Route", "'/buy/' || s_suppkey", "'POST'"), _node("Route", "'/cart'", "'POST'"), _node("Route", "'/more'", "NULL"), _node("StyleID", "'#cart'", "'POST'"), _node("Event", "'revealed'", "NULL")))
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = extract_html.extract(D.shop_files(spark, sf_dir))[0]
    return nodes.select(F.substring_index("id", "::", 1).alias("path"), F.col("node_type").alias("kind"), "name", F.col("attributes")["method"].alias("method"))


_to = lambda edge, kind, name: (("edge", f"'{edge}'"), ("target", f"'shop/' || s_suppkey || '.html::{kind}::' || {name}"))


@register("html_edges", _shop(
    _to("links_static_asset", "StaticAsset", "'/s' || s_nationkey || '.css'"), _to("links_static_asset", "StaticAsset", "'logo.png'"), _to("links_static_asset", "StaticAsset", "'/og.png'"), _to("submits_form", "Route", "'/buy/' || s_suppkey"),
    _to("calls_api", "Route", "'/cart'"), _to("calls_api", "Route", "'/more'"), _to("targets_element", "StyleID", "'#cart'"), _to("triggers_event", "Event", "'revealed'")))
def html_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html.extract(D.shop_files(spark, sf_dir))[1].select(F.col("`from`").alias("path"), "edge", F.col("to").alias("target"))


_SHEET = "replace(lower(p_brand), '#', '-') || '.css' AS path"


_RULE = f"(SELECT {_SHEET}, p_partkey AS k, CAST(4 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line, CASE WHEN p_size > 25 THEN 'hover' END AS state FROM part)"


@register("css_selectors", f"SELECT path, 'StyleClass' AS node_type, 'part-' || k AS name, line, state AS pseudo_state FROM {_RULE} UNION ALL SELECT path, 'StyleID', 'p' || k, line, NULL FROM {_RULE} UNION ALL SELECT path, 'StyleElement', 'li', line, NULL FROM {_RULE}")
def css_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_css.selectors(D.css_files(spark, sf_dir)).select("path", "node_type", "name", "line", "pseudo_state")


@register("css_ambiguities", f"SELECT DISTINCT {_SHEET}, k.kind, k.expression FROM part, (VALUES ('responsive_breakpoint', '@media (max-width: 1px)'), ('css_animation_defined', '@keyframes old'), ('css_animation_defined', '@keyframes spin'), ('import_target_unresolved', 'base.css')) k(kind, expression)")
def css_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_css.ambiguities(D.css_files(spark, sf_dir)).select("path", "kind", "expression")


@register("css_imports", f"SELECT DISTINCT {_SHEET}, 'base.css' AS expression FROM part")
def css_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_css.ambiguities(D.css_files(spark, sf_dir)).where("kind = 'import_target_unresolved'").select("path", "expression")


@register("css_edges", f"SELECT path, 'defines' AS edge, path || '::StyleClass::part-' || k AS target FROM {_RULE} UNION ALL SELECT path, 'defines', path || '::StyleID::p' || k FROM {_RULE} UNION ALL SELECT DISTINCT path, 'defines', path || '::StyleElement::li' FROM {_RULE}")
def css_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_css.extract(D.css_files(spark, sf_dir))[1].select(F.col("`from`").alias("path"), "edge", F.col("to").alias("target"))


@register("v1_file", "SELECT 'nations/n' || n_nationkey || '.py' AS path, 'json,suppliers.serve' AS imports, '' AS calls, 'N' || n_nationkey AS classes, count(c_custkey) AS methods, 0::BIGINT AS functions FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'lib/suppliers.py', '', '', '', 0, count(*) + 1 FROM supplier")
def v1_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = file_profile.profiles(D.python_files(spark, sf_dir))
    listed = lambda c: F.array_join(c, ",")
    return found.select("path", listed("imports").alias("imports"), listed("calls").alias("calls"), listed(F.col("classes.name")).alias("classes"), F.size(F.flatten("classes.methods")).cast("long").alias("methods"), F.size("functions").cast("long").alias("functions"))


@register("files_importing", "SELECT 'nations/n' || n_nationkey || '.py' AS path FROM nation")
def files_importing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_profile.files_importing(file_profile.profiles(D.python_files(spark, sf_dir)), "json")


@register("layer", "SELECT path, CASE WHEN contains(path, 'graphloom') THEN 'Meta-Tooling' WHEN contains(path, 'pages') OR contains(path, 'app.py') THEN 'UI' WHEN contains(path, 'backend.py') THEN 'Application' WHEN contains(path, 'config.py') OR contains(path, 'utils.py') THEN 'Infrastructure' ELSE 'Unknown' END AS layer FROM (SELECT url || CASE WHEN contains(url, '/en/') THEN '/pages' WHEN contains(url, 'http:') THEN '/utils.py' ELSE '' END AS path FROM pages)")
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "SELECT url || CASE WHEN contains(url, '/en/') THEN '/pages' WHEN contains(url, 'http:') THEN '/utils.py' ELSE '' END AS path FROM pages").select("path", layer("path").alias("layer"))
