"""A code graph and source files derived from business tables, by SQL that Spark and DuckDB share.

Regions are files, nations classes, customers methods, suppliers functions and parts variables; keys
become edges of definition, containment, calls, reads and writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = "region nation customer supplier part orders lineitem documents pages".split()

_NODE_COLUMNS = "seq, id, node_type, name, file_path, hash, line_start, line_end, docstring, is_async, decorator, arg, tag, state"
NODES = f"""
SELECT {_NODE_COLUMNS} FROM (
  SELECT CAST(r_regionkey AS BIGINT) AS seq, 'region:' || CAST(r_regionkey AS STRING) AS id, 'File' AS node_type, r_name AS name,
    'src/' || lower(r_name) || '/views.py' AS file_path, md5(r_name) AS hash, CAST(NULL AS INT) AS line_start, CAST(NULL AS INT) AS line_end,
    CAST(NULL AS STRING) AS docstring, CAST(NULL AS BOOLEAN) AS is_async, CAST(NULL AS STRING) AS decorator, CAST(NULL AS STRING) AS arg, CAST(NULL AS STRING) AS tag, CAST(NULL AS STRING) AS state
  FROM region
  UNION ALL
  SELECT 1000 + n_nationkey, 'nation:' || CAST(n_nationkey AS STRING), 'Class', n_name, NULL, NULL, n_nationkey * 10 + 1, n_nationkey * 10 + 9, 'The nation ' || n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL
  SELECT 1000000000 + c_custkey, 'customer:' || CAST(c_custkey AS STRING), 'Method', c_name, NULL, NULL, CAST(c_custkey AS INT), CAST(c_custkey AS INT) + 3, c_mktsegment, c_acctbal < 0,
    CASE c_mktsegment WHEN 'BUILDING' THEN '@login_required' WHEN 'MACHINERY' THEN '@get(...)' END, CASE WHEN c_acctbal < 0 THEN 'request' ELSE 'self' END, NULL, NULL FROM customer
  UNION ALL
  SELECT 2000000000 + s_suppkey, 'supplier:' || CAST(s_suppkey AS STRING), 'Function', s_name, NULL, NULL, CAST(s_suppkey AS INT), NULL, NULL, false, CASE WHEN s_acctbal < 0 THEN '@receiver(...)' END, CASE WHEN s_acctbal > 5000 THEN 'request' END, NULL, NULL FROM supplier
  UNION ALL
  SELECT 3000000000 + p_partkey, 'part:' || CAST(p_partkey AS STRING), 'Variable', p_name, NULL, NULL, p_size, p_size, NULL, NULL, NULL, NULL, lower(p_brand), CASE WHEN p_size > 25 THEN 'hover' END FROM part
) n
"""
_CALLS = """
  SELECT 2000000000000000 + o_custkey * 100000000 + l_suppkey AS seq, 'customer:' || CAST(o_custkey AS STRING) AS source, 'supplier:' || CAST(l_suppkey AS STRING) AS target, 'calls' AS type, min(l_linenumber) AS call_line
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey"""
_PARTS = """
  SELECT 4000000000000000000 + l_suppkey * 10000000000 + l_partkey * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS seq, 'supplier:' || CAST(l_suppkey AS STRING) AS source, 'part:' || CAST(l_partkey AS STRING) AS target,
    CASE WHEN l_returnflag = 'R' THEN 'writes_to' ELSE 'reads_from' END AS type, CAST(NULL AS INT) AS call_line
  FROM lineitem GROUP BY l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, CASE WHEN l_returnflag = 'R' THEN 'writes_to' ELSE 'reads_from' END"""
EDGES = f"""
SELECT seq, source, target, type, call_line FROM (
  SELECT CAST(n_nationkey AS BIGINT) AS seq, 'region:' || CAST(n_regionkey AS STRING) AS source, 'nation:' || CAST(n_nationkey AS STRING) AS target, 'defines' AS type, CAST(NULL AS INT) AS call_line FROM nation
  UNION ALL
  SELECT 1000000000 + c_custkey, 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'contains_member', NULL FROM customer
  UNION ALL {_CALLS}
  UNION ALL {_PARTS}
) e
"""
#: Also edges that the schema forbids, ends that are no nodes, an unknown type and a missing end.
BAD_EDGES = f"""
SELECT seq, source, target, type, call_line FROM ({EDGES}) good
UNION ALL SELECT 5000000000000000000 + s_suppkey, 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'contains_member', NULL FROM supplier
UNION ALL SELECT 5100000000000000000 + n_nationkey, 'nation:' || CAST(n_nationkey AS STRING), 'continent:' || CAST(n_regionkey AS STRING), 'extends', NULL FROM nation
UNION ALL SELECT 5200000000000000000 + r_regionkey, 'world:1', 'region:' || CAST(r_regionkey AS STRING), 'imports', NULL FROM region
UNION ALL SELECT 5300000000000000000 + r_regionkey, 'region:' || CAST(r_regionkey AS STRING), 'region:0', 'borders', NULL FROM region
UNION ALL SELECT 5400000000000000000 + r_regionkey, 'region:' || CAST(r_regionkey AS STRING), NULL, 'imports', NULL FROM region
"""
#: One function that calls others too.
CALL_EDGES = f"""
SELECT seq, source, target, type, call_line FROM ({EDGES}) good
UNION ALL SELECT 5000000000000000000 + s_suppkey, 'supplier:1', 'supplier:' || CAST(s_suppkey AS STRING), 'calls', CAST(s_suppkey AS INT) FROM supplier WHERE s_suppkey > 1
"""
#: Edges of the rules: nations extend the first of their region, suppliers decorate each other.
ROLE_EDGES = f"""
SELECT seq, source, target, type, call_line FROM ({EDGES}) good
UNION ALL SELECT 5000000000000000000 + n.n_nationkey, 'nation:' || CAST(n.n_nationkey AS STRING), 'nation:' || CAST(m.k AS STRING), 'extends', NULL FROM nation n JOIN (SELECT n_regionkey AS r, min(n_nationkey) AS k FROM nation GROUP BY n_regionkey) m ON n.n_regionkey = m.r
UNION ALL SELECT 5100000000000000000 + s_suppkey, 'supplier:1', 'supplier:' || CAST(s_suppkey AS STRING), 'decorates', NULL FROM supplier WHERE s_acctbal > 5000
UNION ALL SELECT 5200000000000000000 + r_regionkey, 'region:' || CAST(r_regionkey AS STRING), 'region:0', 'imports', NULL FROM region
UNION ALL SELECT 5300000000000000000 + s_suppkey, 'region:' || CAST(n_regionkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'defines', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
AMBIGUITIES = """
SELECT 'amb:' || CAST(c_custkey AS STRING) AS id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'call_target_unknown' WHEN 'MACHINERY' THEN 'decorator_unknown' WHEN 'FURNITURE' THEN 'import_module_unknown' WHEN 'AUTOMOBILE' THEN 'schema_violation' ELSE 'inheritance_target_unproven' END AS kind,
  'region' AS source_file, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'nation:' || CAST(c_nationkey AS STRING) ELSE 'customer:' || CAST(c_custkey AS STRING) END AS source_scope,
  CASE WHEN c_acctbal < 0 THEN 'render(' || c_name || ')' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'models.Model' ELSE 'load(' || c_name || ')' END AS expression,
  CASE WHEN c_acctbal > 9900 THEN NULL ELSE 'not proven' END AS reason, CASE WHEN c_acctbal > 9000 THEN 'likely' ELSE 'unresolved' END AS confidence, 'agent' AS resolver
FROM customer
"""
#: Documents as files, now and before: French ones are new, Spanish ones are gone, German ones changed.
NEW_FILES = "SELECT doc_id AS seq, 'doc:' || CAST(doc_id AS STRING) AS id, 'File' AS node_type, source AS name, source || '/' || CAST(doc_id AS STRING) AS file_path, CASE WHEN n_chars > 5000 THEN NULL ELSE md5(text) END AS hash FROM documents WHERE lang <> 'es'"
OLD_FILES = "SELECT doc_id AS seq, 'doc:' || CAST(doc_id AS STRING) AS id, 'File' AS node_type, source AS name, source || '/' || CAST(doc_id AS STRING) AS file_path, CASE WHEN lang = 'de' THEN md5('old ' || text) ELSE md5(text) END AS hash FROM documents WHERE lang <> 'fr'"
#: The graph before: ASIA changed, EUROPE is new, customers of one segment were not there, others are gone.
OLD_NODES = f"""
SELECT seq, id, node_type, name, file_path, CASE WHEN name = 'ASIA' AND node_type = 'File' THEN md5('old') ELSE hash END AS hash FROM ({NODES}) n WHERE NOT (node_type = 'File' AND name = 'EUROPE') AND coalesce(docstring, '') <> 'MACHINERY'
UNION ALL SELECT 9000000000 + n_nationkey, 'gone:' || CAST(n_nationkey AS STRING), 'Class', n_name, NULL, NULL FROM nation
"""
#: The enriched graph of the equivalence check: a type changed, nodes lost and new, edges lost and new.
OTHER_NODES = f"""
SELECT seq, id, CASE WHEN node_type = 'Variable' AND state = 'hover' THEN 'Config' ELSE node_type END AS node_type FROM ({NODES}) n WHERE coalesce(docstring, '') <> 'MACHINERY'
UNION ALL SELECT 9000000000 + n_nationkey, 'new:' || CAST(n_nationkey AS STRING), 'Class' FROM nation
"""
OTHER_EDGES = f"""
SELECT seq, source, target, type FROM ({EDGES}) e WHERE type <> 'writes_to'
UNION ALL SELECT 5000000000000000000 + n_nationkey, 'nation:' || CAST(n_nationkey AS STRING), 'nation:0', 'extends' FROM nation
"""
#: Second-level records: for nodes (null where there is none) and for ambiguities.
LEVEL2 = f"""
SELECT id, CASE WHEN state IS NULL AND node_type <> 'File' THEN 'does ' || name END AS intent, CASE WHEN line_start > 20 THEN 'summary' END AS summary, line_start AS complexity,
  CASE WHEN name = 'ASIA' THEN md5('old') ELSE coalesce(hash, 'unknown') END AS at_hash, node_type <> 'Method' AND name <> 'AFRICA' AS said
FROM ({NODES}) n WHERE NOT (node_type = 'File' AND name = 'EUROPE')
"""
RESOLVED = f"""
SELECT id, CASE WHEN kind = 'decorator_unknown' THEN NULL WHEN kind = 'call_target_unknown' THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN expression LIKE 'render%' THEN 'supplier:1' WHEN confidence = 'likely' THEN 'nowhere' END AS target, CASE WHEN confidence = 'likely' THEN 0.9 ELSE 0.5 END AS sure, kind <> 'schema_violation' AS said
FROM ({AMBIGUITIES}) a
"""
#: Fragments of two languages: raw ids and edges between them; some nodes occur in both.
FRAGMENT_NODES = """
SELECT 0 AS fragment, CAST(o_orderkey AS BIGINT) AS seq, 'orders/' || CAST(o_custkey AS STRING) || '.py' AS id, 'File' AS node_type, CAST(o_custkey AS STRING) || '.py' AS name, 'orders/' || CAST(o_custkey AS STRING) || '.py' AS file_path, o_orderpriority AS docstring FROM orders
UNION ALL SELECT 0, 1000000000 + l_orderkey * 10 + l_linenumber, 'lines.py::' || CAST(l_partkey AS STRING), 'Function', 'line_' || CAST(l_partkey AS STRING), NULL, l_linestatus FROM lineitem
UNION ALL SELECT 1, CAST(p_partkey AS BIGINT), 'part_' || CAST(p_partkey AS STRING), 'Template', p_name, NULL, p_brand FROM part
UNION ALL SELECT 1, 1000000000 + s_suppkey, 's_' || CAST(s_suppkey AS STRING), NULL, s_name, 'sup/' || CAST(s_nationkey AS STRING), NULL FROM supplier
"""
FRAGMENT_EDGES = """
SELECT 0 AS fragment, l_orderkey * 10 + l_linenumber AS seq, 'defines' AS edge, 'orders/' || CAST(o_custkey AS STRING) || '.py' AS from_id, 'lines.py::' || CAST(l_partkey AS STRING) AS to_id, l_linenumber AS call_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 1, l_orderkey * 10 + l_linenumber, 'submits_form', 'part_' || CAST(l_partkey AS STRING), 's_' || CAST(l_suppkey AS STRING), NULL FROM lineitem
UNION ALL SELECT 1, 1000000000000 + s_suppkey, 'imports', 's_' || CAST(s_suppkey AS STRING), 'elsewhere', NULL FROM supplier
"""
#: Import requests of files against modules; paths share their last parts.
MODULES = "SELECT 'src/' || lower(c_mktsegment) || '/n' || CAST(c_nationkey AS STRING) || '/mod' || CAST(c_custkey AS STRING) || '.py' AS module FROM customer"
REQUESTS = """
SELECT 'orders/' || CAST(o_orderkey AS STRING) || '.py' AS path, CASE o_orderstatus WHEN 'F' THEN 'mod' || CAST(o_custkey AS STRING) || '.py' WHEN 'O' THEN 'n1/mod' || CAST(o_custkey AS STRING) || '.py' ELSE 'mod' || CAST(o_custkey AS STRING) END AS guess, o_orderpriority LIKE '1%' AS exact
FROM orders
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    """The tables as temporary views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(sql)


def nodes(spark: SparkSession, sf_dir: str, sql: str = NODES) -> DataFrame:
    """The graph's nodes with signature and attributes as an extractor gives them."""
    df = table(spark, sf_dir, sql)
    if "decorator" not in df.columns:
        return df
    listed = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    signature = F.when(F.col("node_type").isin("Function", "Method"), F.struct(listed("arg").alias("args"), none.alias("defaults"), listed("decorator").alias("decorators"), F.lit(None).cast("string").alias("returns")))
    pairs = F.filter(F.array(F.struct(F.lit("tag").alias("k"), F.col("tag").alias("v")), F.struct(F.lit("pseudo_state").alias("k"), F.col("state").alias("v"))), lambda x: x["v"].isNotNull())
    return df.withColumns({"signature": signature, "attributes": F.when(F.col("tag").isNotNull(), F.map_from_entries(pairs)), "analysis_confidence": F.lit("structural")}).drop("decorator", "arg", "tag", "state")


def edges(spark: SparkSession, sf_dir: str, sql: str = EDGES) -> DataFrame:
    return table(spark, sf_dir, sql)


def ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, AMBIGUITIES)


def level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(
        "intent", "summary", F.col("complexity").alias("complexity_score"), F.array(F.lit("derived")).alias("domain_tags"), F.lit(None).cast("boolean").alias("pure_logic"), F.lit(None).cast("array<string>").alias("side_effects"),
        F.col("at_hash").alias("enriched_at_hash"), F.lit("2026-01-01").alias("enriched_at"),
    )
    return table(spark, sf_dir, LEVEL2).select("id", F.when(F.col("said"), record).alias("llm_enrichment"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.struct("status", F.col("target").alias("probable_target"), F.col("sure").cast("double").alias("confidence"), F.lit("").alias("reasoning"))
    return table(spark, sf_dir, RESOLVED).select("id", F.when(F.col("said"), answer).alias("llm_resolution"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a module for each nation with a class that has a method for each customer, which
    calls the function of a supplier module; one module with a function for each supplier."""
    views(spark, sf_dir)
    lines = spark.sql("SELECT c_nationkey AS n, c_custkey AS k FROM customer")
    nation = spark.sql("SELECT n_nationkey AS n, n_name AS name FROM nation")
    body = F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(F.lit("\n    def c"), k.cast("string"), F.lit("(self):\n        return serve(self.key)")))
    methods = lines.groupBy("n").agg(F.array_join(body, "").alias("body"))
    text = F.concat(F.lit("from suppliers import serve\nimport json\n\n\nclass N"), F.col("n").cast("string"), F.lit(":\n    key = 1"), F.coalesce("body", F.lit("")), F.lit("\n"))
    modules = nation.join(methods, "n", "left").select(F.concat(F.lit("nations/n"), F.col("n").cast("string"), F.lit(".py")).alias("path"), text.alias("content"))
    served = spark.sql("SELECT s_suppkey AS k FROM supplier").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(F.lit("def s"), k.cast("string"), F.lit("():\n    return serve(0)\n\n\n"))), "").alias("body"))
    return modules.unionAll(served.select(F.lit("lib/suppliers.py"), F.concat(F.lit("def serve(key):\n    return key\n\n\n"), "body")))


_SCOPED = [
    '"""About K."""', "x = 1", "x = 2", "", "", "def g():", "    y = 1", "    y = 2", "    return y", "", "", "class C:", "    z = 1", "    z: int = 2", "", "    def m(self, g, b=K) -> int:",
    '        """Method K."""', "        self.n()", "        return g()", "", "    @staticmethod", '    def n(c="t"):', "        g()", "",
]


def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a module for each supplier with names that are bound twice, looked up from inner
    scopes and hidden by parameters."""
    lines = ", ".join(f"'{line}'" for line in _SCOPED)
    return table(spark, sf_dir, f"SELECT 'mods/m' || CAST(s_suppkey AS STRING) || '.py' AS path, replace(concat_ws(chr(10), {lines}), 'K', CAST(s_suppkey AS STRING)) AS content FROM supplier")


def css_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a stylesheet for each brand with a class and an id for each part."""
    parts = table(spark, sf_dir, "SELECT lower(p_brand) AS brand, p_partkey AS k, p_size AS z FROM part")
    rule = lambda x: F.concat(F.lit(".part-"), x["k"].cast("string"), F.when(x["z"] > 25, F.lit(":hover")).otherwise(""), F.lit(", #p"), x["k"].cast("string"), F.lit(" > li { width: "), x["z"].cast("string"), F.lit("px }\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "z"))), rule), "")
    head = F.concat(F.lit('@import "base.css";\n/* .no { } @keyframes old */\n@media (max-width: 1px) { }\n@keyframes spin { }\n'))
    return parts.groupBy("brand").agg(body.alias("body")).select(F.concat(F.replace("brand", F.lit("#"), F.lit("-")), F.lit(".css")).alias("path"), F.concat(head, "body").alias("content"))


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the pages, by number."""
    return table(spark, sf_dir, "SELECT 'page/' || CAST(page_id AS STRING) || '.html' AS path, html AS content FROM pages")


def shop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a template for each supplier with every kind of link."""
    return table(
        spark, sf_dir,
        """SELECT 'shop/' || CAST(s_suppkey AS STRING) || '.html' AS path,
        '<link rel="stylesheet" href="/s' || CAST(s_nationkey AS STRING) || '.css"><link rel="next" href="/n"><img src="logo.png">' || chr(10) || '<form action="/buy/' || CAST(s_suppkey AS STRING) || '" method="post"><a href="https://x.example/' || s_name || '">x</a>'
        || '<button hx-post="/cart" hx-target="#cart" id="b">+</button></form>' || chr(10) || '<a href="{{ url }}">y</a><script src="//cdn.example/x.js"></script><div hx-get="/more" hx-trigger="revealed"></div><meta property="og:image" content="/og.png">' AS content FROM supplier""",
    )
