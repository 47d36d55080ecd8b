"""A code graph and what can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .operators import diff, extract_css, extract_html, extract_python, merge, overlay, query, rules, traverse, validate
from .schema import AMBIGUITY, NODE_TYPES, SIGNATURE
from .sources.files import EXCLUDED_FOLDERS, LANGUAGES, scan_files
from .sources.shared import scratch, spool

_NODE = f"seq long, id string, node_type string, name string, file_path string, hash string, line_start int, line_end int, docstring string, is_async boolean, analysis_confidence string, signature {SIGNATURE}, attributes map<string,string>, semantic_roles array<string>"
#: Places in a file and files in a fragment that seq has room for; what is left is for fragments.
PLACES, FILES = 2**31, 2**29
_EDGE = "seq long, source string, target string, type string, call_line int"
_LOG, _META = "language string, path string, error string", "source string, fragments array<string>, enriched boolean"
_PARTS = ("nodes", "edges", "ambiguities")


class GovernanceError(ValueError):
    """Rules that no enrichment should run with."""


@dataclass(frozen=True)
class CodeGraph:
    """files: (path, content); log: files that could not be read or parsed; meta: one row about the graph."""

    nodes: DataFrame
    edges: DataFrame
    ambiguities: DataFrame
    files: DataFrame | None = None
    log: DataFrame | None = None
    meta: DataFrame | None = None

    # ---- building and keeping -------------------------------------------------------------

    @classmethod
    def build(cls, spark: SparkSession, root: str, languages: tuple[str, ...] = ("python", "html", "css"), compat: bool = False, folders: tuple[str, ...] = EXCLUDED_FOLDERS, names: tuple[str, ...] = ()) -> "CodeGraph":
        """Scan, extract and merge a source tree, without the folders and file names excluded."""
        files = {k: spool(scan_files(spark, root, f"*.{end}", folders, names), "files") for end, k in LANGUAGES.items() if k in languages}
        return cls.from_files(files, compat)

    @classmethod
    def from_files(cls, files: dict[str, DataFrame], compat: bool = False, fragments: str | None = None, parsed: str | None = None, before: str | None = None) -> "CodeGraph":
        """files: language -> (path, content) and, where known, error.  The graph is written to the shared
        folder, so that sources are read and parsed once, whatever is asked of it.  fragments: a folder
        in which each language's part is kept as it was before merging.  parsed: a folder for what the
        parsers gave; with that of an earlier graph as before, only files that changed are parsed."""
        with scratch():
            return cls._merged(files, compat, fragments, parsed, before)

    @classmethod
    def _merged(cls, files: dict[str, DataFrame], compat: bool, fragments: str | None, parsed: str | None, before: str | None) -> "CodeGraph":
        at = lambda folder, language: folder and f"{folder}/{language}"
        parts = {language: _fragment(language, f, compat, at(parsed, language), at(before, language)) for language, f in files.items()}
        if fragments:
            for language, p in parts.items():
                for name, df in zip((*_PARTS, "log"), p):
                    df.write.mode("overwrite").parquet(f"{fragments}/{language}/{name}")
        nodes, edges, doubts = merge.merge(*([p[i] for p in parts.values()] for i in range(3)), compat)
        order = lambda df: df.withColumn("seq", F.col("fragment") * F.lit(PLACES * FILES) + F.col("seq")).drop("fragment")
        nodes = order(nodes)
        for f in _fields(_NODE):
            if f[0] not in nodes.columns:
                nodes = nodes.withColumn(f[0], F.lit(None).cast(f[1]))
        every = log = None
        for language, f in files.items():
            own = f.where("content IS NOT NULL").select("path", "content")
            every = own if every is None else every.unionAll(own)
            log = parts[language][3] if log is None else log.unionAll(parts[language][3])
        meta = nodes.sparkSession.createDataFrame([("graphloom", list(files), False)], _META)
        keep = lambda df, name: spool(df, name, keep=True)
        return cls(keep(nodes, "nodes"), keep(order(edges), "edges"), keep(doubts.drop("fragment", "seq"), "ambiguities"), every, keep(log, "log"), meta)

    def save(self, path: str) -> None:
        for name in (*_PARTS, "log", "meta"):
            if (df := getattr(self, name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, files: DataFrame | None = None) -> "CodeGraph":
        """A saved graph; the enriched one below path if there is one, else the raw one."""
        there = lambda sub, n: (p := spark._jvm.org.apache.hadoop.fs.Path(f"{path}{sub}/{n}")).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        for sub in ("/enriched", "/raw", ""):
            if there(sub, "nodes"):
                more = (spark.read.parquet(f"{path}{sub}/{n}") if there(sub, n) else None for n in ("log", "meta"))
                return cls(*(spark.read.parquet(f"{path}{sub}/{n}") for n in _PARTS), files, *more)
        raise FileNotFoundError(path)

    def export_json(self, path: str) -> None:
        """One JSON document {ambiguities, edges, nodes} with sorted keys, for exchange: one file, which
        one task writes line by line from sorted partitions, so it needs no memory of the graph's size."""
        spark, out = self.nodes.sparkSession, None
        for i, name in enumerate(sorted(_PARTS)):
            df = getattr(self, name)
            body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
            rows = df.select(F.lit(2 * i + 1).alias("part"), F.col("seq").cast("long").alias("seq") if "seq" in df.columns else F.lit(0).cast("long").alias("seq"), body.alias("value"))
            first = rows.agg(F.min(F.struct("seq", "value")).alias("first"))
            comma = F.when(F.struct("seq", "value") == F.col("first"), "").otherwise(",")
            rows = rows.distinct().crossJoin(F.broadcast(first)).select("part", "seq", F.concat(comma, "value").alias("value"))
            opened = spark.createDataFrame([(2 * i, 0, f'{"]," if i else "{"}"{name}":[')], "part int, seq long, value string")
            out = opened.unionAll(rows) if out is None else out.unionAll(opened).unionAll(rows)
        out = out.unionAll(spark.createDataFrame([(2 * len(_PARTS), 0, "]}")], "part int, seq long, value string"))
        # Of one seq the row without a comma comes first.
        out.orderBy("part", "seq", F.col("value").startswith(","), "value").select("value").coalesce(1).write.mode("overwrite").text(path)


    @classmethod
    def import_json(cls, spark: SparkSession, path: str) -> "CodeGraph":
        """A JSON document {nodes, edges, ambiguities}, with any of the known names of edge ends."""
        edge = "source string, target string, type string, relation_type string, edge string, `from` string, `to` string, call_line int"
        node = ", ".join(f"{n} {t}" for n, t in _fields(_NODE) if n != "seq") + ", type string, file_hash string"
        doc = spark.read.schema(f"nodes array<struct<{_struct(node)}>>, edges array<struct<{_struct(edge)}>>, ambiguities array<struct<{_struct(AMBIGUITY)}>>").option("multiLine", True).json(path)
        nodes = doc.select(F.posexplode("nodes").alias("seq", "n")).select(F.col("seq").cast("long").alias("seq"), "n.*")
        nodes = nodes.withColumns({"node_type": F.coalesce("node_type", "type"), "hash": F.coalesce("file_hash", "hash")}).drop("type", "file_hash")
        edges = doc.select(F.posexplode("edges").alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), "e.*")
        return cls(nodes, query.normalize_edges(edges), doc.select(F.explode("ambiguities").alias("a")).select("a.*"))

    # ---- questions -------------------------------------------------------------------------

    def search(self, q: str, node_type: str | None = None, limit: int | None = query.LIMIT) -> DataFrame:
        return query.search(self.nodes, q, node_type, limit)

    def locate(self, node_id: str) -> DataFrame:
        return query.locate(self.nodes, node_id)

    def read(self, node_id: str) -> DataFrame:
        if self.files is None:
            raise ValueError("this graph has no files to read from")
        return query.read_content(self.nodes, self.files, node_id)

    def details(self, node_id: str) -> DataFrame:
        return query.details(self.nodes, node_id)

    def impact(self, node_id: str, depth: int = 2, compat: str | None = None) -> DataFrame:
        if compat == "dfs":
            return traverse.reach_ordered(self.nodes, self.edges, node_id, depth, reverse=True)
        return traverse.impact(self.nodes, self.edges, node_id, depth)

    def dependencies(self, node_id: str, depth: int = 1, compat: str | None = None) -> DataFrame:
        if compat == "dfs":
            return traverse.reach_ordered(self.nodes, self.edges, node_id, depth)
        return traverse.dependencies(self.nodes, self.edges, node_id, depth)

    def call_graph(self, node_id: str) -> DataFrame:
        return query.call_graph(self.nodes, self.edges, node_id)

    def stats(self) -> DataFrame:
        """(nodes, edges, meta), meta being JSON, {} where nothing is known."""
        meta = self.nodes.sparkSession.createDataFrame([("{}",)], "meta string") if self.meta is None else self.meta.select(F.to_json(F.struct(*self.meta.columns)).alias("meta"))
        return query.stats(self.nodes, self.edges).crossJoin(meta)  # three tables of one row

    def stats_by_type(self) -> DataFrame:
        return query.stats_by_type(self.nodes)

    def list_files(self, compat: bool = False) -> DataFrame:
        return query.list_files(self.nodes, compat)

    # ---- enriching and checking ------------------------------------------------------------

    def enrich(self, rule_set: tuple[rules.Rule, ...] = rules.RULES, loose: bool = True, compat: bool = False, frameworks: tuple[str, ...] | None = None, gate: bool = True) -> "CodeGraph":
        """The graph with semantic roles, by the rules of the frameworks named (of all if none are).
        Rules with errors stop it, unless gate is off."""
        rule_set = _governed(rule_set, frameworks, gate)
        found = rules.roles(self.nodes, self.edges, self.ambiguities, rule_set, loose, compat)
        return replace(self, nodes=rules.enriched(self.nodes, found), meta=self._enriched())

    def _enriched(self) -> DataFrame | None:
        return None if self.meta is None else self.meta.withColumn("enriched", F.lit(True))

    def enrich_from(self, old: "CodeGraph", rule_set: tuple[rules.Rule, ...] = rules.RULES, loose: bool = True, frameworks: tuple[str, ...] | None = None, gate: bool = True) -> "CodeGraph":
        """As enrich(), but nodes of unchanged files keep what they had in old."""
        rule_set = _governed(rule_set, frameworks, gate)
        status = self.diff(old)
        found = rules.roles(self.nodes, self.edges, self.ambiguities, rule_set, loose)
        done = diff.incremental(self.nodes, status, old.nodes, found)
        return replace(self, nodes=self.nodes.drop("semantic_roles").join(done.drop("action"), "id"), meta=self._enriched())

    def diff(self, old: "CodeGraph | None", compat: bool = False) -> DataFrame:
        return diff.first_run(self.nodes) if old is None else diff.node_status(self.nodes, old.nodes, self.edges, compat)

    def write_diff(self, old: "CodeGraph | None", path: str) -> DataFrame:
        """Statuses of files and nodes and their counts, as tables below path; the counts."""
        old_nodes = old.nodes if old else self.nodes.limit(0)
        diff.file_status(self.nodes, old_nodes).write.mode("overwrite").parquet(f"{path}/files")
        self.diff(old).write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        diff.status_counts(spark.read.parquet(f"{path}/nodes")).write.mode("overwrite").parquet(f"{path}/stats")
        return spark.read.parquet(f"{path}/stats")

    def context(self) -> DataFrame:
        return overlay.context(self.nodes, self.edges, self.ambiguities)

    def validate(self) -> DataFrame:
        return validate.validate(self.nodes, self.edges, self.ambiguities)

    def equivalence(self, other: "CodeGraph") -> DataFrame:
        return validate.equivalence((self.nodes, self.edges, self.ambiguities), (other.nodes, other.edges, other.ambiguities))

    def pending(self, level2: DataFrame | None, mode: str = "incremental") -> DataFrame:
        return overlay.pending(self.nodes, level2, mode)


def _fields(ddl: str) -> list[tuple[str, str]]:
    """Top-level (name, type) of a DDL string."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind))
            start = i + 1
    return out


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in _fields(ddl))


def _ranks(files: DataFrame) -> DataFrame:
    """(ranked, rank): the place of each path among the sorted paths.  It comes from a range
    partitioning, so no single task sorts all paths."""
    ranged = spool(files.select(F.col("path").alias("ranked")).distinct().repartitionByRange("ranked").withColumn("part", F.spark_partition_id()), "paths")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return ranged.join(F.broadcast(sizes), "part").select("ranked", (F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("ranked"))).alias("rank"))


def _ordered(df: DataFrame, ranks: DataFrame, path: str, place: str) -> DataFrame:
    """df with seq: its path's rank times PLACES, plus its place in the file; without those two."""
    seq = F.col("rank") * F.lit(PLACES) + F.col(place).cast("long")
    return df.join(ranks, F.col(path) == F.col("ranked")).withColumn("seq", seq).drop("rank", "ranked", path, place)


def _fragment(language: str, files: DataFrame, compat: bool, parsed: str | None, before: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ambiguities) with seq, and log, for one language."""
    unread = files.where("error IS NOT NULL").select("path", "error") if "error" in files.columns else files.select("path", F.lit(None).cast("string").alias("error")).where("false")
    files = files.where("content IS NOT NULL").select("path", "content")
    ranks = spool(_ranks(files), "ranks")
    told = lambda df: df.select(F.lit(language).alias("language"), "path", "error")
    if language == "python":
        found = extract_python.extract(files, compat, _read(files, before, "rows"))
        found = _written(found, parsed, "rows") if parsed else spool(found, "python")
        part = lambda c: _ordered(found.select("path", F.posexplode(c).alias("at", "x")), ranks, "path", "at").select("seq", "x.*")
        failed = found.where("log IS NOT NULL").select("path", F.col("log").alias("error"))
        return part("nodes"), part("edges"), part("ambiguities"), told(unread.unionAll(failed))
    parse, extract = (extract_html.tags, extract_html.extract) if language == "html" else (lambda f: extract_css.selectors(f, compat), extract_css.extract)
    nodes, edges, doubts = extract(files, compat, _rows(files, parse, parsed, before) if parsed else None)
    nodes = _ordered(nodes.withColumn("path", F.substring_index("id", "::", 1)), ranks, "path", "at")
    if language == "html":
        edges = edges.withColumn("at", F.col("first.at") * extract_html.RULES + F.col("first.rank")).drop("first")
    edges = _ordered(edges.withColumn("path", F.col("`from`")), ranks, "path", "at")
    return nodes, edges, doubts.withColumn("seq", F.lit(0).cast("long")), told(unread)


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _read(df: DataFrame, folder: str | None, name: str) -> DataFrame | None:
    return None if folder is None else df.sparkSession.read.parquet(f"{folder}/{name}")


def _rows(files: DataFrame, parse, parsed: str, before: str | None) -> DataFrame:
    """What a parser gives for the files; of files that are as they were before, what it gave then."""
    own = files.select("path", "content", F.md5(F.encode("content", "UTF-8")).alias("digest"))
    listed = _written(own.select("path", "digest"), parsed, "files")
    if before is None:
        return _written(parse(files), parsed, "rows")
    same = listed.join(_read(files, before, "files"), ["path", "digest"], "left_semi").select("path")
    kept = _read(files, before, "rows").join(same, "path", "left_semi")
    return _written(parse(files.join(same, "path", "left_anti")).unionByName(kept), parsed, "rows")


def _governed(rule_set: tuple[rules.Rule, ...], frameworks: tuple[str, ...] | None, gate: bool) -> tuple[rules.Rule, ...]:
    if frameworks is not None:
        rule_set = tuple(r for r in rule_set if r.framework in frameworks)
    wrong = [x for x in rules.check_rules(rule_set, NODE_TYPES) if x[0] == "error"] if gate else ()
    if wrong:
        raise GovernanceError("; ".join(f"{place}: {problem}" for _, place, problem in wrong))
    return rule_set
