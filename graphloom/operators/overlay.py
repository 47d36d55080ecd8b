"""Bookkeeping of the second level of enrichment, which a language model or a person writes.

Its records are ``llm_enrichment`` on nodes and ``llm_resolution`` on ambiguities; this module says
what is pending, how far it is, whether it holds together, and puts given records onto a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import last_part
from ..sources.shared import spool
from .traverse import containment

#: Below this a resolution must stay unresolved.
SURE = 0.7
#: Nodes, edges or ambiguities of a file, each, that a row of context() holds.
CONTEXT_ITEMS = 100_000
#: What a model is asked about, and what it must say.
REQUIRED = ("intent", "summary", "complexity_score", "domain_tags", "enriched_at_hash", "enriched_at")


def pending(level1: DataFrame, level2: DataFrame | None, mode: str = "incremental") -> DataFrame:
    """(id, file_path, current_hash, reason, pending) of the file nodes: full_mode, new_file,
    not_enriched, hash_changed or unchanged."""
    files = level1.where("node_type = 'File'").select("id", F.coalesce("file_path", "name").alias("file_path"), F.col("hash").alias("current_hash"))
    if mode == "full":
        return files.withColumns({"reason": F.lit("full_mode"), "pending": F.lit(True)})
    if level2 is None:
        return files.withColumns({"reason": F.lit("new_file"), "pending": F.lit(True)})
    known = level2.select("id", F.lit(True).alias("known"), "llm_enrichment")
    said = F.col("llm_enrichment")
    reason = (
        F.when(F.col("known").isNull(), "new_file")
        .when(said.isNull(), "not_enriched")
        .when(~said["enriched_at_hash"].eqNullSafe(F.col("current_hash")), "hash_changed")
        .otherwise("unchanged")
    )
    return files.join(known, "id", "left").withColumn("reason", reason).select("id", "file_path", "current_hash", "reason", (F.col("reason") != "unchanged").alias("pending"))


def pending_summary(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count(F.lit(1)).alias("total_files"), F.count_if("pending").alias("pending_enrichment"), F.count_if(~F.col("pending")).alias("skipped"))


def stats(level1: DataFrame, ambiguities: DataFrame, level2: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of counts; coverage_percent has one digit, and is 0 for an empty graph."""
    total, doubts = level1.agg(F.count(F.lit(1)).alias("nodes_total")), ambiguities.agg(F.count(F.lit(1)).alias("ambiguities_total"))
    done = level2.agg(F.count_if(F.col("llm_enrichment").isNotNull()).alias("nodes_enriched"))
    status = F.col("llm_resolution.status")
    answered = resolved.agg(F.count_if(status == "resolved").alias("resolved"), F.count_if(F.col("llm_resolution").isNotNull() & ~F.coalesce(status == "resolved", F.lit(False))).alias("unresolved"))
    line = total.crossJoin(doubts).crossJoin(done).crossJoin(answered)
    return line.select(
        "nodes_total", "nodes_enriched", (F.col("nodes_total") - F.col("nodes_enriched")).alias("nodes_pending"),
        F.when(F.col("nodes_total") > 0, F.round(F.col("nodes_enriched") / F.col("nodes_total") * 100, 1)).otherwise(0.0).alias("coverage_percent"),
        "ambiguities_total", "resolved", "unresolved", (F.col("ambiguities_total") - F.col("resolved") - F.col("unresolved")).alias("not_processed"),
    )


def validate(level2: DataFrame, resolved: DataFrame) -> DataFrame:
    """(severity, issue, subject): intent or summary missing is a warning; a resolution without status,
    or resolved without target, an error."""
    said, answer = F.col("llm_enrichment"), F.col("llm_resolution")
    parts = [level2.where(said.isNotNull() & said[c].isNull()).select(F.lit("warning").alias("severity"), F.lit(f"missing {c}").alias("issue"), F.col("id").alias("subject")) for c in ("intent", "summary")]
    parts.append(resolved.where(answer.isNotNull() & answer["status"].isNull()).select(F.lit("error"), F.lit("missing status"), "id"))
    parts.append(resolved.where((answer["status"] == "resolved") & answer["probable_target"].isNull()).select(F.lit("error"), F.lit("missing target"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def check_fields(level2: DataFrame) -> DataFrame:
    """(id, field): required fields that a record lacks, and a complexity outside 1 to 5."""
    said = F.col("llm_enrichment")
    wrong = [F.when(said[c].isNull(), F.lit(c)) for c in REQUIRED]
    wrong.append(F.when(~said["complexity_score"].between(1, 5), F.lit("complexity_score")))
    return level2.where(said.isNotNull()).select("id", F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("field"))


def check_confidence(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, issue): resolved although not sure, and resolved to something that is no node."""
    sure = resolved.where("llm_resolution.status = 'resolved'").select("id", F.col("llm_resolution.probable_target").alias("target"), F.col("llm_resolution.confidence").alias("confidence"))
    unsure = sure.where(F.coalesce("confidence", F.lit(0.0)) < SURE).select("id", F.lit("resolved below the confidence limit").alias("issue"))
    ids = nodes.select(F.col("id").alias("target")).distinct()
    return unsure.unionAll(sure.join(ids, "target", "left_anti").select("id", F.lit("target is no node")))


def apply_records(nodes: DataFrame, records: DataFrame, fallback: str | None = None) -> DataFrame:
    """(id, llm_enrichment): records (rank, key, llm_enrichment) put onto nodes.  A key is a node's id, or
    its last part (after :) is in the id and, after ::, the node's name; of several keys the first by
    rank counts.  Nodes whose file path holds ``fallback`` and that no key names get a generic record."""
    tail = last_part("key", ":")
    keyed = records.select("rank", "key", F.col("llm_enrichment").alias("given"), tail.alias("tail"), last_part(tail, "::").alias("called"))
    exact = nodes.select("id").join(keyed.withColumnRenamed("key", "id"), "id").select("id", "rank", "given")
    named = nodes.select("id", F.col("name").alias("called")).join(keyed, "called").where(F.col("id").contains(F.col("tail"))).select("id", "rank", "given")
    first = exact.unionAll(named).groupBy("id").agg(F.min_by("given", "rank").alias("given"))
    met = nodes.select("id", "name", "file_path", "hash").join(first, "id", "left")
    stamp = F.col("given").withField("enriched_at_hash", F.coalesce("hash", F.lit("unknown")))
    if fallback is not None:
        none = F.lit(None)
        generic = F.struct(
            F.concat(F.lit("Part of a demo: "), "name").alias("intent"), F.lit("Not described yet").alias("summary"), F.lit(1).alias("complexity_score"), F.array(F.lit("demo")).alias("domain_tags"),
            none.cast("boolean").alias("pure_logic"), none.cast("array<string>").alias("side_effects"), F.coalesce("hash", F.lit("unknown")).alias("enriched_at_hash"), none.cast("string").alias("enriched_at"),
        )
        stamp = F.when(F.col("given").isNotNull(), stamp).when(F.col("file_path").contains(fallback), generic)
    return met.select("id", stamp.alias("llm_enrichment")).where("llm_enrichment IS NOT NULL")


def resolve_ambiguities(ambiguities: DataFrame) -> DataFrame:
    """ambiguities with llm_resolution for the kinds that can be told without a model."""
    answer = lambda status, target, confidence, why: F.struct(F.lit(status).alias("status"), F.lit(target).cast("string").alias("probable_target"), F.lit(confidence).alias("confidence"), F.lit(why).alias("reasoning"))
    told = (
        F.when((F.col("kind") == "call_target_unknown") & F.col("expression").contains("render"), answer("resolved", "django.shortcuts.render", 0.95, "render comes from django.shortcuts"))
        .when(F.col("kind") == "import_module_unknown", answer("unresolved", None, 0.0, "The module is not part of the project"))
        .when(F.col("kind").isin("mapping_violation", "schema_violation"), answer("unresolved", None, 0.0, "The mapping or the schema has to change"))
    )
    return ambiguities.withColumn("llm_resolution", told)


def context(nodes: DataFrame, edges: DataFrame, ambiguities: DataFrame, items: int = CONTEXT_ITEMS) -> DataFrame:
    """(owner, segment, node_ids, edges, ambiguities) for each file: what a model needs to know about it.
    edges (source, target, type) are those that touch one of its nodes; ambiguities (id, kind, expression,
    scope, candidates) have as candidates the nodes of any file that bear a name of the expression.

    A file with at most ``items`` of each has one row, segment 0.  A larger one has as many rows as it
    takes, over which its nodes, edges and ambiguities are spread by hash, so no row outgrows ``items``
    by much; each is in one of them.  Within a row node_ids, edges and ambiguities are sorted."""
    owned = spool(containment(nodes, edges), "owned")
    end = lambda here, there, out: F.struct(F.col(here).alias("id"), F.col(there).alias("other"), F.lit(out).alias("out"))
    ends = edges.select("type", F.explode(F.array(end("source", "target", True), end("target", "source", False))).alias("end")).select("type", "end.id", "end.other", "end.out")
    source, target = (F.when(F.col("out"), F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("id", "other", "source"), ("other", "id", "target")))
    touched = spool(ends.join(owned, "id").select("owner", F.struct(source, target, "type").alias("edge")), "touched")
    could = candidates(nodes, ambiguities).groupBy(F.col("ambiguity").alias("id")).agg(F.array_sort(F.collect_list("candidate")).alias("candidates"))
    doubts = ambiguities.select("id", "kind", "expression", F.col("source_scope").alias("scope")).join(could, "id", "left")
    doubts = doubts.join(owned.withColumnRenamed("id", "scope"), "scope")
    doubt = F.struct("id", "kind", "expression", "scope", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    told = spool(doubts.select("owner", doubt.alias("doubt")), "told")
    each = owned.select("owner", F.col("id").alias("node")).unionByName(touched, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    counted = each.groupBy("owner").agg(F.greatest(*(F.count(c) for c in ("node", "edge", "doubt"))).alias("most"), F.count(F.lit(1)).alias("n"))
    counted = spool(counted, "sizes")
    # Files that take several rows are fewer than all items divided by ``items``.
    large = counted.where(F.col("most") > items).select("owner", F.ceil(F.col("most") / items).alias("parts"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    at = F.pmod(F.xxhash64("node", "edge", "doubt.id"), F.coalesce("parts", F.lit(1)))
    spread = each.join(F.broadcast(large), "owner", "left").select("owner", at.cast("int").alias("segment"), "node", "edge", "doubt")
    # Rows meet their segment at once: nothing is gathered twice, and no task gets more than some segments.
    spread = spread.repartition(int(total // (2 * CONTEXT_ITEMS)) + 1, "owner", "segment")
    listed = (F.array_sort(f(c)).alias(n) for f, c, n in ((F.collect_set, "node", "node_ids"), (F.collect_set, "edge", "edges"), (F.collect_list, "doubt", "ambiguities")))
    return spread.groupBy("owner", "segment").agg(*listed)


def candidates(nodes: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """(ambiguity, candidate): nodes that bear a name which an ambiguity's expression holds."""
    words = ambiguities.select(F.col("id").alias("ambiguity"), F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return words.join(nodes.select("name", F.col("id").alias("candidate")), "name").select("ambiguity", "candidate").distinct()
