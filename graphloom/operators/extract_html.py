"""Templates and what they link to.

The parser turns each page into rows of tags; which of their attributes mean something is a rule
table that meets the tags in a broadcast join; values that are dynamic or external become doubts.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_VERBS = ("post", "put", "delete", "patch")
#: attribute -> (edge, type of its target), whatever the tag
ATTRIBUTE_RULES = {**{f"hx-{v}": ("calls_api", "Route") for v in ("get", *_VERBS)}, "hx-target": ("targets_element", "StyleID"), "hx-trigger": ("triggers_event", "Event")}
#: tag, attribute, edge, type of the target, attribute of the condition, its values
TAG_RULES = (
    *((t, "src", "links_static_asset", "StaticAsset", None, None) for t in "audio iframe img script source video".split()),
    ("link", "href", "links_static_asset", "StaticAsset", "rel", ["icon", "shortcut icon", "stylesheet"]),
    ("meta", "content", "links_static_asset", "StaticAsset", "property", ["og:image"]),
    ("a", "href", "calls_api", "Route", None, None),
    ("form", "action", "submits_form", "Route", None, None),
)
DYNAMIC = ("{{", "{%")
#: What the historical configuration has: literals that no real template contains.
DYNAMIC_COMPAT = ("{{ }}", "{% %}")
#: More than there are rules, so that a place in a page is its tag's number times this plus the rule's.
RULES = 64
#: Tags that a task gives to Spark at once: it keeps those and one page, however many pages come together.
TAGS = 10_000
_RULE = "rank int, tag string, attribute string, edge string, target_type string, condition string, values array<string>"
_TAGS = "path string, at int, line int, tag string, attrs map<string,string>"


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[int, str, dict[str, str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append((self.getpos()[0], tag, {k: v for k, v in attrs if v is not None}))


def _tag_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def tags(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row (path, at, line, tag, attrs) for each start tag."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int32()), ("line", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                name, parser = b.column(0)[i].as_py(), _Tags()
                parser.feed(b.column(1)[i].as_py())
                parser.close()
                for at, (line, tag, attrs) in enumerate(parser.found):
                    rows.append((name, at, line, tag, list(attrs.items())))
                    if len(rows) >= TAGS:
                        yield _tag_batch(rows, schema)
                        rows = []
        yield _tag_batch(rows, schema)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("path IS NOT NULL AND content IS NOT NULL").mapInArrow(run, _TAGS)


def context(tag: Column, attrs: Column) -> Column:
    """What an element is: tag, id, class and method; a verb attribute stands over method."""
    verb = F.coalesce(*(F.when(F.map_contains_key(attrs, f"hx-{v}"), F.lit(v.upper())) for v in _VERBS), F.upper(attrs["method"]))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("tag", tag), ("id", attrs["id"]), ("class", attrs["class"]), ("method", verb))))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def _rules(df: DataFrame) -> DataFrame:
    own = [(None, a, e, t, None, None) for a, (e, t) in ATTRIBUTE_RULES.items()]
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate([*own, *TAG_RULES])], _RULE)


def attribute_matches(found: DataFrame) -> DataFrame:
    """Rows of tags() that meet a rule for their attribute or tag, in the order of the page:
    path, at, rank, line, tag, attrs, edge, target_type, value."""
    rules = F.broadcast(_rules(found).withColumnRenamed("tag", "for_tag"))
    each = found.withColumn("attribute", F.explode(F.map_keys("attrs")))
    met = each.join(rules, "attribute").where("(for_tag IS NULL OR for_tag = tag) AND (condition IS NULL OR array_contains(values, attrs[condition]))")
    return met.select("path", "at", "rank", "line", "tag", "attrs", "edge", "target_type", F.col("attrs")[F.col("attribute")].alias("value"), F.col("for_tag").isNull().alias("by_attribute"))


def is_external(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike(r"^(https?:|//|mailto:)")


def is_dynamic(value: Column, patterns: tuple[str, ...] = DYNAMIC) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.contains(p)
    return out


def links(found: DataFrame, compat: bool = False) -> DataFrame:
    """attribute_matches with outcome: edge, dynamic_value_unresolved or
    external_reference_unmodeled."""
    return attribute_matches(found).withColumn(
        "outcome",
        F.when(is_dynamic(F.col("value"), DYNAMIC_COMPAT if compat else DYNAMIC), F.lit("dynamic_value_unresolved")).when(is_external(F.col("value")), F.lit("external_reference_unmodeled")).otherwise("edge"),
    )


def extract(files: DataFrame, compat: bool = False, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, ambiguities) of the templates in files (path, content). Node ids belong to
    their file; of equal ids and equal edges the first one of the page stays.  found: tags() of the files,
    where that is known."""
    met = links(tags(files) if found is None else found, compat)
    real = met.where("outcome = 'edge'").withColumn("id", F.concat_ws("::", "path", "target_type", "value"))
    first = Window.partitionBy("id").orderBy("at", "rank")
    inner = real.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    nodes = files.where("path IS NOT NULL AND content IS NOT NULL").select(
        F.lit(0).cast("long").alias("at"), F.col("path").alias("id"), F.lit("Template").alias("node_type"), F.col("path").alias("name"), F.md5(F.col("content").cast("binary")).alias("hash"),
        F.lit(None).cast("int").alias("line_start"), F.lit("structural").alias("analysis_confidence"), F.lit(None).cast("map<string,string>").alias("attributes"),
    ).unionByName(inner.select(
        (F.col("at").cast("long") * RULES + F.col("rank") + 1).alias("at"), "id", F.col("target_type").alias("node_type"), F.col("value").alias("name"), F.lit(None).cast("string").alias("hash"), F.col("line").alias("line_start"), F.lit("heuristic").alias("analysis_confidence"), context(F.col("tag"), F.col("attrs")).alias("attributes"),
    ))
    edges = real.groupBy("edge", F.col("path").alias("from"), F.col("id").alias("to")).agg(F.min(F.struct("at", "rank")).alias("first")).select("edge", "from", "to", F.lit(None).cast("int").alias("call_line"), "first")
    reason = F.when(F.col("outcome") == "dynamic_value_unresolved", "The value is made by a template").otherwise("The target is outside")
    doubts = met.where("outcome <> 'edge'").select(
        F.sha2(F.concat_ws("\x1f", "path", "outcome", "value", F.col("at").cast("string"), F.col("rank").cast("string")), 256).alias("id"), F.col("outcome").alias("kind"), F.col("path").alias("source_file"),
        F.col("path").alias("source_scope"), F.col("value").alias("expression"), reason.alias("reason"), F.lit("unresolved").alias("confidence"), F.lit("agent").alias("resolver"),
    )
    return nodes, edges, doubts
