"""Vocabulary and record types of the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

NODE_TYPES = tuple(
    "Admin APIContract Assign Call Class Component Config DataModel Decorator Dependency Enum Event File Form Fragment Function Hook Interface Method Middleware Module "
    "Package Route Router Serializer Signal StaticAsset StyleClass StyleElement StyleID Stylesheet Template Trait Variable View".split()
)

#: edge -> (types it may leave, types it may reach)
EDGE_RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    edge: (tuple(a.split()), tuple(b.split()))
    for edge, a, b in (
        ("calls", "File Function Hook Method", "Function Method"),
        ("calls_api", "Component Function Template", "Route"),
        ("contains_member", "Class Trait", "Method Variable"),
        ("decorates", "Class Function", "Class Function"),
        ("defines", "File Stylesheet", "Class Component Enum Function Hook Interface Route StyleClass StyleElement StyleID Trait"),
        ("expects_contract", "Function Route", "APIContract"),
        ("extends", "Class", "Class"),
        ("implements_interface", "Class", "Interface"),
        ("imports", "File Module Stylesheet", "Class File Function Module Package Stylesheet Variable"),
        ("links_static_asset", "Template", "StaticAsset"),
        ("reads_from", "Function Method", "DataModel File Variable"),
        ("registers_event_handler", "File Function Hook Method", "Event"),
        ("renders_template", "Function Route", "Fragment Template"),
        ("submits_form", "Template", "Route"),
        ("targets_element", "StaticAsset Template", "StyleClass StyleID Template"),
        ("throws_exception", "Function Method", "Class"),
        ("triggers_event", "Fragment Template", "Event"),
        ("uses_trait", "Class", "Trait"),
        ("writes_to", "Function Method", "DataModel Variable"),
    )
}
TRIPLES = tuple((e, a, b) for e, (left, right) in EDGE_RULES.items() for a in left for b in right)
assert (len(NODE_TYPES), len(EDGE_RULES), len(TRIPLES)) == (35, 19, 97)

#: Edges along which a node belongs to a file.
OWNERSHIP = ("contains_class", "contains_member", "contains_method", "contains_variable", "defines")
CONFIDENCES = ("heuristic", "structural_violation", "unresolved")

SIGNATURE = "struct<args:array<string>,defaults:array<string>,decorators:array<string>,returns:string>"
NODE = f"id string, node_type string, name string, file_path string, hash string, line_start int, line_end int, docstring string, is_async boolean, analysis_confidence string, signature {SIGNATURE}, attributes map<string,string>"
EDGE = "edge string, `from` string, `to` string, call_line int"
AMBIGUITY = "id string, kind string, source_file string, source_scope string, expression string, reason string, confidence string, resolver string"
ENRICHMENT = "struct<intent:string,summary:string,complexity_score:int,domain_tags:array<string>,pure_logic:boolean,side_effects:array<string>,enriched_at_hash:string,enriched_at:string>"
RESOLUTION = "struct<status:string,probable_target:string,confidence:double,reasoning:string>"
#: What an extractor emits for each file, in order.
FRAGMENT = f"nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>, ambiguities array<struct<{AMBIGUITY}>>, log string"


def allowed(edge: str, source: str, target: str) -> bool:
    rule = EDGE_RULES.get(edge)
    return rule is not None and source in rule[0] and target in rule[1]


def edge_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRIPLES), "edge string, from_type string, to_type string")


def node_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in NODE_TYPES], T.StructType([T.StructField("node_type", T.StringType())]))
