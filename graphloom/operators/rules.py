"""Semantic roles by declarative rules.

A rule is for one node type and is the AND of its keys.  Each key compiles to a predicate on the node
or to a semi-join with the edges; rules are data, so what runs is a plan without Python.  Two readings
of the keys exist: strict compares whole names of proven targets; loose (the default of roles())
compares substrings and also looks at what the extractors could not prove.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import glob_match

#: Other names of keys.
ALIASES = {"calls": "used_in_calls", "contains_attribute": "contains_attributes", "file_pattern": "file_path_contains", "has_argument": "arg_names_include", "inherits": "inheritance_includes"}
STRICT_KEYS = ("decorated_by", "file_path_contains", "function_name", "inheritance_includes", "requires_import", "used_in_calls")
EXTRA_KEYS = ("arg_names_include", "assigned_value", "contains_attributes", "context", "decorators")
SEVERITIES = ("error", "info", "warning")


@dataclass(frozen=True)
class Rule:
    framework: str
    core_node: str
    role: str
    keys: dict[str, str | list[str]] = field(default_factory=dict)

    def values(self, key: str) -> list[str]:
        v = self.keys[key]
        return [v] if isinstance(v, str) else list(v)


def rule(framework: str, core_node: str, role: str, **keys) -> Rule:
    return Rule(framework, core_node, role, {ALIASES.get(k, k): v.split() if isinstance(v, str) and " " in v else v for k, v in keys.items()})


_VERBS = ("delete", "get", "patch", "post", "put")
_HX = " ".join(f"hx-{x}" for x in (*_VERBS, "swap", "target", "trigger"))
#: What the three frameworks' constructs look like.
RULES: tuple[Rule, ...] = (
    rule("django", "Class", "DataModel", inheritance_includes="models.Model django.db.models.Model"),
    rule("django", "Function", "View", arg_names_include=["request"], file_path_contains="views", used_in_calls="HttpResponse JsonResponse redirect render"),
    rule("django", "Class", "View", inheritance_includes="APIView View ViewSet " + " ".join(f"{x}View" for x in ("Create", "Delete", "Detail", "List", "Template", "Update")) + " django.views rest_framework.generics rest_framework.views"),
    rule("django", "Call", "Route", function_name="path re_path url", context="urlpatterns"),
    *(rule("django", "Class", role, inheritance_includes=[f"{prefix}{module}.{x}" for prefix in ("", full) for x in names.split()]) for role, module, full, names in (("Form", "forms", "django.", "Form ModelForm"), ("Serializer", "serializers", "rest_framework.", "ModelSerializer Serializer"), ("Admin", "admin", "django.contrib.", "ModelAdmin"))),
    rule("django", "Class", "Middleware", inheritance_includes=["MiddlewareMixin", "django.utils.deprecation.MiddlewareMixin"], file_path_contains="middleware"),
    rule("django", "Function", "Signal", used_in_calls=["receiver"], decorators=["receiver", "django.dispatch.receiver"]),
    rule("fastapi", "Class", "DataModel", inheritance_includes="Base SQLModel"),
    rule("fastapi", "Class", "APIContract", inheritance_includes="BaseModel pydantic.BaseModel"),
    rule("fastapi", "Function", "View", decorated_by=[f"{o}.{v}" for o in ("app", "router", "api_router") for v in _VERBS if (o, v) != ("api_router", "patch")]),
    rule("fastapi", "Call", "Dependency", function_name="Depends Security fastapi.Depends"),
    rule("fastapi", "Variable", "Router", assigned_value=["APIRouter"]),
    rule("htmx", "Template", "Component", contains_attributes=_HX),
    rule("htmx", "Fragment", "Component", contains_attributes=_HX),
)


class Matcher:
    """Compiles rules over one graph. nodes: id, node_type, name and, where known, file_path, signature,
    attributes; edges: source, target, type, seq; ambiguities: source_scope, kind, expression."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, ambiguities: DataFrame | None = None, loose: bool = False) -> None:
        self.nodes, self.edges, self.loose = nodes, edges, loose
        self.doubts = ambiguities
        self.named = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def _neighbours(self, kinds: tuple[str, ...], reverse: bool = False) -> DataFrame:
        """(id, text): names of the nodes at the other end of a node's edges; loose: ids of unknown
        ones too."""
        here, there = ("target", "source") if reverse else ("source", "target")
        met = self.edges.where(F.col("type").isin(*kinds)).select(F.col(here).alias("id"), F.col(there).alias("other"))
        known = met.join(self.named, "other", "left" if self.loose else "inner")
        return known.select("id", F.coalesce("other_name", "other").alias("text") if self.loose else F.col("other_name").alias("text"))

    def _unproven(self, kind: str) -> DataFrame | None:
        if not self.loose or self.doubts is None:
            return None
        return self.doubts.where(F.col("kind") == kind).select(F.col("source_scope").alias("id"), F.col("expression").alias("text"))

    def _says(self, text: Column, wanted: list[str], parts: bool) -> Column:
        """Whether text is one of the wanted names; loose: holds one, or (parts) all parts of a dotted
        one."""
        if not self.loose:
            return text.isin(*wanted)
        out = F.lit(False)
        for w in wanted:
            out = out | text.contains(w)
            if parts and "." in w:
                out = out | reduce(lambda a, b: a & b, (text.contains(p) for p in w.split(".")))
        return out

    def _met(self, kinds: tuple[str, ...], wanted: list[str], doubt: str | None, reverse: bool = False, parts: bool = True, ids: bool = False) -> DataFrame:
        found = self._neighbours(kinds, reverse)
        if self.loose and ids:
            here, there = ("target", "source") if reverse else ("source", "target")
            found = self.edges.where(F.col("type").isin(*kinds)).select(F.col(here).alias("id"), F.col(there).alias("text"))
        more = self._unproven(doubt) if doubt else None
        found = found if more is None else found.unionAll(more)
        return found.where(self._says(F.col("text"), wanted, parts)).select("id").distinct()

    def inheritance_includes(self, r: Rule) -> DataFrame:
        return self._met(("extends", "inherits_from") if self.loose else ("extends",), r.values("inheritance_includes"), "inheritance_target_unproven")

    def decorated_by(self, r: Rule) -> DataFrame:
        return self._met(("decorates",), r.values("decorated_by"), "decorator_unknown", reverse=True, ids=True)

    def used_in_calls(self, r: Rule) -> DataFrame:
        return self._met(("calls", "function_call") if self.loose else ("calls",), r.values("used_in_calls"), "call_target_unknown", parts=False)

    def file_path_contains(self, r: Rule) -> DataFrame:
        """Defined by a file whose path (name where it has none) matches the glob; loose: whose id holds
        the keyword."""
        by = self.edges.where(F.col("type").isin("defines", "defines_class", "defines_function") if self.loose else F.col("type") == "defines").select(F.col("target").alias("id"), F.col("source").alias("other"))
        pattern = r.values("file_path_contains")[0]
        if self.loose:
            return by.where(F.col("other").contains(pattern)).select("id").distinct()
        files = self.nodes.select(F.col("id").alias("other"), F.coalesce("file_path", "name", F.lit("")).alias("file"))
        return by.join(files.where(glob_match("file", pattern)), "other", "left_semi").select("id").distinct()

    def requires_import(self, r: Rule) -> DataFrame:
        """The first file that defines the node imports something whose name holds the package."""
        defined = self.edges.where("type = 'defines'").groupBy(F.col("target").alias("id")).agg(F.min_by("source", "seq").alias("file"))
        targets = self.named.where(F.col("other_name").contains(r.values("requires_import")[0])).select(F.col("other").alias("target"))
        files = self.edges.where("type = 'imports'").join(targets, "target", "left_semi").select(F.col("source").alias("file"))
        return defined.join(files, "file", "left_semi").select("id")

    def predicate(self, key: str, r: Rule) -> Column | None:
        """A key that looks at the node alone."""
        match key:
            case "function_name":
                return F.col("name").isin(*r.values(key))
            case "arg_names_include":
                return F.arrays_overlap("signature.args", F.array(*map(F.lit, r.values(key))))
            case "decorators":
                names = [v.rpartition(".")[2] for v in r.values(key)]
                return F.exists("signature.decorators", lambda d: F.regexp_replace(d, r"^@|\(.*$", "").isin(*names))
            case "contains_attributes":
                return F.arrays_overlap(F.map_keys("attributes"), F.array(*map(F.lit, r.values(key))))
            case "assigned_value":
                return F.col("attributes")["assigned_value"].isin(*r.values(key))
            case "context":
                return F.col("attributes")["context"].isin(*r.values(key))
        return None

    def matches(self, r: Rule, compat: bool = False) -> DataFrame:
        """Ids of the nodes that meet the rule.  compat: keys that the historical engines don't know are
        ignored (the loose one lets assigned_value match nothing), so a rule of such keys alone meets
        every node of its type."""
        found = self.nodes.where(F.col("node_type") == r.core_node)
        joins = []
        for key in r.keys:
            if compat and key in EXTRA_KEYS:
                if self.loose and key == "assigned_value":
                    found = found.where(F.lit(False))
                continue
            if key == "requires_import" and compat and self.loose:
                continue
            if (test := self.predicate(key, r)) is not None:
                found = found.where(F.coalesce(test, F.lit(False)))
            else:
                joins.append(getattr(self, key)(r))
        for j in joins:
            found = found.join(j, "id", "left_semi")
        return found.select("id")


def _usable(nodes: DataFrame) -> DataFrame:
    more = {"file_path": "string", "signature": "struct<args:array<string>,decorators:array<string>>", "attributes": "map<string,string>", "name": "string"}
    return nodes.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in nodes.columns}) if set(more) - set(nodes.columns) else nodes


def roles(nodes: DataFrame, edges: DataFrame, ambiguities: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, loose: bool = True, compat: bool = False) -> DataFrame:
    """(id, semantic_roles) of the nodes that have a role; each role once, in the order of the rules."""
    if not rules:
        return nodes.sparkSession.createDataFrame([], "id string, semantic_roles array<string>")
    matcher = Matcher(_usable(nodes), edges, ambiguities, loose)
    hits = reduce(DataFrame.unionAll, (matcher.matches(r, compat).select("id", F.lit(i).alias("rule"), F.lit(r.role).alias("role")) for i, r in enumerate(rules)))
    first = hits.groupBy("id", "role").agg(F.min("rule").alias("rule"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule", "role"))), lambda x: x["role"])
    return first.groupBy("id").agg(ordered.alias("semantic_roles"))


def enriched(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with their roles; an empty list where there are none."""
    return nodes.drop("semantic_roles").join(found, "id", "left").withColumn("semantic_roles", F.coalesce("semantic_roles", F.array().cast("array<string>")))


def check_rules(rules: tuple[Rule, ...], core_types: tuple[str, ...], semantic_roles: tuple[str, ...] | None = None) -> list[tuple[str, str, str]]:
    """(severity, place, problem) of rules that no node can meet as they are meant."""
    out = []
    for i, r in enumerate(rules):
        place = f"{r.framework}[{i}]"
        if r.core_node not in core_types:
            out.append(("error", place, f"unknown core node {r.core_node}"))
        if semantic_roles is not None and r.role not in semantic_roles:
            out.append(("error", place, f"unknown role {r.role}"))
        if not r.keys:
            out.append(("error", place, "no detection keys"))
        for key, v in r.keys.items():
            if key not in (*STRICT_KEYS, *EXTRA_KEYS):
                out.append(("error", place, f"unknown key {key}"))
            elif not isinstance(v, (str, list)) or (isinstance(v, list) and not all(isinstance(x, str) for x in v)):
                out.append(("error", place, f"{key} must be text or a list of texts"))
            elif key in EXTRA_KEYS:
                out.append(("info", place, f"{key} is an extension"))
    return out

