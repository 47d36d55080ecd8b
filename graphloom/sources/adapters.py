"""Frameworks' rules from files: a folder for each framework, with framework_mapping.json and, where
there are any, contracts and behaviour rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import ALIASES, SEVERITIES, Rule, check_rules
from ..schema import NODE_TYPES
from .files import read_document

MAPPING, CONTRACTS = "framework_mapping.json", "adapter_contracts.json"
#: Files of a framework that must have the keys of the core's file of the same name.
RULE_FILES = ("agent_behavior_rules.json", "architecture_boundary_rules.json", "code_purity_rules.json")
REPORT = "framework string, severity string, place string, problem string"


def rules_of(mapping: dict, framework: str) -> list[Rule]:
    """The rules of a mapping {"mappings": [{"core_node", "semantic_role", "detection_rules"}]}."""
    out = []
    for m in mapping.get("mappings") or ():
        keys = m.get("detection_rules") or {}
        out.append(Rule(framework, m.get("core_node") or "", m.get("semantic_role") or "", {ALIASES.get(k, k): v for k, v in keys.items()}))
    return out


def load_rules(spark: SparkSession, folder: str, frameworks: tuple[str, ...]) -> tuple[Rule, ...]:
    """The rules of the frameworks, in their order; a framework without a mapping has none."""
    return tuple(r for f in frameworks for r in rules_of(read_document(spark, f"{folder}/{f}/{MAPPING}"), f))


def key_problems(core: dict, own: dict, at: str = "") -> list[tuple[str, str]]:
    """(key, problem): keys that only one of two rule files has, and values of another type."""
    keys = lambda d: d.keys() - {"_meta"}
    out = [(at + k, "unknown key") for k in sorted(keys(own) - keys(core))] + [(at + k, "missing key") for k in sorted(keys(core) - keys(own))]
    for k in sorted(keys(core) & keys(own)):
        a, b = core[k], own[k]
        numbers = isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool)
        if isinstance(a, dict) and isinstance(b, dict):
            out += key_problems(a, b, f"{at}{k}.")
        elif type(a) is not type(b) and not numbers:
            out.append((at + k, f"{type(b).__name__} where {type(a).__name__} is meant"))
    return out


def check_adapter(spark: SparkSession, folder: str, framework: str, core: str | None = None) -> list[tuple[str, str, str, str]]:
    """(framework, severity, place, problem) of a framework's files.  core: the folder of the core's rule
    files; without it, or where a file is missing on either side, keys aren't compared."""
    at = f"{folder}/{framework}"
    mapping = read_document(spark, f"{at}/{MAPPING}")
    out = [(framework, *x) for x in check_rules(tuple(rules_of(mapping, framework)), NODE_TYPES)]
    if not mapping:
        out.append((framework, "error", MAPPING, "no mapping that can be read"))
    out += [(framework, "warning", f"{MAPPING}[{i}]", f"role {m['semantic_role']} is no node type") for i, m in enumerate(mapping.get("mappings") or ()) if m.get("semantic_role") not in (None, *NODE_TYPES)]
    for role, c in (read_document(spark, f"{at}/{CONTRACTS}").get("contracts") or {}).items():
        if (s := c.get("violation_severity")) and s not in SEVERITIES:
            out.append((framework, "error", f"{CONTRACTS}: {role}", f"unknown severity {s}"))
    for name in RULE_FILES if core else ():
        a, b = read_document(spark, f"{core}/{name}"), read_document(spark, f"{at}/{name}")
        if a and b:
            if "_meta" in a and "_meta" not in b:
                out.append((framework, "error", name, "no _meta"))
            out += [(framework, "error", f"{name}: {k}", p) for k, p in key_problems(a, b)]
    return out


def report(spark: SparkSession, folder: str, frameworks: tuple[str, ...], core: str | None = None) -> DataFrame:
    """check_adapter() of all frameworks as a table."""
    return spark.createDataFrame([x for f in frameworks for x in check_adapter(spark, folder, f, core)], REPORT)
