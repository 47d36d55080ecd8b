"""The questions of a graph on the command line: python -m graphloom.cli --graph PATH COMMAND ... [--json]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .graph import CodeGraph
from .operators import overlay, validate
from .sources.files import load_exclusions
from .sources.profile import load_profile

#: Rows shown at most; --json writes all of them, one after the other.
SHOWN = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--graph", default="graph", help="folder of the saved graph (below it, enriched stands before raw)")
    p.add_argument("--files", help="source tree, for read")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags: dict) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for flag, how in flags.items():
            c.add_argument("--" + flag.replace("_", "-"), **how)
        c.add_argument("--json", action="store_true")

    add("search", "query", type={"default": None})
    for name in ("locate", "read", "details", "call-graph"):
        add(name, "node_id")
    add("impact", "node_id", depth={"type": int, "default": 2})
    add("dependencies", "node_id", depth={"type": int, "default": 1})
    for name in ("stats", "list-files", "validate"):
        add(name)
    add("pending", mode={"choices": ("incremental", "full"), "default": "incremental"})
    add("build", "root", profile={"default": None}, exclusions={"default": None}, enrich={"action": "store_true"})
    return p


def rows(df: DataFrame):
    """Rows as dicts, in order, one partition after the other."""
    return (r.asDict(True) for r in df.toLocalIterator())


def answer(spark: SparkSession, args: argparse.Namespace) -> object:
    """What a command finds: an iterator of rows, or one dict."""
    if args.command == "build":
        return build(spark, args)
    from .sources.files import scan_files

    files = None
    if args.files:
        files = scan_files(spark, args.files, "*").where("content IS NOT NULL").select("path", "content")
    g = CodeGraph.load(spark, args.graph, files)
    one = lambda df: next(rows(df), {"error": "Node not found"})
    match args.command:
        case "search":
            return rows(g.search(args.query, args.type))
        case "locate":
            return one(g.locate(args.node_id))
        case "details":
            return one(g.details(args.node_id))
        case "read":
            found = one(g.read(args.node_id))
            return {"error": found["error"]} if found.get("error") else found
        case "impact":
            return {r.pop("id"): r for r in rows(g.impact(args.node_id, args.depth))}
        case "dependencies":
            return {r.pop("id"): r for r in rows(g.dependencies(args.node_id, args.depth))}
        case "call-graph":
            found = list(rows(g.call_graph(args.node_id)))
            sides = {side: [{k: v for k, v in r.items() if k != "direction"} for r in found if r["direction"] == side] for side in ("incoming", "outgoing")}
            return {"node_id": args.node_id, **sides, "summary": {f"{side}_count": len(x) for side, x in sides.items()}}
        case "stats":
            found = one(g.stats())
            return found | {"meta": json.loads(found["meta"]), "by_type": {r["node_type"]: r["n"] for r in rows(g.stats_by_type())}}
        case "list-files":
            return (r["file_path"] for r in rows(g.list_files()))
        case "validate":
            problems = g.validate()
            return one(validate.counts(g.nodes, g.edges, g.ambiguities, problems)) | {"first": [r for r in rows(problems.orderBy("severity", "issue", "subject").limit(5))]}
        case "pending":
            return rows(overlay.pending(g.nodes, g.nodes if "llm_enrichment" in g.nodes.columns else None, args.mode).where("pending").orderBy("id"))


def build(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Build the graph of a source tree and save it as raw (and enriched)."""
    profile = load_profile(args.profile) if args.profile else None
    folders, names = load_exclusions(spark, args.exclusions) if args.exclusions else ((".venv", "__pycache__"), ())
    g = CodeGraph.build(spark, args.root, profile.languages if profile else ("python", "html", "css"), folders=folders, names=names)
    g.save(f"{args.graph}/raw")
    if args.enrich:
        g.enrich(frameworks=profile.frameworks if profile else None).save(f"{args.graph}/enriched")
    return next(rows(g.stats())) | {"log": list(rows(g.log.limit(SHOWN)))}


def shown(found: object, as_json: bool) -> list[str]:
    """Lines of output: JSON, or text with one line for each item of a list."""
    items = found if isinstance(found, dict) else list(found)
    if as_json:
        return [json.dumps(items, indent=2, default=str)]
    if isinstance(items, dict):
        return [f"--- Code ({items.get('mode')}) ---", items["content"]] if "content" in items else [json.dumps(items, indent=2, default=str)]
    label = lambda x: f"{x.get('id')} ({x.get('node_type', x.get('reason'))})" if isinstance(x, dict) else x
    more = [f"... and {len(items) - SHOWN} more"] if len(items) > SHOWN else []
    return [f"Found {len(items)} items:", *(f"  - {label(x)}" for x in items[:SHOWN]), *more]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    print("\n".join(shown(answer(spark, args), args.json)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
