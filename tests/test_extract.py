"""Extractors over source files of our own; counts by kind are worked out by hand."""

import json
from collections import Counter

import pytest

from graphloom.graph import CodeGraph
from graphloom.operators import extract_css, extract_html, extract_python, file_profile
from graphloom.sources.files import file_lines, scan_files

SHAPES = '''"""Shapes."""
import os
import json
from dataclasses import dataclass
from base import Root

LIMIT = 10
names = []


class Shape:
    """A shape."""

    sides = 0
    label: str = "x"

    def area(self, scale, unit="m"):
        total = scale
        return total


class Square(Shape):
    pass


class Odd(Unknown):
    pass


def helper():
    return 1


async def main(flag):
    helper()
    value = helper()
    print(value)
    Square()

    def inner():
        pass


@helper
def decorated():
    os.getcwd()


@helper(1)
def called():
    raise ValueError
'''


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_py", ".py").replace("_html", ".html").replace("_css", ".css"), v) for k, v in texts.items()], "path string, content string")


def python(spark, compat=False, **texts):
    out = {"nodes": [], "edges": [], "ambiguities": [], "logs": {}}
    for r in extract_python.extract(files(spark, **texts), compat).collect():
        for k in ("nodes", "edges", "ambiguities"):
            out[k] += r[k]
        if r.log:
            out["logs"][r.path] = r.log
    return out


def test_python_nodes(spark):
    found = python(spark, shapes_py=SHAPES)
    assert Counter(n.node_type for n in found["nodes"]) == {"File": 1, "Class": 3, "Method": 1, "Function": 4, "Variable": 6}
    by = {n.id: n for n in found["nodes"]}
    area = by["shapes.py::Shape::area"]
    assert (area.line_start, area.line_end, list(area.signature.args), list(area.signature.defaults)) == (17, 19, ["self", "scale", "unit"], ["m"])
    assert by["shapes.py::Shape"].docstring == "A shape." and by["shapes.py::main"].is_async
    assert by["shapes.py"].line_start is None and len(by["shapes.py"].hash) == 32


def test_python_edges_and_doubts(spark):
    found = python(spark, shapes_py=SHAPES, base_py="class Root:\n    pass\n")
    edges = Counter(e.edge for e in found["edges"])
    ends = {(e.edge, e["from"], e["to"]) for e in found["edges"]}
    assert ("extends", "shapes.py::Square", "shapes.py::Shape") in ends
    assert ("calls", "shapes.py::main", "shapes.py::helper") in ends
    assert ("decorates", "shapes.py::helper", "shapes.py::decorated") in ends
    assert edges["imports"] >= 1 and ("imports", "shapes.py", "base.py::Root") in ends
    assert ("writes_to", "shapes.py::main", "shapes.py::main::value") in ends
    doubts = Counter(a.kind for a in found["ambiguities"])
    assert doubts["import_module_unknown"] == 3  # os, json, dataclasses
    assert doubts["inheritance_target_unproven"] == 1 and doubts["mapping_violation"] == 2  # Unknown; LIMIT, names
    assert doubts["nested_function_unmodeled"] == 1 and doubts["decorator_unknown"] >= 1
    assert not any("inner" in n.id for n in found["nodes"])


def test_python_compat_drops_calls_on_the_right_side(spark):
    text = "def f():\n    return 1\n\n\ndef g():\n    x = f()\n"
    calls = lambda compat: [e for e in python(spark, compat, a_py=text)["edges"] if e.edge == "calls"]
    assert len(calls(False)) == 1 and calls(True) == []


def test_python_broken_file_is_logged_and_the_rest_goes_on(spark):
    found = python(spark, bad_py="def (:\n", good_py="def f():\n    pass\n", empty_py="")
    assert set(found["logs"]) == {"bad.py"} and "good.py::f" in {n.id for n in found["nodes"]}
    assert "empty.py" in {n.id for n in found["nodes"]}


PAGE = """<html><head><link rel="stylesheet" href="/main.css"><link rel="icon" href="/i.png"><link rel="next" href="/no">
<script src="/app.js"></script><script>var a = "<a href='/hidden'>";</script></head><body>
<img src="/logo.png"><a href="/in">x</a><a href="https://else.example/">y</a><a href="{{ url }}">z</a>
<form action="/send" method="post"><input></form>
<button hx-post="/like" hx-target="#box" id="b" class="c d">k</button><div hx-get="/feed" hx-trigger="load"></div></body></html>"""


def test_html(spark):
    nodes, edges, doubts = extract_html.extract(files(spark, page_html=PAGE))
    n = {(r.node_type, r.name): r for r in nodes.collect()}
    assert Counter(k for k, _ in n) == {"Template": 1, "StaticAsset": 4, "Route": 4, "StyleID": 1, "Event": 1}
    assert Counter(r.edge for r in edges.collect()) == {"links_static_asset": 4, "calls_api": 3, "submits_form": 1, "targets_element": 1, "triggers_event": 1}
    assert Counter(r.kind for r in doubts.collect()) == {"external_reference_unmodeled": 1, "dynamic_value_unresolved": 1}
    assert n["Route", "/like"].attributes == {"tag": "button", "id": "b", "class": "c d", "method": "POST"}
    assert n["Route", "/send"].attributes["method"] == "POST" and n["Route", "/in"].line_start == 3
    assert n["Template", "page.html"].attributes is None


def test_html_compat_takes_dynamic_values_for_routes(spark):
    nodes, _, doubts = extract_html.extract(files(spark, p_html='<a href="{{ url }}">z</a>'), compat=True)
    assert nodes.where("node_type = 'Route'").count() == 1 and doubts.count() == 0


SHEET = """@import "base.css";
/* @keyframes ghost { } .ghost { } */
@media (max-width: 10px) { .a { } }
@keyframes spin { from { } }
.b, .c:hover {
  color: #fff;
}
.b:focus { }
#main { }
.esc\\:x { }
p::before { }
"""


def test_css(spark):
    nodes, edges, doubts = extract_css.extract(files(spark, s_css=SHEET))
    by = {(r.node_type, r.name): r for r in nodes.collect()}
    assert {n for k, n in by if k == "StyleClass"} == {"a", "b", "c"} and {n for k, n in by if k == "StyleID"} == {"main"}
    assert by["StyleClass", "c"].attributes == {"pseudo_state": "hover"}
    assert not by["StyleClass", "b"].attributes  # the first one of equal names stays
    assert by["StyleID", "main"].line_start == 9
    assert {n for k, n in by if k == "StyleElement"} == {"p"}
    assert {r.name for r in extract_css.selectors(files(spark, s_css=SHEET), compat=True).where("node_type = 'StyleElement'").collect()} >= {"p", "color", "import"}
    assert edges.count() == len(by) - 1 and {r.edge for r in edges.collect()} == {"defines"}
    assert Counter(r.kind for r in doubts.collect()) == {"css_animation_defined": 2, "responsive_breakpoint": 1, "import_target_unresolved": 1}


def test_profiles(spark):
    rows = {r.path: r for r in file_profile.profiles(files(spark, pages__app_py=SHAPES, bad_py="x = (")).collect()}
    good = rows["pages/app.py"]
    assert good.layer == "UI" and good.purpose == "Shapes." and [c.name for c in good.classes] == ["Shape", "Square", "Odd"]
    assert "json" in good.imports and rows["bad.py"].error and rows["bad.py"].classes is None


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build" / "proj"
    for name, text in {"a.py": SHAPES, "base.py": "class Root:\n    pass\n", "web/p.html": PAGE, "web/s.css": SHEET, "web/__init__.py": "ready = True\n", "web/.hidden.py": "", "__pycache__/x.py": "x = 1\n", ".venv/lib/y.py": "y = 1\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan(spark, tree):
    assert sorted(r.path for r in scan_files(spark, str(tree), "*.py").collect()) == ["a.py", "base.py", "web/.hidden.py", "web/__init__.py"]
    assert {r.path: r.content for r in scan_files(spark, str(tree), "*.py", names=("b*", ".*")).collect()} == {"a.py": SHAPES, "web/__init__.py": "ready = True\n"}
    assert sorted(r.path for r in scan_files(spark, str(tree), "*.py", ("web",), ("a*",), content=False).collect()) == [".venv/lib/y.py", "__pycache__/x.py", "base.py"]
    one = scan_files(spark, str(tree / "a.py")).collect()
    assert [(r.path, r.language, r.content) for r in one] == [("a.py", "python", SHAPES)]
    lines = file_lines(scan_files(spark, str(tree / "base.py"))).collect()
    assert [(r.line, r.text) for r in lines] == [(1, "class Root:"), (2, "    pass"), (3, "")]


def test_whole_graph(spark, tree, tmp_path):
    g = CodeGraph.build(spark, str(tree))
    assert g.validate().where("severity = 'error'").count() == 0
    ids = {r.id for r in g.nodes.collect()}
    assert {"File:a.py", "a.py::Shape::area", "Template:web/p.html", "Stylesheet:web/s.css"} <= ids
    assert len({r.seq for r in g.nodes.collect()}) == len(ids)
    rich = g.enrich()
    assert g.equivalence(rich).count() == 0
    assert {r.id for r in rich.nodes.where("array_contains(semantic_roles, 'Component')").collect()} == set()
    rich.save(str(tmp_path / "saved"))
    again = CodeGraph.load(spark, str(tmp_path / "saved"), g.files)
    assert again.nodes.count() == len(ids)
    assert {r.status for r in again.diff(rich).collect()} <= {"UNCHANGED", "MODIFIED"}
    rich.export_json(str(tmp_path / "json"))
    back = CodeGraph.import_json(spark, str(tmp_path / "json"))
    (whole,) = (tmp_path / "json").glob("*.txt")
    doc = json.loads(whole.read_text())
    assert list(doc) == ["ambiguities", "edges", "nodes"] and all(list(x) == sorted(x) for part in doc.values() for x in part)
    assert len(doc["nodes"]) == len(ids) and [n["seq"] for n in doc["nodes"]] == sorted(n["seq"] for n in doc["nodes"])
    assert back.nodes.count() == len(ids) and back.edges.count() == g.edges.count()
    assert again.read("a.py::Shape::area").first().content.startswith("    def area")
    assert again.search("decorator:helper").count() >= 2
    assert again.impact("a.py::Shape").where("relation = 'extends'").count() == 1
    changed = CodeGraph(again.nodes.withColumn("semantic_roles", again.nodes["semantic_roles"]), again.edges, again.ambiguities, again.files)
    assert changed.enrich_from(rich).nodes.count() == len(ids)


def test_python_expressions_of_any_depth(spark):
    deep = "def f():\n    return 1\n\n\nx = " + "+".join(['"a"'] * 2000) + " + f()\ny = " + "f()" + ".g()" * 150 + "\n"
    found = python(spark, deep_py=deep, good_py="def h():\n    pass\n")
    assert found["logs"] == {} and "good.py::h" in {n.id for n in found["nodes"]}
    assert len([a for a in found["ambiguities"] if a.kind == "call_target_unknown"]) >= 150


def test_python_names_of_other_files(spark):
    """Only names that a file asks for are sent to it: of modules, of classes in them, through aliases."""
    lib = "class Tool:\n    def run(self):\n        pass\n\n\ndef use():\n    pass\n\n\ndef other():\n    pass\n"
    text = "import pkg.lib as l\nfrom lib import Tool as T, missing\nimport lib\n\n\ndef f():\n    l.use()\n    T.run()\n    lib.Tool.run()\n    lib.nothing()\n"
    found = python(spark, pkg__lib_py=lib, a_py=text)
    ends = {(e.edge, e["from"], e["to"], e.call_line) for e in found["edges"] if e["from"].startswith("a.py")}
    assert ends >= {("calls", "a.py::f", "pkg/lib.py::use", 7), ("calls", "a.py::f", "pkg/lib.py::Tool::run", 8), ("calls", "a.py::f", "pkg/lib.py::Tool::run", 9), ("imports", "a.py", "pkg/lib.py::Tool", None)}
    assert Counter(a.kind for a in found["ambiguities"] if a.source_file == "a.py") == {"import_symbol_type_unknown": 1, "call_target_unknown": 1}


def test_css_reads_selectors_only():
    found = lambda text: [(k[5:], n, line, s) for k, n, line, s in extract_css.names(text)]
    assert found(".a { width: 1px; color: red }") == [("Class", "a", 1, None)]
    assert found('a[href="x{y}"]:not(.b, em):nth-child(odd) > #fff::before\n, i { content: "}.no{" }') == [("Class", "b", 1, None), ("ID", "fff", 1, None), ("Element", "a", 1, None), ("Element", "em", 1, None), ("Element", "i", 2, None)]
    assert found("@media (x) { .m:hover { color: red; & u { } } }\n@supports (display: grid) { s { } }") == [("Class", "m", 1, "hover"), ("Element", "u", 1, None), ("Element", "s", 2, None)]
    assert found("@keyframes k { from { } to { } } @font-face { src: url(a;b) } @import 'x.css'; @page :first { } b { }") == [("Element", "b", 1, None)]
    assert found("} b { } .c { .d { } ") == [("Class", "c", 1, None), ("Class", "d", 1, None), ("Element", "b", 1, None)] and found("") == [] and found("{{{") == []
