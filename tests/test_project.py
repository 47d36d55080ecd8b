"""Projects on disk: scanning, logs, rules from files, the gate, the command line, diffs and sessions."""

import json

import pytest

from graphloom import cli
from graphloom.graph import CodeGraph, GovernanceError
from graphloom.operators import overlay, rules, validate
from graphloom.schema import NODE_TYPES
from graphloom.sources import adapters, files as S, session
from graphloom.streaming.follow import absorb, latest


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build" / "proj"
    texts = {
        "app/models.py": "class User(Base):\n    name = 1\n\n    def save(self):\n        helper()\n\n\ndef helper():\n    return 1\n", "app/views.py": "from app.models import User, helper\n\n\ndef index(request):\n    helper()\n    render(request)\n",
        "app/broken.py": "def (:\n", "web/page.html": '<a href="/in">x</a><div hx-get="/y"></div>', "web/s.css": ".a { color: red }\n", "node_modules/x.py": "x = 1\n", "app/test_output_1.py": "y = 1\n",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "app/latin.py").write_bytes("# caf\xe9\nx = 1\n".encode("latin-1"))
    (tmp_path / "rules.json").write_text(json.dumps({"scan_policy": {"exclude_dirs": ["node_modules"], "exclude_file_patterns": ["test_output*"]}}))
    return root


def test_exclusions_from_a_rules_file(spark, tree):
    folders, names = S.load_exclusions(spark, str(tree.parent.parent / "rules.json"))
    assert folders == (".venv", "__pycache__", "node_modules") and names == ("test_output*",)
    found = sorted(r.path for r in S.scan_files(spark, str(tree), "*.py", folders, names, content=False).collect())
    assert found == ["app/broken.py", "app/latin.py", "app/models.py", "app/views.py"]
    assert S.load_exclusions(spark, str(tree / "none.json")) == (S.EXCLUDED_FOLDERS, ())
    (tree / "bad.json").write_text("{")
    assert S.load_exclusions(spark, str(tree / "bad.json")) == (S.EXCLUDED_FOLDERS, ())


def test_listing_in_rounds(spark, tree, monkeypatch):
    for i in range(30):
        (tree / f"deep/d{i}/e").mkdir(parents=True)
        (tree / f"deep/d{i}/e/f.py").write_text("x = 1\n")
    monkeypatch.setattr(S, "LISTED", 5)
    assert S.scan_files(spark, f"file://{tree}/deep", "*.py").count() == 30
    with pytest.raises(FileNotFoundError):
        S.scan_files(spark, str(tree / "nowhere"))


def test_files_that_fail_are_logged_and_the_rest_goes_on(spark, tree, tmp_path):
    g = CodeGraph.build(spark, str(tree))
    failed = {r.path: r.error for r in g.log.collect()}
    assert set(failed) == {"app/broken.py", "app/latin.py"} and "UnicodeDecodeError" in failed["app/latin.py"]
    assert g.nodes.where("id = 'app/models.py::User'").count() == 1
    meta = json.loads(g.stats().first().meta)
    assert meta == {"source": "graphloom", "fragments": ["python", "html", "css"], "enriched": False}
    g.enrich().save(str(tmp_path / "saved"))
    again = CodeGraph.load(spark, str(tmp_path / "saved"))
    assert again.log.count() == 2 and json.loads(again.stats().first().meta)["enriched"] is True
    assert CodeGraph(g.nodes, g.edges, g.ambiguities).stats().first().meta == "{}"


def test_fragments_are_kept(spark, tmp_path):
    py = spark.createDataFrame([("a.py", "def f():\n    pass\n")], "path string, content string")
    CodeGraph.from_files({"python": py, "css": py.limit(0)}, fragments=str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts/python/nodes")).count() == 2 and spark.read.parquet(str(tmp_path / "parts/css/edges")).count() == 0


@pytest.fixture
def frameworks(tmp_path):
    for name, mapping in {
        "web": {"mappings": [{"core_node": "Function", "semantic_role": "View", "detection_rules": {"arg_names_include": ["request"]}}, {"core_node": "Class", "semantic_role": "DataModel", "detection_rules": {"inherits": ["Base"]}}]},
        "odd": {"mappings": [{"core_node": "Nonsense", "semantic_role": "Thing", "detection_rules": {"no_such_key": 1}}]},
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / adapters.MAPPING).write_text(json.dumps(mapping))
    (tmp_path / "odd" / adapters.CONTRACTS).write_text(json.dumps({"contracts": {"View": {"violation_severity": "fatal"}, "Form": {"violation_severity": "info"}}}))
    (tmp_path / "core").mkdir()
    (tmp_path / "core" / "code_purity_rules.json").write_text(json.dumps({"_meta": {}, "limits": {"lines": 10, "strict": True}, "names": []}))
    (tmp_path / "odd" / "code_purity_rules.json").write_text(json.dumps({"limits": {"lines": 2.5, "strict": "yes"}, "more": 1}))
    return tmp_path


def test_rules_from_files(spark, frameworks, tree):
    found = adapters.load_rules(spark, str(frameworks), ("web", "none"))
    assert [(r.framework, r.core_node, r.role, r.keys) for r in found] == [("web", "Function", "View", {"arg_names_include": ["request"]}), ("web", "Class", "DataModel", {"inheritance_includes": ["Base"]})]
    g = CodeGraph.build(spark, str(tree))
    got = {r.id: r.semantic_roles for r in g.enrich(found).nodes.where("size(semantic_roles) > 0").collect()}
    assert got == {"app/views.py::index": ["View"], "app/models.py::User": ["DataModel"]}
    assert g.enrich(found, frameworks=("other",)).nodes.where("size(semantic_roles) > 0").count() == 0
    assert {r for r, in g.enrich(frameworks=("htmx",)).nodes.selectExpr("explode(semantic_roles)").collect()} <= {"Component"}


def test_the_gate(spark, frameworks, tree):
    g = CodeGraph.from_files({"python": spark.createDataFrame([("a.py", "x = 1\n")], "path string, content string")})
    bad = adapters.load_rules(spark, str(frameworks), ("odd",))
    for call in (lambda: g.enrich(bad), lambda: g.enrich_from(g.enrich(), bad)):
        with pytest.raises(GovernanceError, match="Nonsense"):
            call()
    report = {(r.severity, r.place, r.problem) for r in adapters.report(spark, str(frameworks), ("odd", "none"), str(frameworks / "core")).collect()}
    assert {("error", "odd[0]", "unknown core node Nonsense"), ("error", "odd[0]", "unknown key no_such_key"), ("error", f"{adapters.CONTRACTS}: View", "unknown severity fatal"), ("error", adapters.MAPPING, "no mapping that can be read")} <= report
    purity = "code_purity_rules.json"
    assert {(p, x) for _, p, x in report if p.startswith(purity)} == {(purity, "no _meta"), (f"{purity}: more", "unknown key"), (f"{purity}: names", "missing key"), (f"{purity}: limits.strict", "str where bool is meant")}


def run(spark, capsys, *argv):
    assert cli.main(list(argv), spark) == 0
    return capsys.readouterr().out


def test_command_line(spark, tree, tmp_path, capsys):
    at = ["--graph", str(tmp_path / "g"), "--files", str(tree)]
    (tmp_path / "profile.json").write_text(json.dumps({"languages": ["python", "html"], "frameworks": ["htmx"]}))
    built = json.loads(run(spark, capsys, *at, "build", str(tree), "--enrich", "--exclusions", str(tmp_path / "rules.json"), "--profile", str(tmp_path / "profile.json"), "--json"))
    assert built["nodes"] > 5 and {x["path"] for x in built["log"]} == {"app/broken.py", "app/latin.py"}
    ask = lambda *argv: json.loads(run(spark, capsys, *at, *argv, "--json"))
    assert {x["id"] for x in ask("search", "user")} == {"app/models.py::User", "app/models.py::User::name", "app/models.py::User::save"}
    assert [x["id"] for x in ask("search", "user", "--type", "class")] == ["app/models.py::User"]
    assert ask("locate", "app/models.py::User")["line_start"] == 1 and ask("locate", "nowhere") == {"error": "Node not found"}
    assert ask("read", "app/models.py::helper")["content"].startswith("def helper") and "error" in ask("read", "Template:web/page.html")
    assert ask("details", "app/views.py::index")["signature"]["args"] == ["request"]
    assert ask("impact", "app/models.py::helper")["app/views.py::index"]["depth"] == 1
    assert ask("dependencies", "app/views.py::index")["app/models.py::helper"] == {"depth": 1, "relation": "calls", "node_type": "Function"}
    calls = ask("call-graph", "app/models.py::helper")
    assert calls["summary"] == {"incoming_count": 2, "outgoing_count": 0} and {x["node"] for x in calls["incoming"]} == {"app/views.py::index", "app/models.py::User::save"}
    stats = ask("stats")
    assert stats["meta"]["enriched"] is True and stats["by_type"]["Class"] == 1 and stats["nodes"] == sum(stats["by_type"].values())
    assert ask("list-files")[:2] == ["app/models.py", "app/views.py"] and ask("validate")["status"] == "pass"
    assert {x["reason"] for x in ask("pending")} == {"new_file"} and {x["reason"] for x in ask("pending", "--mode", "full")} == {"full_mode"}
    assert run(spark, capsys, *at, "list-files").startswith("Found ") and "--- Code (lines) ---" in run(spark, capsys, *at, "read", "app/models.py::helper")
    assert "app/models.py::User (Class)" in run(spark, capsys, *at, "search", "user")


def test_diff_is_written(spark, tmp_path):
    ddl = "path string, content string"
    old = CodeGraph.from_files({"python": spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", "y = 1\n")], ddl)})
    new = CodeGraph.from_files({"python": spark.createDataFrame([("a.py", "x = 1\n"), ("c.py", "z = 1\n")], ddl)})
    new.write_diff(old, str(tmp_path / "d"))
    assert {r.id: r.status for r in spark.read.parquet(str(tmp_path / "d/files")).collect()} == {"File:a.py": "UNCHANGED", "File:b.py": "REMOVED", "File:c.py": "ADDED"}
    assert {r.status for r in new.write_diff(None, str(tmp_path / "e")).collect()} == {"ADDED"}
    assert [r.violation for r in validate.first_violations(old.equivalence(new), 2).collect()] == sorted(r.violation for r in old.equivalence(new).collect())[:2]


def test_context_of_a_large_file_takes_several_rows(spark, tree):
    g = CodeGraph.build(spark, str(tree))
    whole = {r.owner: r for r in g.context().collect()}
    parts: dict[str, list] = {}
    for r in overlay.context(g.nodes, g.edges, g.ambiguities, items=2).collect():
        parts.setdefault(r.owner, []).append(r)
    assert set(parts) == set(whole) and any(len(rows) > 1 for rows in parts.values())
    for owner, rows in parts.items():
        assert len({r.segment for r in rows}) == len(rows)
        for part in ("node_ids", "edges", "ambiguities"):
            assert sorted(x for r in rows for x in r[part]) == sorted(whole[owner][part]), (owner, part)
    small = next(r for r in whole.values() if len(r.node_ids) <= 2 and len(r.edges) <= 1 and len(r.ambiguities) <= 2)
    assert len(parts[small.owner]) == 1


def test_context_has_edges_and_candidates(spark, tree):
    g = CodeGraph.build(spark, str(tree), ("python",))
    by = {r.owner: r for r in g.context().collect()}
    views = by["File:app/views.py"]
    assert ("app/views.py::index", "app/models.py::helper", "calls") in {tuple(e) for e in views.edges} and "app/views.py::index" in views.node_ids
    base = [a for a in by["File:app/models.py"].ambiguities if a.kind == "inheritance_target_unproven"]
    assert len(base) == 1 and base[0].scope == "app/models.py::User" and base[0].candidates == []
    assert overlay.candidates(g.nodes, g.ambiguities.selectExpr("id", "'call(helper)' AS expression")).where("candidate = 'app/models.py::helper'").count() == g.ambiguities.count()


def test_removing_the_last_file_leaves_an_empty_graph(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "language string, path string, content string")
    out = str(tmp_path / "graph")
    absorb(batch(("python", "a.py", "x = 1\n")), 0, out)
    absorb(batch(("python", "a.py", None)), 1, out)
    assert latest(spark, out).nodes.count() == 0
    absorb(batch(("python", "b.py", "y = 1\n")), 2, out)
    assert {r.id for r in latest(spark, out).nodes.where("node_type = 'File'").collect()} == {"File:b.py"}
    absorb(batch(("python", "b.py", "y = 1\n"), ("cobol", "c", "z")), 3, out)  # nothing new
    assert not (tmp_path / "graph/v3").exists()
    for k in range(4, 7):
        absorb(batch(("python", "b.py", f"y = {k}\n")), k, out)
    assert sorted(p.name for p in (tmp_path / "graph").iterdir()) == ["v4", "v5", "v6"]


def test_only_what_changed_is_parsed(spark, tmp_path, monkeypatch):
    """Files that came are parsed, and those whose imports mean something else; the graph is that of all."""
    from graphloom.operators import extract_css, extract_html, extract_python

    ddl = "path string, content string"
    a, b, c = "def f():\n    pass\n", "from a import f\n\n\ndef g():\n    f()\n", "x = 1\n"
    one = {"python": [("a.py", a), ("b.py", b), ("c.py", c)], "html": [("p.html", '<a href="/x">x</a>'), ("q.html", '<a href="/y">y</a>')], "css": [("s.css", ".a { }"), ("t.css", ".b { }")]}
    two = {"python": [("a.py", "def other():\n    pass\n"), ("b.py", b), ("c.py", c), ("d.py", "y = 1\n")], "html": [("p.html", '<a href="/z">x</a>'), ("q.html", '<a href="/y">y</a>')], "css": [("t.css", ".b { }"), ("u.css", "#c { }")]}
    table = lambda part: {k: spark.createDataFrame(rows, ddl) for k, rows in part.items()}
    came: dict[str, list] = {}

    def seen(module, name, label):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda files, *more: came.setdefault(label, []).extend(r.path for r in files.select("path").collect()) or real(files, *more))

    CodeGraph.from_files(table(one), parsed=str(tmp_path / "1"))
    seen(extract_python, "fragments", "python"), seen(extract_html, "tags", "html"), seen(extract_css, "selectors", "css")
    again = CodeGraph.from_files(table(two), parsed=str(tmp_path / "2"), before=str(tmp_path / "1"))
    assert {k: sorted(v) for k, v in came.items()} == {"python": ["a.py", "b.py", "d.py"], "html": ["p.html"], "css": ["u.css"]}
    monkeypatch.undo()
    want = CodeGraph.from_files(table(two))
    for part in ("nodes", "edges", "ambiguities"):
        rows = lambda g: sorted(map(str, getattr(g, part).select(sorted(getattr(want, part).columns)).collect()))  # noqa: B023, E731
        assert rows(again) == rows(want), part
    third = CodeGraph.from_files(table(two), parsed=str(tmp_path / "3"), before=str(tmp_path / "2"))
    assert sorted(r.id for r in third.nodes.collect()) == sorted(r.id for r in want.nodes.collect())


def test_scratch_tables_go(spark, tmp_path):
    from graphloom.sources.shared import scratch, shared_dir, spool

    with scratch():
        gone, kept = spool(spark.range(3), "gone-test"), spool(spark.range(3), "kept-test", keep=True)
        assert gone.count() == kept.count() == 3
    with scratch():
        with scratch():
            outer = spool(spark.range(3), "gone-test-too", keep=True)
        assert outer.count() == 3
    from pathlib import Path

    left = {p.name[:9] for p in Path(shared_dir(spark).removeprefix("file://"), "graphloom").iterdir()}
    assert "kept-test" in left and "gone-test" not in left


def test_sessions(spark, tmp_path):
    at = str(tmp_path / "log")
    session.log_session(spark, at, "2026-01-01T00:00:00Z", {"build_runtime_ast": "pass"}, "ci", {"raw_ast": "x"}, "code_edit", ("views.py",), "paging")
    for _ in range(2):
        session.log_session(spark, at, "2026-01-02T00:00:00Z", {"build_runtime_ast": "pass", "enrich_runtime_ast": "fail"})
    assert {r.session_id[8:10]: r.result for r in session.sessions(spark, at).collect()} == {"01": "success", "02": "failure"} and session.sessions(spark, at).count() == 2
    with pytest.raises(ValueError):
        session.log_session(spark, at, "x", {"no such step": "pass"})


def test_rules_of_all_frameworks_pass_the_gate():
    assert not [x for x in rules.check_rules(rules.RULES, NODE_TYPES) if x[0] == "error"]
