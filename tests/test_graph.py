"""Hand graphs: walks, merging, diffs, rules, checks."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from graphloom.functions.text import glob_regex, relative_module
from graphloom.operators import diff, merge, overlay, query, rules, traverse, validate
from graphloom.schema import EDGE_RULES, NODE_TYPES, TRIPLES
from graphloom.sources.profile import Profile, check_profile, load_profile


def edges(spark, *pairs):
    return spark.createDataFrame([(i, *p, None) if len(p) == 3 else (i, *p) for i, p in enumerate(pairs)], "seq long, source string, target string, type string, call_line int")


def nodes(spark, *rows):
    return spark.createDataFrame([(i, n, t, n) for i, (n, t) in enumerate(rows)], "seq long, id string, node_type string, name string")


def walk(spark, pairs, start, depth, f=traverse.dependencies, known="ABCD"):
    found = f(nodes(spark, *((k, "Function") for k in known)), edges(spark, *((a, b, "calls") for a, b in pairs)), start, depth)
    return {r.id: r.depth for r in found.collect()}


DIAMOND, AGAIN = ("AB", "BC", "AC", "CD"), ("AC", "AB", "BC", "CD")


def test_vocabulary():
    assert (len(NODE_TYPES), len(EDGE_RULES), len(TRIPLES)) == (35, 19, 97)


@pytest.mark.parametrize("pairs", [DIAMOND, AGAIN])
def test_least_depths_of_a_diamond(spark, pairs):
    assert walk(spark, pairs, "A", 2) == {"B": 1, "C": 1, "D": 2}
    assert walk(spark, pairs, "D", 2, traverse.impact) == {"C": 1, "A": 2, "B": 2}


def test_ordered_walk_depends_on_the_order(spark):
    assert walk(spark, DIAMOND, "A", 2, traverse.reach_ordered) == {"B": 1, "C": 2}
    assert walk(spark, AGAIN, "A", 2, traverse.reach_ordered) == {"B": 1, "C": 2, "D": 2}


def test_cycle_and_unknown_node(spark):
    assert walk(spark, ("AB", "BA"), "A", 2) == {"B": 1, "A": 2}
    assert walk(spark, ("AB",), "Z", 3) == {} and walk(spark, ("AB",), "A", 0) == {}
    found = traverse.dependencies(nodes(spark, ("A", "File")), edges(spark, ("A", "X", "defines")), "A").first()
    assert (found.id, found.node_type, found.relation) == ("X", "Unknown", "defines")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABCDEF"), st.sampled_from("ABCDEF")), min_size=1, max_size=12), st.integers(1, 4))
def test_least_depths_are_those_of_a_plain_search(spark, pairs, depth):
    want, level = {}, {"A"}
    for d in range(1, depth + 1):
        level = {b for a, b in pairs if a in level} - set(want)
        want |= dict.fromkeys(level, d)
    assert walk(spark, pairs, "A", depth, known="ABCDEF") == want


def test_containment(spark):
    n = nodes(spark, ("F", "File"), ("C", "Class"), ("M", "Method"), ("V", "Variable"))
    e = edges(spark, ("F", "C", "defines"), ("C", "M", "contains_member"), ("M", "V", "writes_to"))
    assert {r.id: r.owner for r in traverse.containment(n, e).collect()} == {"F": "F", "C": "F", "M": "F"}


def test_containment_of_deep_nesting_and_cycles(spark):
    ids = ["F", *(f"C{k}" for k in range(36))]
    n = nodes(spark, *((i, "Class" if i != "F" else "File") for i in ids))
    e = edges(spark, *((a, b, "defines") for a, b in zip(ids, ids[1:])), (ids[-1], ids[1], "defines"))
    assert {r.id: r.owner for r in traverse.containment(n, e).collect()} == dict.fromkeys(ids, "F")


def test_merge_last_value_first_place_and_first_edge(spark):
    ddl = "seq long, id string, node_type string, name string, file_path string, docstring string"
    a = spark.createDataFrame([(0, "main.py", "File", "main.py", "main.py", None), (1, "main.py::f", "Function", "f", None, "old"), (2, "main.py::f", "Function", "f", None, "new")], ddl)
    b = spark.createDataFrame([(0, "app/main.py", "File", "main.py", "app/main.py", None)], ddl)
    e = spark.createDataFrame([(0, "defines", "main.py", "main.py::f", 5), (1, "defines", "main.py", "main.py::f", 9)], "seq long, edge string, from string, to string, call_line int")
    none = spark.createDataFrame([], "id string, kind string")
    n, m, _ = merge.merge([a, b], [e, e.limit(0)], [none, none])
    got = {r.id: (r.fragment, r.seq, r.docstring) for r in n.collect()}
    assert got == {"File:main.py": (0, 0, None), "main.py::f": (0, 1, "new"), "File:app/main.py": (1, 0, None)}
    assert [(r.source, r.target, r.call_line) for r in m.collect()] == [("File:main.py", "main.py::f", 5)]
    _, old, _ = merge.merge([a, b], [e, e.limit(0)], [none, none], compat=True)
    assert [r.source for r in old.collect()] == ["File:app/main.py"]  # the later name takes the alias


def test_diff(spark):
    ddl = "seq long, id string, node_type string, name string, hash string"
    new = spark.createDataFrame([(0, "same", "File", "s", "1"), (1, "edited", "File", "e", "2"), (2, "fresh", "File", "f", "3"), (3, "nohash", "File", "n", None), (4, "inside", "Class", "i", None), (5, "alone", "Class", "a", None)], ddl)
    old = spark.createDataFrame([(0, "same", "File", "s", "1"), (1, "edited", "File", "e", "0"), (2, "gone", "File", "g", "9"), (3, "nohash", "File", "n", None), (4, "inside", "Class", "i", None), (5, "alone", "Class", "a", None)], ddl)
    want = {"same": "UNCHANGED", "edited": "MODIFIED", "fresh": "ADDED", "gone": "REMOVED", "nohash": "MODIFIED"}
    assert {r.id: r.status for r in diff.file_status(new, old).collect()} == want
    status = diff.node_status(new, old, edges(spark, ("same", "inside", "defines")))
    assert {r.id: r.status for r in status.collect()} == want | {"inside": "UNCHANGED", "alone": "MODIFIED"}
    assert {r.status: r.n for r in diff.status_counts(status).collect()} == {"UNCHANGED": 2, "MODIFIED": 3, "ADDED": 1, "REMOVED": 1}
    assert {r.id: r.action for r in diff.partition(new, status, old).collect()}["inside"] == "preserve"


def _code(spark):
    sign = "struct<args:array<string>,defaults:array<string>,decorators:array<string>,returns:string>"
    n = spark.createDataFrame(
        [
            (0, "views.py", "File", "views.py", "app/views.py", None, None), (1, "Model", "Class", "Model", None, None, None), (2, "User", "Class", "User", None, None, None),
            (3, "index", "Function", "index", None, (["request"], [], ["@login"], None), None), (4, "render", "Function", "render", None, ([], [], [], None), None),
            (5, "page", "Template", "page", None, None, {"hx-get": "/x"}), (6, "bare", "Template", "bare", None, None, {}),
        ],
        f"seq long, id string, node_type string, name string, file_path string, signature {sign}, attributes map<string,string>",
    )
    e = edges(spark, ("User", "Model", "extends"), ("views.py", "index", "defines"), ("index", "render", "calls"), ("render", "index", "decorates"))
    doubts = spark.createDataFrame([("a1", "inheritance_target_unproven", "Model", "models.Model", "r", "unresolved")], "id string, kind string, source_scope string, expression string, reason string, confidence string")
    return n, e, doubts


@pytest.mark.parametrize(
    "loose, core, keys, want",
    [
        (False, "Class", {"inheritance_includes": ["Model"]}, {"User"}), (True, "Class", {"inheritance_includes": ["models.Model"]}, {"Model"}),
        (False, "Class", {"inheritance_includes": ["models.Model"]}, set()), (False, "Function", {"file_path_contains": "views"}, {"index"}),
        (False, "Function", {"file_path_contains": "*/models*"}, set()), (False, "Function", {"decorated_by": ["render"]}, {"index"}),
        (False, "Function", {"used_in_calls": ["render"], "arg_names_include": ["request"]}, {"index"}), (False, "Function", {"function_name": ["render", "x"]}, {"render"}),
        (False, "Function", {"decorators": ["auth.login"]}, {"index"}), (False, "Template", {"contains_attributes": ["hx-get"]}, {"page"}),
    ],
)
def test_rules(spark, loose, core, keys, want):
    n, e, doubts = _code(spark)
    found = rules.Matcher(n, e, doubts, loose).matches(rules.Rule("t", core, "R", keys))
    assert {r.id for r in found.collect()} == want


def test_compat_rules_ignore_what_they_do_not_know(spark):
    n, e, doubts = _code(spark)
    r = (rules.Rule("t", "Template", "Component", {"contains_attributes": ["hx-get"]}),)
    assert {x.id for x in rules.roles(n, e, doubts, r).collect()} == {"page"}
    assert {x.id for x in rules.roles(n, e, doubts, r, compat=True).collect()} == {"page", "bare"}


def test_roles_keep_the_order_of_rules_and_come_once(spark):
    n, e, doubts = _code(spark)
    r = tuple(rules.Rule("t", "Function", role, {"function_name": ["render"]}) for role in ("B", "A", "B"))
    assert [x.semantic_roles for x in rules.roles(n, e, doubts, r, loose=False).collect()] == [["B", "A"]]
    done = rules.enriched(n, rules.roles(n, e, doubts, r, loose=False))
    assert validate.equivalence((n, e, doubts), (done, e, doubts)).count() == 0


def test_validation(spark):
    n = nodes(spark, ("f", "File"), ("c", "Class"), ("v", "Variable"), ("x", "Nonsense"), (None, "Class"))
    e = edges(spark, ("f", "c", "defines"), ("f", "lost", "defines"), ("gone", "c", "defines"), ("f", "v", "extends"), ("f", "c", "made_up"), ("f", None, "defines"))
    a = spark.createDataFrame([("1", "k", "r", "heuristic"), ("2", "k", None, "unresolved"), ("3", "k", "r", "sure")], "id string, kind string, reason string, confidence string")
    issues = sorted(r.issue for r in validate.validate(n, e, a).collect())
    assert issues == sorted(["missing node id", "unknown node type", "malformed edge", "unknown edge type", "orphan source", "orphan target", "source type not allowed", "target type not allowed", "malformed ambiguity", "unusual confidence"])
    assert validate.counts(n, e, a, validate.validate(n, e, a)).first().status == "fail"


def test_search_takes_signs_literally_and_cuts_at_fifty(spark):
    n = spark.createDataFrame([(i, f"id{i}", "File", "100%" if i == 3 else f"N_{i}", None) for i in range(60)], "seq long, id string, node_type string, name string, line_end int")
    assert [r.id for r in query.search(n, "%").collect()] == ["id3"]
    assert [r.seq for r in query.search(n, "ID").collect()] == list(range(50))
    assert query.search(n, "id", node_type="class").count() == 0


def test_overlay_pending(spark):
    n = spark.createDataFrame([(0, "a", "File", "a", "1"), (1, "b", "File", "b", "2"), (2, "c", "Class", "c", None)], "seq long, id string, node_type string, name string, hash string")
    level2 = spark.createDataFrame([("a", ("i", "s", 1, ["t"], True, [], "1", "now"))], "id string, llm_enrichment struct<intent:string,summary:string,complexity_score:int,domain_tags:array<string>,pure_logic:boolean,side_effects:array<string>,enriched_at_hash:string,enriched_at:string>")
    assert {r.id: r.reason for r in overlay.pending(n.withColumn("file_path", n["name"]), level2).collect()} == {"a": "unchanged", "b": "new_file"}


def test_text_functions():
    import re

    for pattern, hit, miss in (("views", "app/views.py", "app/models.py"), ("*/v?ews*", "a/views.py", "views.py"), ("[!a]*", "b", "a"), ("a.b", "xa.b", "xaxb")):
        assert re.search(glob_regex(pattern), hit) and not re.search(glob_regex(pattern), miss)
    assert relative_module("a/b/c.py", 1, "x.y") == "a/b/x/y" and relative_module("a/b/c.py", 2, None) == "a" and relative_module("c.py", 2, "x") is None


def test_profile(tmp_path):
    (tmp_path / "p.json").write_text('{"languages": ["python", "java"], "frameworks": ["django"], "project_root": "src"}')
    p = load_profile(tmp_path / "p.json")
    assert p == Profile(("python", "java"), ("django",), "src") and p.root(tmp_path) == (tmp_path / "src").resolve()
    assert check_profile(p, frozenset({"python"}), frozenset({"django"})) == ["unknown language java"]
    assert load_profile(tmp_path / "none.json") is None
