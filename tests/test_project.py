"""Repositories in temporary folders: scan, lines, facts, coverage, gate, imports and calls."""

import json

import pytest
from pyspark.sql import functions as F

from loam import cli
from loam.functions import scalars as S
from loam.operators import cycles, graph
from loam.plans import project, render
from loam.sources import analyzers, environment, policy, pyfacts, repo, rules
from loam.sources.lines import c_lines, python_lines


@pytest.mark.parametrize(
    ("lexer", "text", "want"),
    [
        (python_lines, b"# c\n\nx = 1  # t\n", (3, 1, 1, 1)),
        (python_lines, b'"""a\n# text\n"""\n', (3, 3, 0, 0)),
        (python_lines, b"", (0, 0, 0, 0)),
        (python_lines, b"x = 'a\\'#'\n", (1, 1, 0, 0)),
        (c_lines, b"/* a\n\n*/\nint x; // y\n", (4, 1, 3, 0)),
        (c_lines, b'let s = "//";\n', (1, 1, 0, 0)),
        (c_lines, b'r##"a"#\n// b"##;\n', (2, 2, 0, 0)),
        (c_lines, b'R"x(a)"\n// )x";\n', (2, 2, 0, 0)),
        (c_lines, b"/* /* */ x\n*/ y\n", (2, 1, 1, 0)),
    ],
)
def test_lines(lexer, text, want):
    assert lexer(text) == want


def facts(text):
    return pyfacts.python_facts("m.py", text.encode())


def test_decisions_and_nesting():
    f = facts("def f(xs, y):\n    if xs and y:\n        pass\n    for x in xs:\n        if x: pass\n        elif y: pass\n    assert xs\n    return [z for z in xs if z]\n")["symbols"][1]
    assert len(f["decisions"]) == 8 and max(f["nesting"]) == 2
    g = facts("def g():\n    with a:\n        try:\n            for x in y: pass\n            else: pass\n        except E: pass\n        else: pass\n        finally: pass\n")["symbols"][1]
    assert g["decisions"] == ["loop", "exception-handler"]
    m = facts("def h(v):\n    match v:\n        case 1: pass\n        case other: pass\n    return lambda q: q if q and v else 0\n")["symbols"]
    assert len(m[1]["decisions"]) == 1 and len(m[2]["decisions"]) == 2 and m[2]["parent_id"] == m[1]["id"]


def test_symbols_parameters_and_docstrings():
    s = facts('class C:\n    "doc"\n    @classmethod\n    async def m(cls, item, /, limit=10, *args, strict=False, **o):\n        """ """\n    def n(self): b"x"\n')["symbols"]
    assert [x["kind"] for x in s] == ["module", "class", "method", "method"]
    assert [p["kind"] for p in s[2]["parameters"]] == ["positional-only", "positional-only", "positional-or-keyword", "variadic-positional", "keyword-only", "variadic-keyword"]
    assert s[2]["modifiers"] == ["async", "classmethod"] and [x["documentation"] for x in s] == ["missing", "documented", "missing-blank", "missing"]


def test_import_contexts():
    text = "from typing import TYPE_CHECKING as T\nif T:\n    import a\nelse:\n    import b\ntry:\n    import c\nexcept ImportError:\n    import d\ndef f():\n    import e\nclass K:\n    from . import g as h\n"
    got = {i["module"] or i["imported"]: (i["scope"], i["usage"], i["requirement"], i["conditional"]) for i in facts(text)["imports"]}
    assert got["a"] == ("module", "type-only", "required", True) and got["b"] == ("module", "runtime", "required", True)
    assert got["c"] == ("module", "runtime", "optional", True) and got["d"][3] and got["e"][0] == "callable" and got["g"][0] == "class"


def test_broken_files_keep_what_parses():
    f = facts("import os\ndef good():\n    return os.x()\nclass B:\n    def bad(self):\n        if:\n            pass\nx = f()\n")
    kinds = {(s["qualified_name"], s["partial"]) for s in f["symbols"][1:]}
    assert f["status"] == "partial" and kinds == {("good", False), ("B", True), ("B.bad", True)} and len(f["calls"]) == 2
    assert pyfacts.python_facts("a.py", b"x = '\xff'")["diagnostics"][0]["code"] == "source-not-utf8"
    assert facts("")["status"] == "successful" and pyfacts.python_facts("a.py", b"(" * 5000)["status"] in ("partial", "failed")


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in {
        "src/shop/__init__.py": "",
        "src/shop/api.py": "import json\nimport requests\nimport missing_package\nfrom . import service\nfrom .service import Client as K\n\ndef go():\n    '''Doc.'''\n    json.dumps(1)\n    return service.helper() or K()\n",
        "src/shop/service.py": "from .models import Item\n\nclass Client:\n    def send(self):\n        return self.retry()\n    def retry(self):\n        return self.send()\n\ndef helper():\n    return helper()\n\ndef duplicate(): pass\ndef duplicate(): pass\ndef caller(): duplicate()\n",
        "src/shop/models.py": "from shop import service\n\nclass Item:\n    pass\n\ndef deep(a):\n" + "".join(f"    if a == {k}: pass\n" for k in range(10)),
        "README.md": "x", "Cargo.toml": "", "events.jsonl": "", "logo.PNG": "", "LICENSE": "", "target/x.rs": "fn", ".gitignore": "generated/\n*.log\n!keep.log\n",
        "generated/a.py": "", "b.log": "", "keep.log": "", "main.rs": "// c\nfn main() {}\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_walk(shop):
    found = {p: (e, s) for p, e, s in repo.walk(shop)}
    assert found["target"] == ("builtin_directory", "ignored") and found["generated"] == ("directory", "ignored")
    assert found["b.log"][1] == "ignored" and found["keep.log"][1] == "standard" and "generated/a.py" not in found
    again = {p: s for p, _, s in repo.walk(shop, ["generated/**", "target/**"])}
    assert again["generated/a.py"] == "included" and "target/x.rs" not in again
    assert {p for p, _, s in repo.walk(shop, exact=True) if s == "ignored"} >= {"generated/a.py", "generated", "b.log", "target"}
    assert repo.encode_path(b"dir/mod%\\\xff.rs") == "dir/mod%25%5C%FF.rs"
    with pytest.raises(ValueError, match="negated"):
        repo.walk(shop, ["!x"])


def test_inventory_command(spark, shop):
    text, code = cli.run(cli.parser().parse_args(["inventory", shop]), spark)
    got = {r["category"]: r["n"] for r in json.loads(text)["categories"]}
    assert code == 0 and got == {"source": 5, "documentation": 1, "configuration": 1, "data": 1, "assets": 1, "uncategorized": 3}


def test_gate(spark, shop):
    run = lambda *a: cli.run(cli.parser().parse_args(["analyze", shop, "--gate", *a]), spark)
    text, code = run()
    first = json.loads(text)["findings"][0]
    assert code == 2 and json.loads(text)["status"] == "human-review-required"
    score = next(f for f in json.loads(text)["findings"] if f["rule_id"] == "complexity-threshold")
    assert (score["observed"], score["risk"], score["action"]) == (11, "high", "human-review") and first["risk"] == "unknown"
    assert run("--block-at", "11")[1] == 3


def test_dependencies(spark, shop):
    p = project.load(spark, shop)
    modules = project.local_modules(p, project.package_roots(shop))
    imports = project.resolved_imports(p, modules)
    c = project.import_graph(imports, modules)
    assert c["coverage"].first().asDict() == {"total": 7, "exact": 4, "ambiguous": 0, "unresolved": 3}
    cycle = c["explanations"].collect()
    assert len(cycle) == 1 and len(cycle[0]["members"]) == 2 and len(cycle[0]["cuts"]) == 1 and len(cycle[0]["witness"]) == 3
    calls = {(r["callee"], r["kind"]) for r in project.resolved_calls(p, modules, imports).collect()}
    assert calls >= {("self.retry", "exact"), ("self.send", "exact"), ("helper", "exact"), ("service.helper", "exact"), ("K", "exact"), ("json.dumps", "external"), ("duplicate", "ambiguous")}
    nodes, relations = render.focused(c["nodes"], c["relations"], c["components"], "shop.models", 0)
    assert nodes.count() == 2 and relations.count() == 2
    assert "subgraph" in render.mermaid(nodes, relations, c["components"]) and "cluster_0" in render.dot(nodes, relations, c["components"])
    assert "</script><" not in render.page("x", nodes, relations, c["components"])
    with pytest.raises(ValueError, match="shop.models"):
        render.focused(c["nodes"], c["relations"], c["components"], "shop.modls")
    text, _ = cli.run(cli.parser().parse_args(["dependencies", shop, "--path-from", "shop.api", "--path-to", "shop.models"]), spark)
    assert [n.split("@")[0] for n in json.loads(text)["path"]] == ["python:shop.api", "python:shop.service", "python:shop.models"]


def asked(spark, *args):
    return cli.run(cli.parser().parse_args([str(a) for a in args]), spark)


def test_calls_command(spark, shop):
    report = json.loads(asked(spark, "calls", shop)[0])
    kinds = {n["label"]: n["kind"] for n in report["nodes"]}
    assert kinds["shop.service::Client.retry"] == "local" and kinds["json.dumps"] == "external" and kinds["duplicate"] == "ambiguous"
    assert {"shop.service::duplicate#1", "shop.service::duplicate#2"} <= set(kinds)
    assert {c["kind"]: c["n"] for c in report["coverage"]} == {"exact": 5, "ambiguous": 1, "external": 1}
    near = json.loads(asked(spark, "calls", shop, "--focus", "shop.service::Client.send", "--exact-only")[0])
    assert {n["label"] for n in near["nodes"]} == {"shop.service::Client.send", "shop.service::Client.retry"} and len(near["relations"]) == 2
    path = json.loads(asked(spark, "calls", shop, "--path-from", "shop.api::go", "--path-to", "shop.service::helper")[0])
    assert path["found"] and [(r["step"], r["callee"] if "callee" in r else r["kind"]) for r in path["relations"]] == [(1, "exact")]
    closed = json.loads(asked(spark, "calls", shop, "--closure", "shop.service::Client.send")[0])
    assert {n["label"] for n in closed["nodes"]} == {"shop.service::Client.send", "shop.service::Client.retry"} and len(closed["relations"]) == 2 and len(closed["components"]) == 2
    with pytest.raises(ValueError, match="select one with #N"):
        asked(spark, "calls", shop, "--focus", "shop.service::duplicate")
    with pytest.raises(ValueError, match="shop.service::helper"):
        asked(spark, "calls", shop, "--focus", "shop.service::helpr")
    page = asked(spark, "calls", shop, "--format", "html", "--include-source")[0]
    assert "return self.retry()" in page and "</script><" not in page
    text = asked(spark, "calls", shop, "--format", "text")[0]
    assert "Most depended on:" in text and "ambiguous" in text and "classDef ambiguous" in asked(spark, "calls", shop, "--format", "mermaid")[0]


def test_dependencies_closure_has_a_direction_of_its_own(spark, shop):
    seen = json.loads(asked(spark, "dependencies", shop, "--closure", "shop.models")[0])
    assert {n["node"].split("@")[0] for n in seen["nodes"]} == {"python:shop.models", "python:shop.service"} and len(seen["relations"]) == 2
    up = json.loads(asked(spark, "dependencies", shop, "--closure", "shop.models", "--direction", "dependents")[0])
    assert len(up["nodes"]) == 3
    assert "Import contexts:" in asked(spark, "dependencies", shop, "--format", "text")[0]


def test_analyze_selection_details_and_single_files(spark, shop, tmp_path):
    one = json.loads(asked(spark, "analyze", f"{shop}/src/shop/models.py")[0])
    assert [f["path"] for f in one["files"]] == ["models.py"] and one["coverage"]["selected_language_files"] == 1
    # main.rs is a known file without an analyzer, but isn't selected here.
    some = json.loads(asked(spark, "analyze", shop, "--match", "src/.*[.]py", "--details", "src/shop/api.py", "--diagnostics", "src/shop/api.py")[0])
    assert some["coverage"]["unsupported_selected_files"] == 0 and not [f for f in some["findings"] if f["rule_id"] == "analysis-incomplete"]
    assert [d["path"] for d in some["details"]] == ["src/shop/api.py"] and some["diagnostics"][0]["diagnostics"] == [] and some["analyzers"] == [{"language": "python", "analyzed": 4, "successful": 4, "partial": 0, "failed": 0}]
    gate = json.loads(asked(spark, "analyze", shop, "--profile", "gate", "--top", "1")[0])
    assert "files" not in gate and len(gate["findings"]) == 1 < gate["finding_count"]
    assert "Facts:" in asked(spark, "analyze", shop, "--format", "text")[0]
    for wrong, said in ((["analyze", f"{shop}/README.md"], "no known language"), (["analyze", f"{shop}/main.rs"], "no analyzer"), (["analyze", f"{shop}/target/x.rs"], "never analyzed"), (["analyze", f"{shop}/src/shop/api.py", "--match", "x"], "single file"),
                        (["analyze", shop, "--details", "nowhere.py"], "nowhere.py"), (["analyze", shop, "--no-documentation", "--documentation-below", "50"], "documentation"), (["analyze", shop, "--block-at", "20", "--no-block"], "exclude"),
                        (["analyze", shop, "--output", "x"], "html"), (["inventory", shop, "--format", "dot"], "no dot"), (["dependencies", shop, "--path-from", "a"], "need each other"), (["dependencies", shop, "--closure", "a", "--direction", "both"], "not both")):
        with pytest.raises(ValueError, match=said):
            asked(spark, *wrong)


def test_tests_count_in_the_documentation_gate_if_asked(spark, tmp_path):
    (tmp_path / "app.py").write_text('"""Doc."""\n')
    (tmp_path / "test_app.py").write_text("def test_a(): pass\n")
    run = lambda *more: asked(spark, "comments", tmp_path, "--gate", "--documentation-below", "60", *more)
    assert run()[1] == 0 and run("--include-tests")[1] == 2
    assert json.loads(run("--include-tests", "--top", "1")[0])["missing"]["total"] == 2


def test_inventory_lists_and_warns(spark, shop, tmp_path):
    rules_file = tmp_path / "r.json"
    rules_file.write_text('{"config_version": "0.1.0", "inventory": {"categories": {"data": {"include_filenames": ["README.md"]}}}}')
    run = lambda *more: json.loads(asked(spark, "inventory", shop, "--config", rules_file, *more)[0])
    assert [f["path"] for f in run("--list-files", "data")["files"]] == ["README.md", "events.jsonl"] and "exclude it there" in run()["diagnostics"][0] and run("--no-warnings")["diagnostics"] == []
    assert "Listed:" in asked(spark, "inventory", shop, "--format", "text", "--list-files", "all")[0]


def test_unreadable_folders_are_told(spark, tmp_path, monkeypatch):
    import os

    (tmp_path / "shut").mkdir()
    (tmp_path / "a.py").write_text("")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("shut"):
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    assert repo.walk(str(tmp_path)) == [("a.py", "file", "standard"), ("shut", "directory", "unreadable")]
    assert json.loads(asked(spark, "inventory", tmp_path)[0])["diagnostics"] == ["directory-unreadable: shut"]


def test_listings_have_the_states_of_a_walk(spark, shop):
    names = [p for p, e, _ in repo.walk(shop, exact=True) if e == "file"] + ["target/x.rs"]
    listing = spark.createDataFrame([(n,) for n in names], "path string")
    rows = [("", open(f"{shop}/.gitignore").read())]
    for more in ({}, {"exact": True}, {"include": ["generated/**", "target/**"]}, {"include": ["*.py"], "exact": True}):
        assert {tuple(r) for r in repo.states(listing, rows, **more).collect()} == set(repo.walk(shop, **more))


def test_analyzers_are_one_for_each_language(spark):
    registry = analyzers.Registry(analyzers.PYTHON)
    with pytest.raises(analyzers.AnalyzerError, match="already"):
        registry.register(analyzers.PYTHON)
    registry.register(analyzers.Analyzer("none", "rust", "1", lambda files: files.select("path")))
    rows = registry.descriptors(spark).collect()
    assert [r["language"] for r in rows] == ["python", "rust"] and "documentation" not in analyzers.PYTHON.without_documentation().capabilities
    assert registry.of("rust", "x.rs").id == "none"


def test_interpreters_are_asked_within_bounds(monkeypatch):
    import sys

    found = environment.probe(sys.executable)
    assert "json" in found["stdlib"]
    monkeypatch.setattr(environment, "MOST_BYTES", 1000)
    with pytest.raises(environment.ProbeError, match="too much"):
        environment.said([sys.executable, "-c", "print('x' * 10_000_000)"])
    monkeypatch.setattr(environment, "SECONDS", 0.3)
    with pytest.raises(Exception, match="timed out"):
        environment.said([sys.executable, "-c", "import time; time.sleep(9)"])
    with pytest.raises(environment.ProbeError, match="pyvenv"):
        environment.probe(venv="/nowhere")


def test_graphs_whose_ends_are_unknown_are_refused(spark):
    nodes = spark.createDataFrame([("a", "local"), ("b", "local"), ("x", "external")], "node string, kind string")
    edge = lambda a, b: spark.createDataFrame([(a, b, "exact", 1)], "src string, dst string, kind string, weight long")
    assert project.validated(edge("a", "b"), nodes).count() == 1
    for bad in (edge("a", "x"), edge("z", "a")):
        with pytest.raises(project.GraphError, match="unknown"):
            project.validated(bad, nodes)
    symbols = spark.createDataFrame([("p", "s")], "path string, id string")
    lost = project.unmatched_owners(spark.createDataFrame([("p", "s", 1), ("p", "t", 2)], "path string, enclosing string, line long"), symbols).collect()
    assert [tuple(r) for r in lost] == [("p", 2, "call-owner-unknown")]


def test_names_of_nodes_and_paths(spark):
    df = spark.createDataFrame([("python:a.b@a/b.py", "a\\b.py", "x/y.%FF"), ("python:stdlib:os", "c", "x/y.PY")], "node string, raw string, path string")
    got = [tuple(r) for r in df.select(S.short_name(F.col("node")), S.subtitle(F.col("node")), S.forward(F.col("raw")), S.extension_of(F.col("path"))).collect()]
    assert got == [("b", "a/b.py", "a/b.py", "[non-utf8]"), ("os", "stdlib", "c", "py")]


def test_cycles_in_plain_graphs():
    assert cycles.shortest_cycle({"a": ["a", "b"], "b": ["a"]}) == ["a", "a"]
    assert cycles.shortest_cycle({"a": ["b", "c"], "b": ["a", "c"], "c": ["a"]}) == ["a", "b", "a"]
    assert cycles.feedback_edges(["a", "b"], {("a", "b"): 3, ("b", "a"): 1}) == [("b", "a")]


def test_rule_files_and_policies():
    with pytest.raises(rules.RuleError, match="unknown keys"):
        rules.parse('{"config_version": "0.1.0", "other": 1}')
    with pytest.raises(rules.RuleError, match="claimed"):
        rules.layered(['{"config_version": "0.1.0", "inventory": {"categories": {"data": {"include_extensions": ["py"]}}}}'])
    found, warnings = rules.layered(['{"config_version": "0.1.0", "inventory": {"ignore_defaults": true, "categories": {"data": {"mode": "extend", "include_filename_regexes": ["a.*"]}}}}'])
    assert found == [("data", "regex", "a.*", False)] and len(warnings) == 1
    p = policy.from_json('{"policy_version": "0.1.0", "cyclomatic_complexity": {"human_review_at": 3, "exceptions": [{"symbol_id": "x", "reason": "r", "approved_max": 3}]}}')
    assert policy.with_options(p, review_at=4).sources == ("built-in", "policy-file", "cli") and p.exceptions == (("x", 3),)
    with pytest.raises(policy.PolicyError, match="reason"):
        policy.from_json('{"policy_version": "0.1.0", "cyclomatic_complexity": {"exceptions": [{"symbol_id": "x", "reason": " ", "unbounded": true}]}}')


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    paths = {r["target"]: "".join(r["path"]) for r in graph.shortest_paths(edges, nodes.where("node = 'a'")).collect()}
    assert paths == {"a": "a", "b": "ab", "c": "ac", "d": "abd", "e": "abde"}
    assert {r["node"] for r in graph.closure_of(edges, nodes.where("node = 'd'"), "dependents").collect()} == set("abcde")
    parts = {r["node"]: (r["component"], r["cyclic"]) for r in graph.strong_components(nodes, edges).collect()}
    assert parts["e"] == ("d", True) and parts["f"] == ("f", False) and parts["a"] == ("a", False)
    with pytest.raises(ValueError, match="direction"):
        graph.oriented(edges, "sideways")


def test_made_files_are_read_by_many_tasks_and_once(spark, small, monkeypatch):
    from loam.plans import code

    monkeypatch.setattr(code, "FILES_A_TASK", 20)
    t = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    assert code.sources(t).rdd.getNumPartitions() == -(-t("documents").count() // 20)
    assert "MapInArrow" not in code.documentation_eligibility(t)._jdf.queryExecution().optimizedPlan().toString()


def test_components_are_sought_only_when_asked_for(spark, small, monkeypatch):
    from loam.plans import code

    asked = []
    monkeypatch.setattr(graph, "strong_components", lambda *a, **k: asked.append(1) or spark.createDataFrame([], "node string, component string, size long, cyclic boolean"))
    t = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    _, modules, imports = code.imports_of(t)
    g = project.import_graph(imports, modules)
    assert g["relations"].count() and g["metrics"].count() and not asked
    assert g["explanations"].count() == 0 and g["components"].count() == 0 and asked == [1]
    assert code.called(t)["coverage"].count() == 2 and asked == [1]


def test_chains_of_names_need_no_unparser(monkeypatch):
    seen, plain = [], pyfacts.ast.unparse
    monkeypatch.setattr(pyfacts.ast, "unparse", lambda n: seen.append(plain(n)) or plain(n))
    f = facts("import a\n@a.b\n@a.c(1)\ndef f():\n    a.b.c(x)\n    g()[0].h()\n")
    assert seen == ["a.c(1)", "g()[0].h"]
    assert [c["callee"] for c in f["calls"]] == ["a.c", "a.b.c", "g", "g()[0].h"] and f["symbols"][1]["decorators"] == ["a.b", "a.c(1)"]


def test_calls_know_their_owner_and_are_resolved_once(spark, small):
    from loam.plans import code

    f = facts("class K:\n    def m(self):\n        f()\n    g()\nh()\nlambda: i()\n")
    assert [(c["callee"], c["owner_kind"], c["owner_name"]) for c in f["calls"]] == [("f", "method", "K.m"), ("g", "class", "K"), ("h", "module", "m.py"), ("i", "lambda", "m.py.<lambda>@6:1")]
    g = code.called(lambda n: spark.read.parquet(f"{small}/{n}.parquet"))
    assert "Join" not in g["coverage"]._jdf.queryExecution().optimizedPlan().toString()
    outside = g["nodes"].where("kind <> 'local'").select("node", "label")
    assert not outside.isEmpty() and outside.where("not endswith(node, concat(':', label)) or label rlike '::'").isEmpty()


def test_relations_to_unknown_symbols_are_errors(spark):
    nodes = spark.createDataFrame([("a", "local"), ("b", "local"), ("x", "external")], "node string, kind string")
    edges = lambda *rows: spark.createDataFrame([(*r, "exact", 1) for r in rows] + [("q", "x", "external", 1)], "src string, dst string, kind string, weight long")
    assert project.validated(edges(("a", "b"), ("b", "a")), nodes).count() == 2
    for rows, text in ([("a", "b"), ("c", "b")], "source is unknown: c"), ([("a", "x")], "target is unknown: x"):
        with pytest.raises(project.GraphError, match=text):
            project.validated(edges(*rows), nodes)


def test_the_gate_needs_no_positions(spark, small, monkeypatch):
    from loam.operators import review
    from loam.plans import code

    monkeypatch.setattr(review, "with_position", lambda *a, **k: pytest.fail("positions were asked for"))
    assert code.policy_gate(lambda n: spark.read.parquet(f"{small}/{n}.parquet")).first()["status"] == "blocked"


def test_imports_meet_no_empty_table(spark, small):
    from loam.plans import code

    imports = code.imports_of(lambda n: spark.read.parquet(f"{small}/{n}.parquet"))[2]
    assert imports._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 3
