"""A repository from its files to findings, import graph and call graph, all as DataFrames."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import scalars as S
from loam.lineage import cut
from loam.operators import coverage, cycles, graph, inventory, resolve, review
from loam.sources import analyzers, lines, pyfacts, repo
from loam.sources.policy import Policy
from loam.sources.rules import DEFAULT_RULES, Rule


class GraphError(ValueError):
    """A graph whose relations don't fit its nodes."""


@dataclass
class Project:
    """Tables of one repository; ``chosen`` are the files that the selection kept and ``facts`` the nested facts of the Python files among them."""

    entries: DataFrame
    files: DataFrame
    chosen: DataFrame
    facts: DataFrame

    def table(self, kind: str) -> DataFrame:
        return pyfacts.table_of(self.facts, kind)


class Tables(dict):
    """Tables by name; one given as a function is made when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if callable(found):
            found = self[name] = found()
        return found


def classified(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Files with category and language; a file that two categories claim with equal rank is an error."""
    out = cut(inventory.classify(files, inventory.rules_frame(files.sparkSession, rules or DEFAULT_RULES)).withColumn("language", S.language_of(F.col("path"))))
    if (clash := out.where("conflict").select("path").first()) is not None:
        raise ValueError(f"two categories claim {clash['path']} with equal rank")
    return out


def load(spark: SparkSession, root: str, rules: list[Rule] | None = None, include: list[str] | None = None, match: list[str] | None = None, exact: bool = False) -> Project:
    """Scan, classify and read a repository, or one file of it.  ``match`` keeps the files that fully match one of its patterns."""
    if Path(root).is_file():
        if match or include:
            raise ValueError("a single file takes neither --match nor --include-ignored")
        entries = cut(repo.single(spark, root))
        language = entries.select(S.language_of(F.col("path")).alias("language")).first()["language"]
        analyzers.REGISTRY.of(language, root)
    else:
        entries = cut(repo.inventory(spark, root, include, exact))
    files = classified(repo.files_of(entries), rules)
    chosen = files
    if match:
        hit = F.lit(False)
        for p in match:
            hit = hit | S.full_match(F.col("path"), p)
        chosen = cut(files.where(hit))
        if chosen.isEmpty():
            raise ValueError(f"no file matches {', '.join(match)}")
    facts = cut(analyzers.REGISTRY.analyze(repo.with_bytes, chosen))
    return Project(entries, files, chosen, facts)


def of_sources(sources: DataFrame, rules: list[Rule] | None = None) -> Project:
    """A project from a table of (path, bytes) instead of a folder."""
    files = classified(sources.select("path"), rules)
    facts = cut(pyfacts.analyze(sources.where(S.language_of(F.col("path")) == "python")))
    return Project(files.select("path", F.lit("file").alias("entry"), F.lit("standard").alias("state")), files, files, facts)


def line_totals(project: Project) -> DataFrame:
    """Physical lines of the selected files by language and over all (language null)."""
    content = repo.with_bytes(project.chosen.where("language is not null")).withColumn("language", S.language_of(F.col("path")))
    kinds = ("total", "source", "comment", "blank")
    return lines.line_counts(content).rollup("language").agg(F.count("*").alias("files"), *[F.sum(k).alias(k) for k in kinds])


def analyzer_counts(project: Project) -> DataFrame:
    """One row for each analyzer that ran: files analyzed, successful, partial and failed."""
    status = F.col("status")
    return project.facts.groupBy(F.lit("python").alias("language")).agg(F.count("*").alias("analyzed"), *[F.count_if(status == x).alias(x) for x in ("successful", "partial", "failed")])


def review_coverage(project: Project) -> DataFrame:
    """One row: files by how far they could be reviewed, and callables with and without a score."""
    known = F.col("language").isNotNull()
    files = project.chosen.agg(F.count_if(known).alias("selected_language_files"), F.count_if(known & (F.col("language") != "python")).alias("unsupported_selected_files"))
    status = project.facts.agg(F.count("*").alias("analyzed_files"), *[F.count_if(F.col("status") == x).alias(f"{x}_files") for x in ("successful", "partial", "failed")])
    scores = pyfacts.measurements(project.table("symbols")).where("metric = 'cyclomatic-complexity'")
    calls = scores.agg(F.count("*").alias("eligible_callables"), F.count("value").alias("measured_callables"), F.count_if(F.col("value").isNull()).alias("unavailable_callables"))
    # Three rows of one row each.
    return files.join(status, F.lit(True)).join(calls, F.lit(True))


def symbol_kinds(project: Project) -> DataFrame:
    """One row: symbols of each kind, and imports."""
    one = project.table("symbols").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("module", "modules"), ("class", "classes"), ("function", "functions"), ("method", "methods"), ("lambda", "lambdas"))])
    return one.join(project.table("imports").agg(F.count("*").alias("imports")), F.lit(True))


def import_contexts(imports: DataFrame) -> DataFrame:
    """One row: imports that are type-only, optional, local to a callable and conditional."""
    return imports.agg(*[F.count_if(F.expr(test)).alias(name.replace("-", "_")) for name, test in EXCLUSIONS.items()])


def excerpts(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``spans`` (path, line, end_line, ...) with ``source``, the text of those lines, both ends included; null where the file isn't among ``files`` (path, bytes)."""
    text = files.select("path", F.split(F.decode("bytes", "UTF-8"), "\n").alias("__lines__"))
    cut_out = F.array_join(F.slice("__lines__", F.greatest(F.col("line"), F.lit(1)).cast("int"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0)).cast("int")), "\n")
    return spans.join(text, "path", "left").withColumn("source", cut_out).drop("__lines__")


def eligible_symbols(symbols: DataFrame, tests: bool = False) -> DataFrame:
    """Symbols that documentation is expected of: modules, their direct classes and functions, direct methods of these; overload groups once."""
    up = symbols.select(F.col("path").alias("p"), F.col("id").alias("pid"), F.col("kind").alias("parent_kind"), F.col("direct").alias("parent_direct"), F.col("parent_id").alias("above"))
    modules = symbols.where("kind = 'module'").select(F.col("path").alias("mp"), F.col("id").alias("mid"))
    s = symbols.join(up, (symbols["path"] == up["p"]) & (symbols["parent_id"] == up["pid"]), "left").join(modules, (symbols["path"] == F.col("mp")) & (F.col("above") == F.col("mid")), "left")
    of_module = F.col("kind").isin("class", "function") & F.col("direct") & (F.col("parent_kind") == "module")
    of_class = (F.col("kind") == "method") & F.col("direct") & (F.col("parent_kind") == "class") & F.col("parent_direct") & F.col("mid").isNotNull()
    s = s.where((F.col("kind") == "module") | of_module | of_class).select(symbols.columns)
    if not tests:
        s = s.where(~S.is_test_path(F.col("path")))
    state = F.when(F.col("documentation") == "documented", "documented").when(F.col("documentation").startswith("missing"), "missing").otherwise("unavailable")
    s = s.withColumn("state", state)
    return coverage.collapse_groups(s, ["path", "parent_id", "kind", "qualified_name"], F.exists("decorators", S.is_overload), F.col("state"), F.col("start_byte"))


def documentation(project: Project, tests: bool = False, percent: int = 80) -> DataFrame:
    return coverage.coverage(eligible_symbols(project.table("symbols"), tests), F.col("state"), "kind", "path", percent=percent)


def findings(project: Project, policy: Policy = Policy(), documented: bool = True, tests: bool = False) -> DataFrame:
    """All findings of a policy over the selected files, with path; in the order of the gate.  ``tests``: documentation is asked of tests too."""
    order = review.finding_order()
    return review.with_position(unordered_findings(project, policy, documented, tests), *order[:2], F.col("path").asc_nulls_first(), *order[2:])


def unordered_findings(project: Project, policy: Policy = Policy(), documented: bool = True, tests: bool = False) -> DataFrame:
    """The findings without their positions, all that the gate asks for."""
    spark = project.facts.sparkSession
    if policy.documentation_below is not None and not documented:
        raise ValueError("a documentation threshold needs documentation facts")
    measured = pyfacts.measurements(project.table("symbols")).where("metric = 'cyclomatic-complexity'")
    allowed = spark.createDataFrame([(s, k, m) for k, (s, m) in enumerate(policy.exceptions)], "item string, line long, approved_max long") if policy.exceptions else None
    found = review.findings(measured, "symbol_id", "value", policy.review_at, policy.block_at, allowed, policy.named_bands).withColumn("path", F.split_part("item", F.lit("::"), F.lit(1)))
    open_row = [F.lit(None).cast("long").alias("observed"), F.lit(None).cast("long").alias("threshold"), F.lit(None).cast("string").alias("unit"), F.lit("unknown").alias("risk"), F.lit("human-review").alias("action"), F.lit(False).alias("acknowledged")]
    partial = project.facts.where("status <> 'successful'").select(F.lit("analysis-incomplete").alias("rule_id"), F.lit(None).cast("string").alias("item"), *open_row, "path")
    known = project.chosen.agg(F.count("language").alias("known"), F.count_if(F.col("language").isNotNull() & (F.col("language") != "python")).alias("other"))
    whole = known.where("known = 0 or other > 0").select(F.lit("analysis-incomplete").alias("rule_id"), F.lit(None).cast("string").alias("item"), *open_row, F.lit(None).cast("string").alias("path"))
    out = found.unionByName(partial).unionByName(whole)
    if policy.documentation_below is not None:
        total = documentation(project, tests, policy.documentation_below).where("grouping = 'total'")
        # A partial file leaves the threshold undecided.
        bad = project.facts.agg(F.count_if(F.col("status") != "successful").alias("bad"))
        total = spark.range(1).join(total, F.lit(True), "left").crossJoin(bad)
        decided = F.when(F.col("bad") == 0, F.col("met"))
        rule = F.when(decided.isNull(), "documentation-coverage-unavailable").otherwise("documentation-coverage-below-threshold")
        row = total.where(F.coalesce(~decided, F.lit(True))).select(rule.alias("rule_id"), F.lit(None).cast("string").alias("item"), F.col("basis_points").alias("observed"), F.lit(policy.documentation_below * 100).cast("long").alias("threshold"), F.lit("basis-points").alias("unit"), *open_row[3:], F.lit(None).cast("string").alias("path"))
        out = out.unionByName(row)
    return out


def package_roots(root: str) -> list[str]:
    """Folders that hold packages, deepest first: those that pyproject.toml names, else src, else the root."""
    named: list[str] = []
    file = Path(root, "pyproject.toml")
    if file.is_file():
        tool = tomllib.loads(file.read_text()).get("tool", {})
        setup = tool.get("setuptools", {})
        package_dir = setup.get("package-dir", {})
        if isinstance(package_dir, dict) and isinstance(package_dir.get(""), str):
            named.append(package_dir[""])
        packages = setup.get("packages", {})
        where = packages.get("find", {}).get("where", []) if isinstance(packages, dict) else []
        named += [where] if isinstance(where, str) else where
        named += [p["from"] for p in tool.get("poetry", {}).get("packages", []) if isinstance(p.get("from"), str)]
    named = named or (["src"] if Path(root, "src").is_dir() else ["."])
    sound = {str(PurePosixPath(n)) for n in named if not n.startswith("/") and ".." not in PurePosixPath(n).parts}
    kept = [n for n in sound if Path(root, n).is_dir()]
    return sorted(("" if n == "." else n for n in kept), key=lambda n: (-len(PurePosixPath(n).parts), n)) or [""]


def local_modules(project: Project, roots: list[str]) -> DataFrame:
    """(path, module, is_package, identity) of the Python files whose path makes a module name."""
    p = F.col("path")
    name = F.coalesce(*[F.when(p.startswith(r + "/"), S.module_name(p, (r,))) if r else S.module_name(p, ()) for r in roots])
    found = project.files.where("language = 'python'").select("path", name.alias("module"), p.endswith("__init__.py").alias("is_package")).where("module is not null")
    return found.withColumn("identity", S.identity(F.lit("local"), F.lit("python"), F.col("module"), p))


EXCLUSIONS = {"type-only": "usage = 'type-only'", "optional": "requirement = 'optional'", "callable-local": "scope = 'callable'", "conditional": "conditional"}


def resolved_imports(project: Project, modules: DataFrame, stdlib: DataFrame | None = None, providers: DataFrame | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Imports of local modules with their outcome; ``without`` leaves out kinds of import before anything is counted."""
    imports = project.table("imports").join(modules.select("path", F.col("module").alias("source_module"), "is_package", F.col("identity").alias("source")), "path")
    for name in without:
        imports = imports.where(f"not ({EXCLUSIONS[name]})")
    depth = F.size(F.split("source_module", "[.]")) - F.when(F.col("is_package"), 0).otherwise(1)
    wanted = S.requested_module(F.col("source_module"), F.col("is_package"), F.col("level"), F.col("module"))
    problem = F.when((F.col("level") > 0) & wanted.isNull(), F.when((depth <= 0) & (F.col("level") == 1), "missing-package-context").otherwise("relative-import-beyond-root"))
    imports = imports.withColumns({"requested": wanted, "problem": problem})
    return resolve.resolve_imports(imports, modules, stdlib, providers)


def import_graph(resolved: DataFrame, modules: DataFrame) -> Tables:
    """nodes, relations, metrics, components, explanations and coverage of an import graph.  Components are sought when asked for."""
    ambiguous = F.concat(F.lit("python:ambiguous:"), "source", F.lit(":"), "requested")
    unresolved = F.concat(F.lit("python:unresolved:"), "source", F.lit(":"), F.coalesce("requested", S.reference_text(F.col("level"), F.col("module"), F.col("imported"))), F.lit(":"), "reason")
    dst = F.when(F.col("kind") == "exact", F.col("target")).when(F.col("kind") == "ambiguous", ambiguous).otherwise(unresolved)
    edges = cut(graph.relations(resolved.select(F.col("source").alias("src"), dst.alias("dst"), "kind", "path", "start_byte", "line"), "src", "dst", "kind", "path", "start_byte", "line"))
    nodes = cut(modules.select(F.col("identity").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    exact = edges.where("kind = 'exact'").select("src", "dst", F.size("evidence").cast("long").alias("weight"))
    local = exact.join(modules.select(F.col("identity").alias("dst")), "dst", "left_semi")
    nodes = nodes.withColumn("kind", F.coalesce(F.nullif(F.regexp_extract("node", "^python:(ambiguous|unresolved|stdlib|distribution):", 1), F.lit("")), F.lit("local")))
    unknown = exact.join(nodes.where("kind in ('local', 'stdlib', 'distribution')").select(F.col("node").alias("dst")), "dst", "left_anti").unionByName(local.join(modules.select(F.col("identity").alias("src")), "src", "left_anti").select("dst", "src", "weight"), allowMissingColumns=True)
    if (lost := unknown.first()) is not None:
        raise GraphError(f"an exact relation's end is unknown: {lost['src']} -> {lost['dst']}")
    made = Tables()
    made |= {
        "nodes": lambda: graph.stable_ids(nodes, F.col("node")), "relations": edges, "metrics": graph.fan_metrics(nodes, exact),
        "components": lambda: cut(graph.strong_components(modules.select(F.col("identity").alias("node")), local)),
        "explanations": lambda: cycles.explain_cycles(made["components"], local), "coverage": resolve.outcome_counts(resolved), "local": local,
    }
    return made


def resolved_calls(project: Project, modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with their outcome: exact, ambiguous, external or unresolved.

    One name is looked up as an import of the file, then among the enclosing scopes outwards, then in the
    module; self and cls look in the method's class; other chains follow the import of their first name.
    Incomplete chains stay unresolved.
    """
    symbols = project.table("symbols").join(modules.select("path", F.col("module").alias("owner_module")), "path")
    names = symbols.where("kind <> 'module'").select(F.concat_ws("::", "owner_module", "qualified_name").alias("name"), F.concat_ws("::", "path", "id").alias("symbol"))
    bindings = imports.withColumn("bound", F.coalesce("alias", "imported", F.split("module", "[.]")[0]))
    bindings = resolve.last_binding(bindings, "path", "bound", "start_byte").select(
        "path", "bound", F.col("kind").alias("bind_kind"), F.col("origin").alias("bind_origin"), F.col("requested").alias("bind_module"), F.col("imported").alias("bind_name"), F.col("target").alias("bind_target")
    )
    calls = project.table("calls").join(modules.select("path", F.col("module").alias("owner_module")), "path")
    calls = calls.withColumn("call_id", F.concat_ws(":", "path", F.col("start_byte").cast("string"), "callee"))
    calls = calls.withColumn("first", F.get("components", F.lit(0))).join(bindings.withColumnRenamed("bound", "first"), ["path", "first"], "left")
    n, rest = F.size("components"), F.array_join(F.slice("components", 2, 1 << 20), ".")
    scopes = F.split("owner_name", "[.]")
    depth = F.when(F.col("owner_kind") == "module", F.lit(0)).otherwise(F.size(scopes))
    at = lambda q: F.concat_ws("::", F.col("owner_module"), q)
    outward = F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda k: at(F.concat_ws(".", F.array_join(F.slice(scopes, F.lit(1), k), "."), F.col("first"))))).otherwise(F.array().cast("array<string>"))
    itself = F.when(F.element_at(scopes, -1) == F.col("first"), F.array(at(F.col("owner_name")))).otherwise(F.array().cast("array<string>"))
    own_class = F.when(F.col("owner_kind") == "class", F.col("owner_name")).when(F.col("owner_kind") == "method", F.array_join(F.slice(scopes, F.lit(1), F.size(scopes) - 1), "."))
    imported_module = F.array(F.concat_ws("::", "bind_module", rest))
    imported_symbol = F.array(F.concat_ws("::", "bind_module", F.concat_ws(".", "bind_name", F.when(n > 1, rest))), F.concat_ws("::", F.concat_ws(".", "bind_module", "bind_name"), F.when(n > 1, rest)))
    candidates = (
        F.when(n == 0, F.array().cast("array<string>"))
        .when((n > 1) & F.col("first").isin("self", "cls") & own_class.isNotNull(), F.array(at(F.concat_ws(".", own_class, rest))))
        .when(F.col("bind_kind").isNotNull(), F.when(F.col("bind_name").isNull(), imported_module).otherwise(imported_symbol))
        .when(n == 1, F.concat(itself, outward, F.array(at(F.col("first")))))
        .otherwise(F.array().cast("array<string>"))
    )
    found = resolve.by_priority(calls, ["call_id"], candidates, names, "name", "symbol")
    external = (F.col("kind") == "unresolved") & F.col("bind_origin").isin("standard-library", "distribution") | (F.col("kind") == "unresolved") & (F.col("bind_kind") == "unresolved")
    return found.withColumn("kind", F.when(external, "external").otherwise(F.col("kind")))


def symbol_selectors(symbols: DataFrame) -> DataFrame:
    """Append selector, ``module::name``, ordinal (1, 2, ... by place among symbols of one selector) and full, ``module::name#ordinal``, to symbols with their owner_module."""
    same = Window.partitionBy("selector")
    named = symbols.withColumn("selector", F.concat_ws("::", "owner_module", F.when(F.col("kind") != "module", F.col("qualified_name"))))
    return named.withColumn("ordinal", F.row_number().over(same.orderBy("path", "start_byte", "id"))).withColumn("full", F.concat("selector", F.lit("#"), "ordinal"))


def call_graph(resolved: DataFrame, project: Project, modules: DataFrame) -> Tables:
    """nodes, relations, metrics, components and coverage of all calls.

    Nodes are the project's symbols and, for each calling symbol, what it calls outside, ambiguously or
    unknown.  A relation holds its calls in order.  Metrics and components look at exact calls only; components are sought when asked for.
    """
    symbols = symbol_selectors(project.table("symbols").join(modules.select("path", F.col("module").alias("owner_module")), "path"))
    local = symbols.select(F.concat_ws("::", "path", "id").alias("node"), F.lit("local").alias("kind"), F.when(F.count("*").over(Window.partitionBy("selector")) > 1, F.col("full")).otherwise(F.col("selector")).alias("label"), "selector", "full")
    src = F.concat_ws("::", "path", "enclosing")
    dst = F.when(F.col("kind") == "exact", F.col("target")).otherwise(F.concat_ws(":", F.lit("call"), "kind", src, "callee"))
    calls = resolved.select(src.alias("src"), dst.alias("dst"), "kind", "path", "start_byte", "line")
    relations = cut(graph.relations(calls, "src", "dst", "kind", "path", "start_byte", "line").withColumn("weight", F.size("evidence").cast("long")))
    # Calls are resolved once, for the relations: what a name of dst ends in is the callee, and dst, kind and label tell src.
    callee = F.expr("substring(dst, length('call') + length(kind) + length(src) + 4)")
    named = relations.where("kind <> 'exact'").select(F.col("dst").alias("node"), "kind", callee.alias("label"), F.lit(None).cast("string").alias("selector"), F.lit(None).cast("string").alias("full"))
    nodes = cut(local.unionByName(named))
    exact = validated(relations, nodes)
    ids = nodes.where("kind = 'local'").select("node")
    return Tables({
        "nodes": lambda: graph.stable_ids(nodes, F.col("kind") != "local", F.col("node"), letter="c"), "relations": relations, "local": exact, "metrics": graph.fan_metrics(ids, exact),
        "components": lambda: cut(graph.strong_components(ids, exact)), "coverage": relations.groupBy("kind").agg(F.sum("weight").alias("n")),
    })


def validated(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The exact relations as edges; one whose source or target is no local node is an error."""
    local = nodes.where("kind = 'local'").select("node")
    exact = relations.where("kind = 'exact'").select("src", "dst", "weight")
    ends = exact.select(F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("src").alias("node")), F.struct(F.lit("target").alias("end"), F.col("dst").alias("node")))).alias("e")).select("e.*")
    if (lost := ends.join(local, "node", "left_anti").agg(F.min(F.struct("end", "node")).alias("e")).first()["e"]) is not None:
        raise GraphError(f"an exact relation's {lost['end']} is unknown: {lost['node']}")
    return exact


def unmatched_owners(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls whose enclosing symbol the file doesn't hold, as diagnostics (path, line, code)."""
    known = symbols.select("path", F.col("id").alias("enclosing"))
    return calls.join(known, ["path", "enclosing"], "left_anti").select("path", "line", F.lit("call-owner-unknown").alias("code"))


def selected(nodes: DataFrame, wanted: str) -> DataFrame:
    """The call node that ``module::name`` or ``module::name#ordinal`` names.

    A name without its ordinal that several symbols have, and one that none has, are errors.
    """
    hit = nodes.where((F.col("full") == wanted) | (F.col("selector") == wanted))
    n = hit.limit(2).count()
    if n > 1 and "#" not in wanted:
        raise ValueError(f"symbol {wanted!r} has duplicate definitions; select one with #N")
    if n == 0:
        near = graph.suggestions(nodes.sparkSession.createDataFrame([(wanted,)], "request string"), nodes.where("selector is not null").select(F.col("selector").alias("name")))
        raise ValueError(f"symbol {wanted!r} was not found; nearest: " + ", ".join(r["name"] for r in near.orderBy("position").collect()))
    return hit.select("node")


def walk_relations(walks: DataFrame, relations: DataFrame, path: str = "path") -> DataFrame:
    """(step, relation's columns) of every edge along the node lists of ``path``, in order of step from 1."""
    p = F.col(path)
    steps = walks.where(F.size(p) > 1).select(F.posexplode(F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("src"), F.slice(p, F.lit(2), F.size(p)).alias("dst"))).alias("at", "e"))
    return steps.select((F.col("at") + 1).alias("step"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).join(relations.where("kind = 'exact'"), ["src", "dst"])


def path_between(g: dict[str, DataFrame], source: DataFrame, target: DataFrame) -> tuple[list, DataFrame]:
    """The least of the shortest paths over exact local relations (empty if there is none), and its relations."""
    found = graph.shortest_paths(g["local"], source, target).orderBy(F.size("path"), "path").limit(1)
    found = cut(found)
    row = found.first()
    return list(row["path"]) if row else [], walk_relations(found, g["relations"])


def closure_view(g: dict[str, DataFrame], root: DataFrame, direction: str | None = None) -> dict[str, DataFrame]:
    """Nodes of a closure, with their ids in the whole graph, the exact relations between them and the cyclic components that lie within."""
    if direction == "both":
        raise ValueError("a closure follows dependencies or dependents, not both")
    inside = cut(graph.closure_of(g["local"], root, direction or "dependencies"))

    def within() -> DataFrame:
        cyclic = g["components"].where("cyclic")
        whole = cyclic.join(inside.withColumn("in", F.lit(True)), "node", "left").groupBy("component").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("all")).where("all")
        return cyclic.join(whole, "component", "left_semi")

    return Tables({"nodes": g["nodes"].join(inside, "node", "left_semi"), "relations": graph.view(g["relations"].where("kind = 'exact'"), inside), "components": within})


def fan_ranking(metrics: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The ``n`` nodes of most ``by`` (fan_in or fan_out), ties by name."""
    return review.top(metrics.where(F.col(by) > 0), n, F.col(by).desc(), F.col("node"))
