"""Registered queries over a repository made from the documents table, with their SQL.

Each document stands for one Python file, written from its id alone; so what the analysis must find in it
follows from the id, and the SQL states that without reading any Python.  Every eleventh file is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.lineage import cut
from loam.operators import graph, review
from loam.plans import project
from loam.plans.catalogue import query
from loam.sources import pyfacts, repo
from loam.sources.analyzers import REGISTRY
from loam.sources.policy import Policy

POLICY = Policy(review_at=4, block_at=6, documentation_below=80, exceptions=(("pkg0/mod5.py::function:f#1", 6), ("pkg4/mod4.py::function:f#1", None)))


def text_of(d: Column) -> Column:
    """The file of document ``d``."""
    n, ifs = d.cast("string"), (d % 6).cast("int")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    nxt = (d + 1).cast("string")
    steps = F.array_join(F.transform(F.when(ifs > 0, F.sequence(F.lit(1), ifs)).otherwise(F.array().cast("array<int>")), lambda k: line("    if x == ", k.cast("string"), ":\n        return ", k.cast("string"))), "")
    return F.concat(
        F.when(d % 2 == 0, line('"""Module ', n, '."""')).otherwise(line("# module ", n)),
        line("import os"), line("from pkg", ((d + 1) % 5).cast("string"), " import mod", nxt, " as nxt"), line("from . import gone", n), line(""),
        line("class C", n, ":"), F.when(d % 3 == 0, line('    """Class."""')).otherwise(line("    x = 1")),
        line("    def m(self, a, *, b=1):"), F.when(d % 4 == 0, line('        """Doc."""')).otherwise(line("        c = a")),
        line("        if a", F.repeat(F.lit(" and b"), (d % 5).cast("int")), ":"), line("            return nxt.f(a)"), line("        return self.n(b)"),
        line("    @staticmethod"), line("    def n(x):"), line("        return os.getcwd()"), line("def f(x):"), steps, line("    return C", n, "(x)"),
        F.when(d % 11 == 0, line("def broken(:\n    pass")).otherwise(""),
    )


#: Files that one task reads.  The ids alone are small, so that Spark would leave all of them to a task or two.
FILES_A_TASK = 1_000


def sources(t) -> DataFrame:
    d = F.col("doc_id")
    path = F.concat(F.lit("pkg"), (d % 5).cast("string"), F.lit("/mod"), d.cast("string"), F.lit(".py"))
    ids = t("documents").where("doc_id is not null").select("doc_id")
    tasks = max(1, -(-ids.count() // FILES_A_TASK))
    return ids.repartition(tasks, "doc_id").distinct().select(path.alias("path"), text_of(d).cast("binary").alias("bytes"))


def facts(t) -> DataFrame:
    return pyfacts.analyze(sources(t))


def made(t) -> project.Project:
    return project.of_sources(sources(t))


#: Files (d, path, module, bad: whether broken, last: the line of f's return) and symbols (kind, name, qualified, parent, line, end_line, doc, cc, nesting, params, caller) of the made repository.
FILES = """
files as (select doc_id as d, 'pkg' || doc_id % 5 || '/mod' || doc_id || '.py' as path, 'pkg' || doc_id % 5 || '.mod' || doc_id as module,
  doc_id % 11 = 0 as bad, (17 + 2 * (doc_id % 6))::bigint as last from (select distinct doc_id from documents where doc_id is not null))"""
SYMBOLS = f"""{FILES},
symbols as (
  select d, path, bad as partial, 'module' as kind, path as name, path as qualified_name, path || '::module' as id, null as parent_id, 1::bigint as line, last + case when bad then 2 else 0 end as end_line,
    case when bad then 'unavailable' when d % 2 = 0 then 'documented' else 'missing' end as documentation, null::bigint as decisions, null::bigint as nesting, null::bigint as declared, null::bigint as asked from files
  union all select d, path, false, 'class', 'C' || d, 'C' || d, path || '::class:C' || d || '#1', path || '::module', 6, 15, case when d % 3 = 0 then 'documented' else 'missing' end, null, null, null, null from files
  union all select d, path, false, 'method', 'm', 'C' || d || '.m', path || '::method:C' || d || '.m#1', path || '::class:C' || d || '#1', 8, 12, case when d % 4 = 0 then 'documented' else 'missing' end, 1 + d % 5, 1, 3, 2 from files
  union all select d, path, false, 'method', 'n', 'C' || d || '.n', path || '::method:C' || d || '.n#1', path || '::class:C' || d || '#1', 13, 15, 'missing', 0, 0, 1, 1 from files
  union all select d, path, false, 'function', 'f', 'f', path || '::function:f#1', path || '::module', 16, last, 'missing', d % 6, case when d % 6 > 0 then 1 else 0 end, 1, 1 from files
  union all select d, path, true, 'function', 'broken', 'broken', path || '::function:broken#1', path || '::module', last + 1, last + 1, 'unavailable', null, null, null, null from files where bad)"""
SCORES = f"{SYMBOLS}, scores as (select path, id as item, 1 + decisions as observed, d from symbols where kind in ('function', 'method'))"
STATES = f"{SYMBOLS}, states as (select *, case when documentation in ('documented', 'missing') then documentation else 'unavailable' end as state from symbols)"
EDGES = f"{FILES}, edges as (select a.d, a.path, a.module, 'python:' || a.module || '@' || a.path as src, b.d as next, 'python:' || b.module || '@' || b.path as dst from files a left join files b on b.d = a.d + 1)"


@query(f"with {FILES} select path, case when bad then 'partial' else 'successful' end as status, case when bad then 1 else 0 end as n_diagnostics, case when bad then 'parse-error' end as code, case when bad then last + 1 end as line from files")
def python_file_status(t):
    first = F.get("diagnostics", F.lit(0))
    return facts(t).select("path", "status", F.size("diagnostics").alias("n_diagnostics"), first["code"].alias("code"), first["line"].alias("line"))


@query(f"with {SYMBOLS} select path, id, parent_id, kind, name, qualified_name, partial, line, end_line, documentation from symbols")
def python_symbols(t):
    return pyfacts.table_of(facts(t), "symbols").select("path", "id", "parent_id", "kind", "name", "qualified_name", "partial", "line", "end_line", "documentation")


@query(f"""with {FILES} select path, 'm' as name, ['self', 'a', 'b'] as parameters, ['positional-or-keyword', 'positional-or-keyword', 'keyword-only'] as kinds, [false, false, true] as defaults, []::varchar[] as modifiers, []::varchar[] as decorators from files
union all select path, 'n', ['x'], ['positional-or-keyword'], [false], ['staticmethod'], ['staticmethod'] from files union all select path, 'f', ['x'], ['positional-or-keyword'], [false], [], [] from files""")
def python_parameters(t):
    each = lambda f: F.transform("parameters", lambda p: p[f])
    return pyfacts.table_of(facts(t), "symbols").where("kind in ('function', 'method') and not partial").select("path", "name", each("name").alias("parameters"), each("kind").alias("kinds"), each("has_default").alias("defaults"), "modifiers", "decorators")


@query(f"""with {FILES} select path, 'import' as kind, 'os' as module, null as imported, null as alias, 0 as level, 'module' as scope, 'runtime' as usage, 'required' as requirement, false as conditional, 2::bigint as line from files
union all select path, 'from', 'pkg' || (d + 1) % 5, 'mod' || d + 1, 'nxt', 0, 'module', 'runtime', 'required', false, 3 from files
union all select path, 'from', null, 'gone' || d, null, 1, 'module', 'runtime', 'required', false, 4 from files""")
def python_imports(t):
    return pyfacts.table_of(facts(t), "imports").select("path", "kind", "module", "imported", "alias", "level", "scope", "usage", "requirement", "conditional", "line")


CALLS = f"""{FILES}, calls as (
  select d, path, 'nxt.f' as callee, 'nxt.f' as components, path || '::method:C' || d || '.m#1' as enclosing, 1 as arguments, 11::bigint as line from files
  union all select d, path, 'self.n', 'self.n', path || '::method:C' || d || '.m#1', 1, 12 from files
  union all select d, path, 'os.getcwd', 'os.getcwd', path || '::method:C' || d || '.n#1', 0, 15 from files
  union all select d, path, 'C' || d, 'C' || d, path || '::function:f#1', 1, last from files)"""


@query(f"with {CALLS} select path, callee, components, enclosing, arguments, line from calls")
def python_calls(t):
    return pyfacts.table_of(facts(t), "calls").select("path", "callee", F.array_join("components", ".").alias("components"), "enclosing", F.col("positional").alias("arguments"), "line")


@query(f"""with {SYMBOLS}, c as (select * from symbols where kind in ('function', 'method'))
select path, id as symbol_id, metric, case when not partial then value end as value from (
  select path, id, partial, unnest(['physical-lines', 'declared-parameters', 'caller-parameters', 'max-nesting', 'decision-points', 'cyclomatic-complexity']) as metric,
    unnest([end_line - line + 1, declared, asked, nesting, decisions, 1 + decisions]) as value from c)""")
def python_measurements(t):
    return pyfacts.measurements(pyfacts.table_of(facts(t), "symbols"))


@query(f"with {STATES} select path, id, kind, state from states")
def documentation_eligibility(t):
    return project.eligible_symbols(pyfacts.table_of(cut(facts(t)), "symbols")).select("path", "id", "kind", "state")


@query(f"""with {STATES}, g as (select 'total' as grouping, null as key, state from states union all select 'kind', kind, state from states union all select 'path', path, state from states),
c as (select grouping, key, count(*) as eligible, count(*) filter (state = 'documented') as documented, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'unavailable') as unavailable from g group by all)
select *, documented * 10000 // nullif(documented + missing, 0) as basis_points, case when documented + missing > 0 and unavailable = 0 then documented * 100 >= (documented + missing) * 80 end as met from c""")
def documentation_report(t):
    return project.documentation(made(t)).select("grouping", "key", "eligible", "documented", "missing", "unavailable", "basis_points", "met")


BAND = "case when observed >= 21 then 'critical' when observed >= 11 then 'high' when observed >= 6 then 'moderate' else 'low' end"


@query(f"""with {SCORES}, excepted(item, most) as (values {", ".join(f"('{i}', {'null::bigint' if m is None else m})" for i, m in POLICY.exceptions)}),
marked as (select s.*, e.item is not null and (e.most is null or observed <= e.most) as fine from scores s left join excepted e using (item)),
found as (
  select 'complexity-threshold' as rule_id, item, observed, case when observed >= 6 and not fine then 6 else 4 end::bigint as threshold, 'score' as unit, {BAND} as risk,
    case when fine then 'none' when observed >= 6 then 'block' else 'human-review' end as action, fine as acknowledged, path from marked where observed >= 4
  union all select 'complexity-unavailable', item, null, null, 'score', 'unknown', 'human-review', false, path from scores where observed is null
  union all select 'analysis-incomplete', null, null, null, null, 'unknown', 'human-review', false, path from files where bad
  union all select 'documentation-coverage-unavailable', null, (select count(*) filter (documentation = 'documented') * 10000 // count(*) filter (documentation in ('documented', 'missing')) from symbols), 8000, 'basis-points', 'unknown', 'human-review', false, null
    where exists (select 1 from files where bad))
select *, row_number() over (order by case action when 'block' then 2 when 'human-review' then 1 else 0 end desc, case risk when 'unknown' then 4 when 'critical' then 3 when 'high' then 2 when 'moderate' then 1 else 0 end desc,
  path nulls first, item nulls first, rule_id) as position from found""")
def policy_findings(t):
    found = project.findings(made(t), POLICY)
    return found.select("rule_id", "item", "observed", "threshold", "unit", "risk", "action", "acknowledged", "path", "position")


@query("select 'blocked' as status, 3 as exit_code")
def policy_gate(t):
    return review.gate_status(project.unordered_findings(made(t), POLICY)).select("status", "exit_code")


@query(f"with {SYMBOLS} select (select count(*) from files) as selected_language_files, 0::bigint as unsupported_selected_files, (select count(*) from files) as analyzed_files, (select count(*) from files where not bad) as successful_files, (select count(*) from files where bad) as partial_files, 0::bigint as failed_files, count(*) as eligible_callables, count(*) filter (not partial) as measured_callables, count(*) filter (partial) as unavailable_callables from symbols where kind in ('function', 'method')")
def review_counters(t):
    return project.review_coverage(made(t))


@query(f"with {FILES} select 'python' as language, count(*) as analyzed, count(*) filter (not bad) as successful, count(*) filter (bad) as partial, 0::bigint as failed from files")
def analyzer_counters(t):
    return project.analyzer_counts(made(t))


@query(f"with {SYMBOLS} select count(*) filter (kind = 'module') as modules, count(*) filter (kind = 'class') as classes, count(*) filter (kind = 'function') as functions, count(*) filter (kind = 'method') as methods, 0::bigint as lambdas, 3 * count(*) filter (kind = 'module') as imports from symbols")
def symbol_counters(t):
    return project.symbol_kinds(made(t))


@query("select 0::bigint as type_only, 0::bigint as optional, 0::bigint as callable_local, 0::bigint as conditional")
def import_context_counters(t):
    return project.import_contexts(pyfacts.table_of(facts(t), "imports"))


@query("select 'python-ast' as id, 'python' as language, 'syntax' as level, 'calls,dependencies,documentation,measurements,symbols,syntax' as capabilities")
def analyzer_descriptors(t):
    return REGISTRY.descriptors(t("region").sparkSession).select("id", "language", "level", F.array_join("capabilities", ",").alias("capabilities"))


def imports_of(t) -> tuple[project.Project, DataFrame, DataFrame]:
    p = made(t)
    modules = project.local_modules(p, [""])
    # Plans without data of their own: nothing is sent to the executors, and an empty table's join falls away.
    one, text = p.facts.sparkSession.range(1), F.lit(None).cast("string")
    stdlib = one.select(F.lit("os").alias("name"))
    providers = one.where(F.lit(False)).select(text.alias("import_name"), text.alias("distribution"), text.alias("version"))
    return p, modules, project.resolved_imports(p, modules, stdlib, providers)


@query(f"with {FILES} select path, module, false as is_package, 'python:' || module || '@' || path as identity from files")
def local_modules(t):
    return project.local_modules(made(t), [""]).select("path", "module", "is_package", "identity")


@query(f"""with {EDGES} select path, line, kind, origin, target, reason from (
  select path, 2::bigint as line, 'exact' as kind, 'standard-library' as origin, 'python:stdlib:os' as target, null as reason from edges
  union all select path, 3, case when next is null then 'unresolved' else 'exact' end, case when next is not null then 'local' end, dst, case when next is null then 'module-not-found' end from edges
  union all select path, 4, 'unresolved', null, null, 'module-not-found' from edges)""")
def import_resolution(t):
    return imports_of(t)[2].select("path", "line", "kind", "origin", "target", "reason")


@query(f"""with {EDGES} select src, dst, kind, lines from (
  select src, 'python:stdlib:os' as dst, 'exact' as kind, '2' as lines from edges
  union all select src, case when next is null then 'python:unresolved:' || src || ':pkg' || (d + 1) % 5 || ':module-not-found' else dst end, case when next is null then 'unresolved' else 'exact' end, '3' from edges
  union all select src, 'python:unresolved:' || src || ':pkg' || d % 5 || ':module-not-found', 'unresolved', '4' from edges)""")
def import_relations(t):
    _, modules, imports = imports_of(t)
    g = project.import_graph(imports, modules)
    return g["relations"].select("src", "dst", "kind", F.array_join(F.transform("evidence", lambda e: e["line"].cast("string")), ",").alias("lines"))


@query(f"""with {EDGES}, m as (select src as node, 0 as i, 1 + (next is not null)::int as o from edges union all select dst, 1, 0 from edges where next is not null union all select 'python:stdlib:os', count(*), 0 from edges),
n as (select 'python:unresolved:' || src || ':pkg' || d % 5 || ':module-not-found' as node from edges union select 'python:unresolved:' || src || ':pkg' || (d + 1) % 5 || ':module-not-found' from edges where next is null)
select node, sum(i)::bigint as fan_in, sum(o)::bigint as fan_out from m group by node union all select node, 0, 0 from n""")
def import_fan_metrics(t):
    _, modules, imports = imports_of(t)
    return project.import_graph(imports, modules)["metrics"]


def called(t) -> dict[str, DataFrame]:
    p, modules, imports = imports_of(t)
    return project.call_graph(project.resolved_calls(p, modules, imports), p, modules)


CALLED = f"""{CALLS}, ends as (
  select c.path || '::' || c.enclosing as src, c.line, c.callee,
    case when callee = 'nxt.f' and b.d is not null then b.path || '::' || b.path || '::function:f#1' when callee = 'self.n' then c.path || '::' || c.path || '::method:C' || c.d || '.n#1'
      when callee = 'C' || c.d then c.path || '::' || c.path || '::class:C' || c.d || '#1' end as dst
  from calls c left join files b on b.d = c.d + 1),
relations as (select src, coalesce(dst, 'call:external:' || src || ':' || callee) as dst, case when dst is null then 'external' else 'exact' end as kind, line from ends)"""


@query(f"with {CALLED} select src, dst, kind, 1::bigint as weight, line from relations")
def call_relations(t):
    return called(t)["relations"].select("src", "dst", "kind", "weight", F.col("evidence")[0]["line"].alias("line"))


@query(f"""with {CALLED}, {SYMBOLS.replace(FILES + ",", "", 1)}, n as (
  select path || '::' || id as node, 'local' as kind, module || case when kind = 'module' then '' else '::' || qualified_name end as label from symbols join (select path, module from files) using (path)
  union select dst, 'external', callee from (select coalesce(dst, 'call:external:' || src || ':' || callee) as dst, callee, dst is null as out from ends) where out)
select node, kind, label, printf('c%04d', (row_number() over (order by kind <> 'local', node) - 1)::int) as id from n""")
def call_graph_nodes(t):
    return called(t)["nodes"].select("node", "kind", "label", "id")


@query(f"with {CALLED} select kind, count(*) as n from relations group by kind")
def call_coverage(t):
    return called(t)["coverage"]


@query(f"""with {CALLED}, first as (select min(d) as d from files), roots as (select path || '::' || path || '::method:C' || d || '.m#1' as node from files where d = (select d from first)),
walk as (select 1 as step, node, node as src, null as dst from roots)
select 1::bigint as step, r.node as src, e.dst from roots r join relations e on e.src = r.node and e.kind = 'exact' and e.dst like '%function:f#1'
union all select 2, e.src, e.dst from roots r join relations a on a.src = r.node and a.dst like '%function:f#1' join relations e on e.src = a.dst and e.kind = 'exact'""")
def call_path(t):
    """The calls along the path from the first file's method to the class that the next file's function makes."""
    g = called(t)
    first = t("documents").agg(F.min("doc_id").alias("d")).first()["d"]
    at = lambda d, what: f"pkg{d % 5}/mod{d}.py::pkg{d % 5}/mod{d}.py::{what}#1"
    of = lambda node: g["nodes"].where(F.col("node") == node).select("node")
    _, steps = project.path_between(g, of(at(first, f"method:C{first}.m")), of(at(first + 1, f"class:C{first + 1}")))
    return steps.select(F.col("step").cast("long").alias("step"), "src", "dst")


@query(f"""with {CALLED}, roots as (select path || '::' || path || '::function:f#1' as node from files where d % 100 = 7)
select node from roots union select e.src from relations e join roots r on e.dst = r.node and e.kind = 'exact'""")
def call_closure(t):
    """All that leads, by calls, to the functions of every hundredth file."""
    g = called(t)
    roots = g["nodes"].where((F.col("kind") == "local") & F.col("node").rlike("/mod[0-9]*07[.]py::function:f#1$")).select("node").unionByName(g["nodes"].where(F.col("node").rlike("/mod7[.]py::function:f#1$")).select("node")).distinct()
    return project.closure_view(g, roots, "dependents")["nodes"].select("node")


IGNORE = [("", "*.csv\n/src1/de/\nbuild/\n!keep.csv\n"), ("src0", "*.md\n!doc2*.md\n"), ("src0/en", "!*.csv\n")]


def listing(t) -> DataFrame:
    """Paths with folders that rules and built-in names leave out."""
    d = F.col("doc_id")
    ends = F.element_at(F.array(*map(F.lit, (".py", ".md", ".csv", ".rs"))), (d % 4 + 1).cast("int"))
    folder = F.when(d % 13 == 0, "build/").when(d % 17 == 0, "target/").otherwise("")
    return t("documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.lit("doc"), d.cast("string"), ends).alias("path"))


LISTED = """
p as (select source || '/' || lang || '/' as dir, source, lang, doc_id as d, case when doc_id % 13 = 0 then 'build' when doc_id % 17 = 0 then 'target' else '' end as folder, (array['py', 'md', 'csv', 'rs'])[doc_id % 4 + 1] as ext from documents),
q as (select *, dir || case when folder = '' then '' else folder || '/' end || 'doc' || d || '.' || ext as path,
  case when source = 'src1' and lang = 'de' then 'gone' when folder = 'target' then 'built-in' when folder = 'build' then 'built'
    when ext = 'csv' and not (source = 'src0' and lang = 'en') then 'file' when ext = 'md' and source = 'src0' and not starts_with(d::varchar, '2') then 'file' end as why from p)"""


@query(f"""with {LISTED}
select distinct case why when 'gone' then 'src1/de' when 'built-in' then dir || 'target' when 'built' then dir || 'build' else path end as path,
  case why when 'gone' then 'directory' when 'built-in' then 'builtin_directory' when 'built' then 'directory' else 'file' end as entry, case when why is null then 'standard' else 'ignored' end as state from q""")
def scan_states(t):
    """A listing under nested ignore rules: what is scanned, and where what isn't begins."""
    return repo.states(listing(t), IGNORE)


@query(f"""with {LISTED}
select path, 'file' as entry, case when why is null then 'standard' when why <> 'built-in' and ext = 'py' then 'included' else 'ignored' end as state from q where why is null or folder <> 'target'
union select 'src1/de', 'directory', 'ignored' from q where why = 'gone'
union select dir || 'build', 'directory', 'ignored' from q where folder = 'build'
union select dir || 'target', 'builtin_directory', 'ignored' from q where folder = 'target'""")
def scan_audit(t):
    """The same listing with all that is ignored in full, and Python files let back in."""
    return repo.states(listing(t), IGNORE, ["*.py"], exact=True)
