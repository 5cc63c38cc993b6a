"""Command line: inventory, analyze, comments, dependencies and calls over one repository."""

from __future__ import annotations

import argparse
import sys
import webbrowser
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loam import ready
from loam.lineage import cut
from loam.operators import inventory, review
from loam.plans import project, render
from loam.sources import environment, pyfacts, repo
from loam.sources.policy import from_json, with_options
from loam.sources.rules import layered


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("a positive integer is needed")
    return int(text)


def _percent(text: str) -> int:
    if not text.isdigit() or not 1 <= int(text) <= 100:
        raise argparse.ArgumentTypeError("a percentage between 1 and 100 is needed")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loam")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("path")
    common.add_argument("--config", action="append", default=[])
    common.add_argument("--include-ignored", action="append", default=[])
    common.add_argument("--match", action="append", default=[])
    common.add_argument("--format", default="json", choices=["json", "text", "mermaid", "dot", "html"])
    common.add_argument("--output")
    common.add_argument("--open", action="store_true")
    common.add_argument("--no-warnings", action="store_true")
    i = sub.add_parser("inventory", parents=[common])
    i.add_argument("--audit-ignored", action="store_true")
    i.add_argument("--list-files", choices=[*inventory.CATEGORIES, "all"])
    a = sub.add_parser("analyze", parents=[common])
    c = sub.add_parser("comments", parents=[common])
    for x in (a, c):
        x.add_argument("--policy")
        x.add_argument("--review-at", type=_positive)
        x.add_argument("--block-at", type=_positive)
        x.add_argument("--no-block", action="store_true")
        x.add_argument("--documentation-below", type=_percent)
        x.add_argument("--top", type=_positive)
        x.add_argument("--gate", action="store_true")
        x.add_argument("--include-tests", action="store_true")
    a.add_argument("--profile", default="full", choices=["full", "review", "gate"])
    a.add_argument("--no-documentation", action="store_true")
    a.add_argument("--details", action="append", default=[])
    a.add_argument("--diagnostics", action="append", default=[])
    d = sub.add_parser("dependencies", parents=[common])
    k = sub.add_parser("calls", parents=[common])
    for x in (d, k):
        x.add_argument("--focus")
        x.add_argument("--depth", type=int, default=1)
        x.add_argument("--direction", choices=["both", "dependencies", "dependents"])
        x.add_argument("--cycles-only", action="store_true")
        x.add_argument("--python")
        x.add_argument("--venv")
        x.add_argument("--path-from")
        x.add_argument("--path-to")
        x.add_argument("--closure")
        x.add_argument("--exact-only", action="store_true")
        x.add_argument("--local-only", action="store_true")
    k.add_argument("--include-source", action="store_true")
    d.add_argument("--without", action="append", default=[], choices=list(project.EXCLUSIONS))
    return p


#: Findings and rankings shown unless --top says otherwise, by profile or command.
SHOWN = {"gate": 10, "review": 20, "comments": 20, "full": 10}


def checked(args: argparse.Namespace) -> None:
    """Options that exclude or need each other."""
    of = lambda name: getattr(args, name, None)
    for name in ("output", "open", "include_source"):
        if of(name) and args.format != "html":
            raise ValueError(f"--{name.replace('_', '-')} needs --format html")
    if args.format in ("mermaid", "dot", "html") and args.command not in ("dependencies", "calls"):
        raise ValueError(f"{args.command} has no {args.format} format")
    if of("open") and not of("output"):
        raise ValueError("--open needs --output")
    if of("block_at") and of("no_block"):
        raise ValueError("--block-at and --no-block exclude each other")
    if bool(of("path_from")) != bool(of("path_to")):
        raise ValueError("--path-from and --path-to need each other")
    if of("closure") and of("path_from"):
        raise ValueError("--closure and --path-from exclude each other")
    if (of("closure") or of("path_from")) and (of("focus") or of("cycles_only")):
        raise ValueError("a query takes neither --focus nor --cycles-only")
    if of("closure") and of("direction") == "both":
        raise ValueError("a closure follows dependencies or dependents, not both")
    if of("python") and of("venv"):
        raise ValueError("--python and --venv exclude each other")
    if of("include_source") and Path(args.path).is_file():
        raise ValueError("--include-source needs a folder")


def files_named(wanted: list[str], files, what: str):
    """The rows of the named paths; a path that isn't there is an error."""
    there = {r["path"] for r in files.where(F.col("path").isin(wanted)).select("path").collect()}
    if lost := sorted(set(wanted) - there):
        raise ValueError(f"no {what} of {', '.join(lost)}")
    return files.where(F.col("path").isin(wanted))


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    """Text of the report and the exit code: 0, 2 (review required) or 3 (blocked)."""
    ready(spark)
    checked(args)
    rules, warnings = layered([Path(f).read_text() for f in args.config])
    p = project.load(spark, args.path, rules, args.include_ignored, args.match, getattr(args, "audit_ignored", False))
    if args.command == "inventory":
        return inventory_report(args, p, warnings), 0
    if args.command in ("analyze", "comments"):
        return review_report(args, p)
    root = str(Path(args.path).parent) if Path(args.path).is_file() else args.path
    tables = environment.environment_tables(spark, environment.probe(args.python, args.venv)) if args.python or args.venv else (None, None)
    modules = project.local_modules(p, project.package_roots(root))
    imports = project.resolved_imports(p, modules, *tables, without=tuple(getattr(args, "without", ())))
    calls = args.command == "calls"
    g = project.call_graph(project.resolved_calls(p, modules, imports), p, modules) if calls else project.import_graph(imports, modules)
    nodes, relations = g["nodes"], g["relations"]
    if args.closure or args.path_from:
        return asked(args, g), 0
    focus = project.selected(nodes, args.focus) if calls and args.focus else args.focus
    nodes, relations = render.focused(nodes, relations, g["components"], focus, args.depth, args.direction or "both", args.cycles_only, args.exact_only, args.local_only)
    if args.format == "text":
        return render.summary(args.command, {
            "Nodes": render.pairs(g["nodes"].groupBy("kind").count(), "kind", "count"), "References": g["coverage"].first().asDict() if not calls else render.pairs(g["coverage"], "kind", "n"),
            **({} if calls else {"Import contexts": project.import_contexts(imports).first().asDict()}),
            "Most depended on": render.pairs(project.fan_ranking(g["metrics"], "fan_in"), "node", "fan_in"), "Most depending": render.pairs(project.fan_ranking(g["metrics"], "fan_out"), "node", "fan_out"),
            "Cycles": {"components": g["components"].where("cyclic").select("component").distinct().count()},
        }), 0
    if args.format == "json":
        parts = {"coverage": render.rows_json(g["coverage"]), "metrics": render.rows_json(g["metrics"], "node"), "components": render.rows_json(g["components"], "component", "node")}
        if "explanations" in g:
            parts["cycles"] = render.rows_json(g["explanations"], "number")
        return render.report(args.command, "0.1.0", nodes=render.rows_json(nodes, "id"), relations=render.rows_json(relations, "src", "dst"), **parts), 0
    if args.format == "html":
        source = None
        if getattr(args, "include_source", False):
            spans = p.table("symbols").where("kind in ('function', 'method', 'lambda')").select("path", F.concat_ws("::", "path", "id").alias("node"), "line", "end_line").join(nodes, "node", "left_semi")
            source = project.excerpts(spans, repo.with_bytes(p.chosen.where("language = 'python'")))
        return render.page(args.command, nodes, relations, g["components"], source), 0
    if (n := nodes.count()) > render.READABLE:
        print(f"loam: {n} nodes are hard to read; --focus or --cycles-only shows fewer", file=sys.stderr)
    return {"mermaid": render.mermaid, "dot": render.dot}[args.format](nodes, relations, g["components"] if not calls or args.format == "dot" else None), 0


def inventory_report(args: argparse.Namespace, p: project.Project, warnings: list[str]) -> str:
    files = p.files.select("path", "category", "language", "included_ignored")
    if args.list_files and args.list_files != "all":
        files = files.where(F.col("category") == args.list_files)
    losers = p.files.where(F.size("losers") > 0).select("path", "category", "losers").orderBy("path").collect()
    said = [*warnings, *[f"category-more-specific-rule-wins: {r['path']} is {r['category']}, not {', '.join(r['losers'])}; exclude it there to silence this" for r in losers]]
    said += [f"directory-unreadable: {r['path']}" for r in p.entries.where("state = 'unreadable'").select("path").orderBy("path").collect()]
    said = [] if args.no_warnings else said
    counts = inventory.category_counts(p.files)
    if args.format == "text":
        parts = {"Files": render.pairs(counts, "category", "n"), "Lines": render.pairs(project.line_totals(p).where("language is not null"), "language", "total"), "Uncategorized": render.pairs(inventory.uncategorized_extensions(p.files), "extension", "n")}
        if args.list_files:
            parts["Listed"] = render.pairs(files.orderBy("path"), "path", "category")
        return render.summary("inventory", parts | ({"Warnings": dict.fromkeys(said, "")} if said else {}))
    return render.report(
        "inventory", "0.1.0", categories=render.rows_json(counts, "category"), files=render.rows_json(files, "path"), lines=render.rows_json(project.line_totals(p), "language"),
        ignored=render.rows_json(p.entries.where("state = 'ignored'").select("path", "entry"), "path"), diagnostics=said,
    )


def review_report(args: argparse.Namespace, p: project.Project) -> tuple[str, int]:
    base = from_json(Path(args.policy).read_text()) if args.policy else None
    policy = with_options(*([base] if base else [project.Policy()]), args.review_at, args.block_at, args.no_block, args.documentation_below)
    comments = args.command == "comments"
    if comments and args.gate and policy.documentation_below is None:
        raise ValueError("the documentation gate needs a threshold")
    documented = comments or not args.no_documentation
    found = project.findings(p, policy, documented, args.include_tests)
    if comments:
        found = found.where(F.col("rule_id").startswith("documentation"))
    found = cut(found)
    gate = review.gate_status(found).first()
    profile = "comments" if comments else args.profile
    shown = args.top or SHOWN[profile]
    parts = {"status": gate["status"], "finding_count": gate["findings"], "acknowledged_count": gate["acknowledged"], "findings": render.rows_json(found.orderBy("position").limit(shown), "position"), "policy_sources": list(policy.sources)}
    if documented and profile != "gate":
        parts["documentation"] = render.rows_json(project.documentation(p, args.include_tests, policy.documentation_below or 80), "grouping", "key")
        lacking = project.eligible_symbols(p.table("symbols"), args.include_tests)
        for state in ("missing", "unavailable"):
            rows = lacking.where(F.col("state") == state).select("path", "kind", "qualified_name", "line")
            parts[state] = {"total": rows.count(), "symbols": render.rows_json(review.top(rows, shown, F.col("path"), F.col("line"), F.col("qualified_name")), "path", "line", "qualified_name")}
    if not comments:
        measured = pyfacts.measurements(p.table("symbols"))
        scores = measured.where("metric = 'cyclomatic-complexity'").withColumnRenamed("symbol_id", "item")
        parts["coverage"] = project.review_coverage(p).first().asDict()
        parts["analyzers"] = render.rows_json(project.analyzer_counts(p), "language")
        if profile != "gate":
            parts["rankings"] = render.rows_json(review.top(review.complexity_ranking(scores, "item", "value", policy.review_at, policy.named_bands).select("position", "item", "value", "risk", "needs_review"), shown, F.col("position")), "position")
        if profile == "full":
            parts["measurements"] = render.rows_json(measured, "path", "symbol_id", "metric")
            parts["top_measurements"] = render.rows_json(review.top_per(measured.where("value is not null"), "metric", 3, F.col("value").desc(), F.col("path"), F.col("symbol_id")), "metric", "position")
            parts["files"] = render.rows_json(p.facts.select("path", "status", "diagnostics"), "path")
            for kind in ("symbols", "imports", "calls"):
                parts[kind] = render.rows_json(p.table(kind), "path", "start_byte")
        if args.details:
            parts["details"] = render.rows_json(files_named(args.details, p.facts, "facts"), "path")
        if args.diagnostics:
            parts["diagnostics"] = render.rows_json(files_named(args.diagnostics, p.facts.select("path", "status", "diagnostics"), "diagnostics"), "path")
    if args.format == "text":
        told = {"Gate": {"status": gate["status"], "findings": gate["findings"], "acknowledged": gate["acknowledged"]}, "Findings": {f"{r['rule_id']} {r['item'] or r['path'] or ''}": r["action"] for r in parts["findings"]}}
        if not comments:
            told |= {"Facts": project.symbol_kinds(p).first().asDict(), "Coverage": parts["coverage"]}
        if documented and profile != "gate":
            told["Documentation"] = {r["key"] or "all": r["percent"] or "-" for r in parts["documentation"] if r["grouping"] in ("total", "kind")}
        return render.summary(args.command, told), gate["exit_code"] if args.gate else 0
    return render.report(args.command, "0.1.0", **parts), gate["exit_code"] if args.gate else 0


def asked(args: argparse.Namespace, g: dict) -> str:
    """A path between two nodes or the closure of one."""
    nodes = g["nodes"]

    def of(name: str):
        if args.command == "calls":
            return project.selected(nodes, name)
        return render.module_nodes(nodes, name)

    if args.closure:
        seen = project.closure_view(g, of(args.closure), args.direction)
        return render.report("closure", "0.1.0", nodes=render.rows_json(seen["nodes"], "id"), relations=render.rows_json(seen["relations"], "src", "dst"), components=render.rows_json(seen["components"], "component", "node"))
    path, steps = project.path_between(g, of(args.path_from), of(args.path_to))
    return render.report("path", "0.1.0", found=bool(path), path=path, relations=render.rows_json(steps, "step", "src", "dst"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loam").getOrCreate()
    try:
        text, code = run(args, spark)
    except (ValueError, OSError, RuntimeError) as e:
        print(f"loam: {e}", file=sys.stderr)
        return 1
    if args.output:
        Path(args.output).write_text(text)
        if args.open:
            webbrowser.open(Path(args.output).resolve().as_uri())
    else:
        print(text, end="")
    return code


if __name__ == "__main__":
    sys.exit(main())
