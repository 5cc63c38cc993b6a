"""Facts of Python files: symbols, imports, calls, decisions, docstrings.

One Arrow-batched stage turns (path, bytes) into nested facts; everything after it is relational.  The
parser is the standard library's.  A file with syntax errors is read again block by block: whole blocks
at column 0 keep their facts, of broken ones the def and class headers are kept as partial symbols.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "start_byte long, end_byte long, line long, column long, end_line long"
FACTS = (
    "path string, status string, diagnostics array<struct<code:string, line:long>>, "
    "symbols array<struct<id:string, parent_id:string, kind:string, name:string, qualified_name:string, direct:boolean, start_byte:long, end_byte:long, line:long, end_line:long, "
    "partial:boolean, modifiers:array<string>, decorators:array<string>, parameters:array<struct<name:string, kind:string, has_default:boolean, annotated:boolean>>, "
    "documentation:string, nesting:array<int>, decisions:array<string>>>, "
    "imports array<struct<kind:string, module:string, imported:string, alias:string, level:int, scope:string, usage:string, requirement:string, conditional:boolean, enclosing:string, start_byte:long, line:long>>, "
    "calls array<struct<callee:string, components:array<string>, enclosing:string, owner_kind:string, owner_name:string, positional:int, keywords:array<string>, star_args:boolean, star_kwargs:boolean, start_byte:long, line:long>>"
)
CALLABLES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: Nodes that hold nothing to visit.
LEAVES = frozenset({ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, *(k for base in (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop) for k in base.__subclasses__())})
_HEADER = re.compile(r"([ \t]*)(async[ \t]+)?(def|class)[ \t]+(\w+)")
_QUOTED = re.compile(r"[rRuU]{0,2}(?:'|\")")


@dataclass
class Owner:
    """What surrounds a node: the parent symbol, the callable that scores, and how the code is reached."""

    symbol: dict
    callable: dict | None = None
    depth: int = 0
    type_only: bool = False
    optional: bool = False
    conditional: bool = False
    direct: bool = True

    def but(self, **changes) -> Owner:
        made = object.__new__(Owner)
        made.__dict__.update(self.__dict__, **changes)
        return made


@dataclass
class Facts:
    path: str
    text: str
    symbols: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    calls: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lines = self.text.encode("utf-8", "surrogatepass").split(b"\n")
        self.starts = [0]
        for raw in self.lines:
            self.starts.append(self.starts[-1] + len(raw) + 1)
        self.ordinals: dict[str, int] = {}
        self.checking: set[str] = {"TYPE_CHECKING"}

    def byte(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col

    def symbol(self, kind: str, name: str, parent: dict | None, node: ast.AST | None, **more) -> dict:
        qualified = name if parent is None or parent["kind"] == "module" and kind != "lambda" else f"{parent['qualified_name']}.{name}"
        if kind == "module":
            base = f"{self.path}::module"
            ident = base
        else:
            base = f"{self.path}::{kind}:{qualified}"
            self.ordinals[base] = self.ordinals.get(base, 0) + 1
            ident = f"{base}#{self.ordinals[base]}"
        if node is None:
            span = {"start_byte": 0, "end_byte": len(self.text.encode("utf-8", "surrogatepass")), "line": 1, "end_line": max(1, len(self.lines) - (self.lines[-1] == b""))}
        else:
            marks = getattr(node, "decorator_list", None)
            first = min([node, *marks], key=lambda n: (n.lineno, n.col_offset)) if marks else node
            at = self.byte(first.lineno, first.col_offset) - (first is not node and 1)
            span = {"start_byte": at, "end_byte": self.byte(node.end_lineno, node.end_col_offset), "line": first.lineno, "end_line": node.end_lineno}
        made = {"id": ident, "parent_id": parent and parent["id"], "kind": kind, "name": name, "qualified_name": qualified, "direct": True, "partial": False,
                "modifiers": [], "decorators": [], "parameters": [], "documentation": None, "nesting": [], "decisions": []} | span | more
        self.symbols.append(made)
        return made

    # -- statements ---------------------------------------------------------------------------------

    def body(self, nodes: list[ast.stmt], o: Owner) -> None:
        for n in nodes:
            self.visit(n, o)

    def visit(self, n: ast.AST, o: Owner) -> None:
        kind = type(n)
        if kind in LEAVES:
            return
        handler = HANDLERS.get(kind)
        if handler:
            handler(self, n, o)
        else:
            self.children(n, o)

    def children(self, n: ast.AST, o: Owner) -> None:
        for name in n._fields:
            c = getattr(n, name, None)
            for x in c if type(c) is list else (c,):
                if type(x) not in LEAVES and isinstance(x, ast.AST):
                    self.visit(x, o)

    def decide(self, o: Owner, kind: str) -> None:
        if o.callable is not None:
            o.callable["decisions"].append(kind)

    def deeper(self, o: Owner, **changes) -> Owner:
        if o.callable is not None:
            o.callable["nesting"].append(o.depth + 1)
        return o.but(depth=o.depth + 1, direct=False, **changes)

    def define(self, n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, o: Owner) -> None:
        for d in n.decorator_list:
            self.visit(d, o)
        names = [source_of(d) for d in n.decorator_list]
        if isinstance(n, ast.ClassDef):
            for p in getattr(n, "type_params", []):
                self.visit(p, o)
            for k in n.keywords:
                self.visit(k.value, o)
            s = self.symbol("class", n.name, o.symbol, n, direct=o.direct, decorators=names, documentation=self.docstring(n.body))
            self.body(n.body, Owner(s, None, type_only=o.type_only, optional=False, conditional=o.conditional))
            return
        kind = "method" if o.symbol["kind"] == "class" else "function"
        modifiers = ["async"] * isinstance(n, ast.AsyncFunctionDef) + sorted({m for m in ("staticmethod", "classmethod") for d in names if d.startswith(m)})
        self.defaults(n.args, o, annotations=True)
        s = self.symbol(kind, n.name, o.symbol, n, direct=o.direct, modifiers=modifiers, decorators=names, parameters=parameters(n.args), documentation=self.docstring(n.body))
        self.body(n.body, Owner(s, s))

    on_FunctionDef = on_AsyncFunctionDef = on_ClassDef = define

    def defaults(self, a: ast.arguments, o: Owner, annotations: bool) -> None:
        for d in [*a.defaults, *[k for k in a.kw_defaults if k]]:
            self.visit(d, o)
        if annotations:
            for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *[x for x in (a.vararg, a.kwarg) if x]]:
                if p.annotation:
                    self.visit(p.annotation, o)

    def on_Lambda(self, n: ast.Lambda, o: Owner) -> None:
        name = f"<lambda>@{n.lineno}:{n.col_offset + 1}"
        s = self.symbol("lambda", name, o.symbol, n, direct=False, parameters=parameters(n.args))
        self.visit(n.body, Owner(s, s))

    def docstring(self, nodes: list[ast.stmt]) -> str:
        """documented, missing-blank (an empty string stands there) or missing."""
        first = nodes[0] if nodes else None
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return "missing"
        return "documented" if first.value.value.strip() else "missing-blank"

    def on_If(self, n: ast.If, o: Owner, elif_: bool = False) -> None:
        self.decide(o, "elif" if elif_ else "if")
        inner = o.but(direct=False) if elif_ else self.deeper(o)
        self.visit(n.test, o)
        checks = is_type_checking(n.test, self.checking)
        self.body(n.body, inner.but(conditional=True, type_only=o.type_only or checks))
        rest = n.orelse
        if len(rest) == 1 and isinstance(rest[0], ast.If) and self.lines[rest[0].lineno - 1][rest[0].col_offset :].startswith(b"elif"):
            self.on_If(rest[0], inner.but(depth=inner.depth, conditional=True), elif_=True)
        else:
            self.body(rest, inner.but(conditional=True))

    def loop(self, n: ast.For | ast.AsyncFor | ast.While, o: Owner) -> None:
        self.decide(o, "loop")
        inner = self.deeper(o, conditional=True)
        for part in ("target", "iter", "test"):
            if hasattr(n, part):
                self.visit(getattr(n, part), o)
        self.body(n.body, inner)
        self.body(n.orelse, inner)

    on_For = on_AsyncFor = on_While = loop

    def attempt(self, n: ast.Try, o: Owner) -> None:
        inner = self.deeper(o)
        guards = any(h.type is not None and re.search(r"\b(?:ImportError|ModuleNotFoundError)\b", ast.unparse(h.type)) for h in n.handlers)
        self.body(n.body, inner.but(optional=o.optional or guards))
        for h in n.handlers:
            self.decide(o, "exception-handler")
            if h.type:
                self.visit(h.type, o)
            self.body(h.body, inner.but(conditional=True))
        self.body(n.orelse, inner.but(conditional=True))
        self.body(n.finalbody, inner.but(conditional=True))

    on_Try = on_TryStar = attempt

    def within(self, n: ast.With | ast.AsyncWith, o: Owner) -> None:
        inner = self.deeper(o)
        for i in n.items:
            self.children(i, o)
        self.body(n.body, inner)

    on_With = on_AsyncWith = within

    def on_Match(self, n: ast.Match, o: Owner) -> None:
        inner = self.deeper(o, conditional=True)
        self.visit(n.subject, o)
        for c in n.cases:
            if not irrefutable(c.pattern):
                self.decide(o, "match-case")
            if c.guard:
                self.decide(o, "match-guard")
                self.visit(c.guard, inner)
            self.visit(c.pattern, inner)
            self.body(c.body, inner)

    def on_Assert(self, n: ast.Assert, o: Owner) -> None:
        self.decide(o, "assert")
        self.children(n, o)

    # -- expressions --------------------------------------------------------------------------------

    def on_IfExp(self, n: ast.IfExp, o: Owner) -> None:
        self.decide(o, "conditional-expression")
        for c in (n.body, n.test, n.orelse):
            self.visit(c, o)

    def on_BoolOp(self, n: ast.BoolOp, o: Owner) -> None:
        for _ in n.values[1:]:
            self.decide(o, "boolean-operator")
        self.children(n, o)

    def comprehension(self, n: ast.AST, o: Owner) -> None:
        inner = self.deeper(o)
        for part in ("elt", "key", "value"):
            if getattr(n, part, None) is not None:
                self.visit(getattr(n, part), inner)
        for g in n.generators:
            self.decide(o, "comprehension-loop")
            self.visit(g.target, inner)
            self.visit(g.iter, inner)
            for test in g.ifs:
                self.decide(o, "comprehension-filter")
                self.visit(test, inner)

    on_ListComp = on_SetComp = on_DictComp = on_GeneratorExp = comprehension

    def on_Call(self, n: ast.Call, o: Owner) -> None:
        owner, parts = o.callable or o.symbol, dotted(n.func)
        self.calls.append({
            "callee": ".".join(parts) or ast.unparse(n.func), "components": parts, "enclosing": owner["id"], "owner_kind": owner["kind"], "owner_name": owner["qualified_name"],
            "positional": sum(not isinstance(a, ast.Starred) for a in n.args), "keywords": sorted(k.arg for k in n.keywords if k.arg),
            "star_args": any(isinstance(a, ast.Starred) for a in n.args), "star_kwargs": any(k.arg is None for k in n.keywords),
            "start_byte": self.byte(n.lineno, n.col_offset), "line": n.lineno,
        })
        self.children(n, o)

    def add_import(self, n: ast.stmt, o: Owner, kind: str, module: str | None, imported: str | None, alias: str | None, level: int) -> None:
        scope = "callable" if o.callable else "class" if o.symbol["kind"] == "class" else "module"
        self.imports.append({
            "kind": kind, "module": module, "imported": imported, "alias": alias, "level": level, "scope": scope,
            "usage": "type-only" if o.type_only else "runtime", "requirement": "optional" if o.optional else "required",
            "conditional": o.optional or o.conditional, "enclosing": (o.callable or o.symbol)["id"], "start_byte": self.byte(n.lineno, n.col_offset), "line": n.lineno,
        })

    def on_Import(self, n: ast.Import, o: Owner) -> None:
        for a in n.names:
            self.add_import(n, o, "import", a.name, None, a.asname, 0)

    def on_ImportFrom(self, n: ast.ImportFrom, o: Owner) -> None:
        for a in n.names:
            self.add_import(n, o, "from", n.module, a.name, a.asname, n.level or 0)


#: What visits a node, by its type.
HANDLERS = {getattr(ast, name[3:]): f for name, f in vars(Facts).items() if name.startswith("on_")}


def parameters(a: ast.arguments) -> list[dict]:
    out = []

    def add(p: ast.arg, kind: str, default: bool) -> None:
        out.append({"name": p.arg, "kind": kind, "has_default": default, "annotated": p.annotation is not None})

    plain = [*((p, "positional-only") for p in a.posonlyargs), *((p, "positional-or-keyword") for p in a.args)]
    for k, (p, kind) in enumerate(plain):
        add(p, kind, k >= len(plain) - len(a.defaults))
    if a.vararg:
        add(a.vararg, "variadic-positional", False)
    for p, d in zip(a.kwonlyargs, a.kw_defaults):
        add(p, "keyword-only", d is not None)
    if a.kwarg:
        add(a.kwarg, "variadic-keyword", False)
    return out


def dotted(n: ast.expr) -> list[str]:
    """Names of a chain of attributes; empty for anything else."""
    parts: list[str] = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return [n.id, *reversed(parts)] if isinstance(n, ast.Name) else []


def source_of(n: ast.expr) -> str:
    """The text of an expression; a chain of names, as most are, needs no unparser."""
    return ".".join(dotted(n)) or ast.unparse(n)


def is_type_checking(test: ast.expr, names: set[str]) -> bool:
    parts = dotted(test)
    return bool(parts) and (parts[-1] == "TYPE_CHECKING" or len(parts) == 1 and parts[0] in names)


def irrefutable(p: ast.pattern) -> bool:
    """A wildcard, a bare capture, or an alias or alternative that holds one."""
    if isinstance(p, ast.MatchAs):
        return p.pattern is None or irrefutable(p.pattern)
    return isinstance(p, ast.MatchOr) and any(map(irrefutable, p.patterns))


def parse(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(first line, text) of the runs of lines that begin at column 0."""
    at, held = 1, []
    for k, line in enumerate(text.split("\n"), 1):
        begins = line[:1] not in ("", " ", "\t", "#", ")", "]", "}") and not re.match(r"(else|elif|except|finally)\b", line)
        after_decorator = any(x.startswith("@") for x in held[:1]) and not any(_HEADER.match(x) for x in held)
        if begins and held and not after_decorator:
            yield at, "\n".join(held)
            at, held = k, []
        held.append(line)
    if held:
        yield at, "\n".join(held)


def python_facts(path: str, data: bytes) -> dict:
    """Facts of one file: status is successful, partial (with diagnostics) or failed."""
    diagnostics = []
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
        diagnostics.append({"code": "source-not-utf8", "line": 1})
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\0", " ")
    facts = Facts(path, text)
    failed = False
    try:
        try:
            whole = parse(text)
            gather(facts, whole)
        except SyntaxError:
            diagnostics += recover(facts, text)
    except (RecursionError, MemoryError):
        facts, failed = Facts(path, text), True
        diagnostics.append({"code": "too-deep", "line": 1})
    order = lambda s: (s["start_byte"], -s.get("end_byte", 0), s.get("id", ""))
    return {
        "path": path, "status": "failed" if failed else "partial" if diagnostics else "successful", "diagnostics": diagnostics,
        "symbols": sorted(facts.symbols, key=order), "imports": sorted(facts.imports, key=lambda s: s["start_byte"]), "calls": sorted(facts.calls, key=lambda s: (s["start_byte"], s["callee"])),
    }


def gather(facts: Facts, tree: ast.Module) -> None:
    # Only a name beyond ASCII may be written otherwise than it is known by.
    for n in ast.walk(tree) if "TYPE_CHECKING" in facts.text or not facts.text.isascii() else ():
        if isinstance(n, ast.ImportFrom) and n.module == "typing":
            facts.checking |= {a.asname or a.name for a in n.names if a.name == "TYPE_CHECKING"}
    module = facts.symbol("module", facts.path, None, None, documentation=facts.docstring(tree.body))
    facts.body(tree.body, Owner(module))


def recover(facts: Facts, text: str) -> list[dict]:
    """Facts of the blocks that parse, partial symbols of those that don't; one diagnostic for each of the latter."""
    module = facts.symbol("module", facts.path, None, None, partial=True, documentation="unavailable")
    out = []
    for line, part in blocks(text):
        padded = "\n" * (line - 1) + part
        try:
            tree = parse(padded)
        except SyntaxError as e:
            out.append({"code": "parse-error", "line": e.lineno or line})
            stack: list[tuple[int, dict]] = [(-1, module)]
            for k, raw in enumerate(part.split("\n")):
                if m := _HEADER.match(raw):
                    width = len(m[1].expandtabs())
                    while stack[-1][0] >= width:
                        stack.pop()
                    parent = stack[-1][1]
                    kind = "class" if m[3] == "class" else "method" if parent["kind"] == "class" else "function"
                    at = facts.byte(line + k, len(m[1].encode()))
                    s = facts.symbol(kind, m[4], parent, None, partial=True, documentation="unavailable", modifiers=["async"] if m[2] else [])
                    s |= {"start_byte": at, "end_byte": at + len(raw.encode()) - len(m[1].encode()), "line": line + k, "end_line": line + k}
                    stack.append((width, s))
        else:
            facts.body(tree.body, Owner(module))
    return out


def analyze(files: DataFrame, path: str = "path", content: str = "bytes") -> DataFrame:
    """Nested facts of Python files, one row each; null content counts as empty, paths are expected to be unique."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    chosen = files.select(F.col(path).alias("path"), F.col(content).alias("bytes"))
    schema = to_arrow_schema(_parse_datatype_string(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [python_facts(p, b or b"") for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return chosen.mapInArrow(run, FACTS)


def table_of(facts: DataFrame, kind: str) -> DataFrame:
    """symbols, imports, calls or diagnostics as rows."""
    return facts.select("path", F.explode(kind).alias("x")).select("path", "x.*")


def measurements(symbols: DataFrame) -> DataFrame:
    """Six rows for each callable: (path, symbol_id, metric, value); null values where the symbol is partial."""
    method = (F.col("kind") == "method") & ~F.array_contains("modifiers", "staticmethod")
    declared = F.size("parameters")
    of: dict[str, Column] = {
        "physical-lines": F.col("end_line") - F.col("line") + 1,
        "declared-parameters": declared,
        "caller-parameters": F.when(method, F.greatest(declared - 1, F.lit(0))).otherwise(declared),
        "max-nesting": F.coalesce(F.array_max("nesting"), F.lit(0)),
        "decision-points": F.size("decisions"),
        "cyclomatic-complexity": 1 + F.size("decisions"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.when(~F.col("partial"), v.cast("long")).alias("value")) for k, v in of.items()])
    return symbols.where("kind in ('function', 'method', 'lambda')").select("path", F.col("id").alias("symbol_id"), F.explode(rows).alias("m")).select("path", "symbol_id", "m.*")
