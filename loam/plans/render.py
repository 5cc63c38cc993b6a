"""Graph texts and reports: Mermaid, DOT, JSON and a standalone HTML page.

Labels are escaped in the JVM; the driver only joins the lines of the graph that the reader asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scalars as S
from loam.operators import graph

SHAPES = {"local": "box", "stdlib": "ellipse", "distribution": "component", "ambiguous": "diamond", "unresolved": "octagon", "external": "ellipse"}
FILLS = {"local": "#e8f0fe", "stdlib": "#eeeeee", "distribution": "#eeeeee", "ambiguous": "#fff4ce", "unresolved": "#fde7e9", "external": "#eeeeee"}
#: Nodes beyond which a drawing is hard to read.
READABLE = 200
PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:left;vertical-align:top}}.on{{background:#fff4ce}}pre{{background:#f6f6f6;padding:1em}}#s{{max-width:60em}}</style>
<h1>{title}</h1><input id="q" placeholder="filter"> <label><input type="checkbox" id="c"> cycles only</label><div id="s"></div>
<h2>Nodes</h2><table id="n"><tr><th>id<th>name<th>kind<th>in<th>out<th>cycle</table><h2>Relations</h2><table id="t"><tr><th>from<th>to<th>kind<th>places</table>
<script type="application/json" id="data">{data}</script>
<script>const d=JSON.parse(document.getElementById("data").textContent),$=x=>document.getElementById(x),deg={{}};
for(const r of d.relations){{(deg[r.src]??=[0,0])[1]++;(deg[r.dst]??=[0,0])[0]++}}
function row(t,cells,key){{const x=t.insertRow();for(const c of cells)x.insertCell().textContent=c??"";if(key)x.onclick=()=>show(key);return x}}
function show(key){{const n=d.nodes.find(n=>n.node==key),s=d.sources[key];$("s").replaceChildren();const h=document.createElement("h3");h.textContent=n.label;$("s").append(h);if(s!=null){{const p=document.createElement("pre");p.textContent=s;$("s").append(p)}}}}
function draw(){{for(const t of[$("n"),$("t")])while(t.rows.length>1)t.deleteRow(1);const q=$("q").value,ok=n=>(!q||n.includes(q))&&(!$("c").checked||d.cycles[n]);
for(const n of d.nodes)if(ok(n.node))row($("n"),[n.id,n.label,n.kind,...(deg[n.node]??[0,0]),d.cycles[n.node]],n.node);
for(const r of d.relations)if(ok(r.src)||ok(r.dst))row($("t"),[r.src,r.dst,r.kind,r.places])}}
$("q").oninput=$("c").onchange=draw;draw()</script>
"""


def labelled(nodes: DataFrame) -> DataFrame:
    """Nodes (id, node) with their kind and label."""
    kind = F.col("kind") if "kind" in nodes.columns else F.lit("local")
    label = F.col("label") if "label" in nodes.columns else F.col("node")
    return nodes.select("id", "node", kind.alias("kind"), label.alias("label"))


def _parts(nodes: DataFrame, relations: DataFrame, escape) -> tuple[list, list]:
    n = labelled(nodes).withColumn("label", escape(F.col("label")))
    named = nodes.select("id", "node")
    e = relations.join(named.select(F.col("node").alias("src"), F.col("id").alias("a")), "src").join(named.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst")
    kind = F.col("kind") if "kind" in relations.columns else F.lit("exact")
    return n.orderBy("id").collect(), e.select("a", "b", kind.alias("kind")).orderBy("a", "b").collect()


def _groups(components: DataFrame | None) -> dict:
    return {} if components is None else {r["node"]: r["component"] for r in components.where("cyclic").collect()}


def mermaid(nodes: DataFrame, relations: DataFrame, components: DataFrame | None = None) -> str:
    """Flow chart; cycles are subgraphs, inexact relations are dashed."""
    points, edges = _parts(nodes, relations, S.escape_mermaid)
    group, out = _groups(components), ["flowchart LR"]
    for k, c in enumerate(sorted(set(group.values()))):
        out += [f"  subgraph c{k:04d}[cycle {k + 1}]", *[f'    {r["id"]}["{r["label"]}"]:::{r["kind"]}' for r in points if group.get(r["node"]) == c], "  end"]
    out += [f'  {r["id"]}["{r["label"]}"]:::{r["kind"]}' for r in points if r["node"] not in group]
    out += [f"  {r['a']} {'-->' if r['kind'] == 'exact' else '-.->'} {r['b']}" for r in edges]
    out += [f"  classDef {k} fill:{FILLS[k]}" for k in SHAPES if any(r["kind"] == k for r in points)]
    return "\n".join(out) + "\n"


def dot(nodes: DataFrame, relations: DataFrame, components: DataFrame | None = None) -> str:
    """DOT digraph; cycles are clusters, shapes tell the kinds of nodes."""
    points, edges = _parts(nodes, relations, S.escape_dot)
    group, out = _groups(components), ["digraph loam {", "  rankdir=LR;"]
    line = lambda r: f'{r["id"]} [label="{r["label"]}", shape={SHAPES[r["kind"]]}, style=filled, fillcolor="{FILLS[r["kind"]]}"];'
    for k, c in enumerate(sorted(set(group.values()))):
        out += [f"  subgraph cluster_{k} {{", f'    label="cycle {k + 1}";', *["    " + line(r) for r in points if group.get(r["node"]) == c], "  }"]
    out += ["  " + line(r) for r in points if r["node"] not in group]
    out += [f"  {r['a']} -> {r['b']}{'' if r['kind'] == 'exact' else ' [style=dashed]'};" for r in edges]
    return "\n".join([*out, "}"]) + "\n"


def rows_json(df: DataFrame, *order: str) -> list:
    """Rows as JSON values in a fixed order."""
    ordered = df.orderBy(*order) if order else df
    return [json.loads(r[0]) for r in ordered.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


def report(kind: str, version: str, **parts) -> str:
    """A versioned JSON document with sorted keys, without times or absolute paths."""
    return json.dumps({"tool": "loam", "report": kind, "report_schema_version": version} | parts, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def page(title: str, nodes: DataFrame, relations: DataFrame, components: DataFrame | None = None, sources: DataFrame | None = None) -> str:
    """A page of nodes and relations with filters, cycles and, if given, the callables' source (node, source)."""
    places = F.size("evidence") if "evidence" in relations.columns else F.lit(None).cast("int")
    data = {"nodes": rows_json(labelled(nodes), "id"), "relations": rows_json(relations.select("src", "dst", "kind", places.alias("places")), "src", "dst"), "cycles": _groups(components)}
    data["sources"] = {r["node"]: r["source"] for r in sources.select("node", "source").collect()} if sources is not None else {}
    text = json.dumps(data)
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = text.replace(a, b)
    return PAGE.format(title=title.replace("<", "&lt;"), data=text)


def pairs(df: DataFrame, key: str, value: str) -> dict:
    """Two columns of a small table as a mapping, in its order."""
    return {r[key]: r[value] for r in df.select(key, value).collect()}


def summary(title: str, parts: dict[str, dict]) -> str:
    """Headed lists for a terminal; names that are paths of nodes stay whole."""
    out = [title]
    for head, rows in parts.items():
        out.append(f"{head}:")
        wide = max([len(str(k)) for k in rows], default=0)
        out += [f"  {str(k).ljust(wide)}  {v}".rstrip() for k, v in rows.items()] or ["  none"]
    return "\n".join(out) + "\n"


def module_nodes(nodes: DataFrame, name: str) -> DataFrame:
    """The nodes of a module's name or identity; an error with the nearest names if there is none."""
    seeds = nodes.where((F.col("node") == name) | F.col("node").startswith(f"python:{name}@"))
    if seeds.isEmpty():
        known = nodes.select(F.regexp_extract("node", "^python:([^@]*)@", 1).alias("name")).where("name <> ''")
        near = graph.suggestions(nodes.sparkSession.createDataFrame([(name,)], "request string"), known)
        raise ValueError(f"no module {name!r}; nearest: " + ", ".join(r["name"] for r in near.orderBy("position").collect()))
    return seeds.select("node")


def focused(nodes: DataFrame, relations: DataFrame, components: DataFrame, focus: str | DataFrame | None, depth: int = 1, direction: str = "both", cycles_only: bool = False, exact_only: bool = False, local_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations of a view: around ``focus`` (a module or a table of nodes) or on cycles, touched cycles complete, ids as in the whole graph."""
    if exact_only or local_only:
        nodes = nodes.where(F.col("kind") == "local" if local_only else ~F.col("kind").isin("ambiguous", "unresolved"))
        relations = relations.where("kind = 'exact'")
    if focus is not None:
        seeds = module_nodes(nodes, focus) if isinstance(focus, str) else focus
        chosen = graph.complete_cycles(graph.neighbourhood(relations, seeds, depth, direction), components)
        nodes = nodes.join(chosen, "node", "left_semi")
    if cycles_only:
        nodes = nodes.join(components.where("cyclic").select("node"), "node", "left_semi")
    return nodes, graph.view(relations, nodes)
