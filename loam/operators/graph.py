"""Graphs as edge tables (src, dst): relations, degrees, neighbourhoods, closures, paths, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loam.functions.scalars import node_id
from loam.lineage import cut
from loam.operators.review import with_position


def relations(evidence: DataFrame, src: str, dst: str, kind: str, *keys: str) -> DataFrame:
    """One row for each (src, dst, kind) with its evidence ordered by ``keys``."""
    return evidence.groupBy(src, dst, kind).agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("evidence"))


def fan_metrics(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Distinct neighbours in and out of every node; nodes without edges have zeros."""
    once = edges.select("src", "dst").distinct()
    into = once.groupBy(F.col("dst").alias(node)).agg(F.count("*").alias("fan_in"))
    outof = once.groupBy(F.col("src").alias(node)).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select(node).distinct().join(into, node, "left").join(outof, node, "left").select(node, zero("fan_in"), zero("fan_out"))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to follow: ``dependencies`` (src to dst), ``dependents`` or ``both``."""
    plain, turned = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"dependencies": plain, "dependents": turned, "both": plain.unionByName(turned)}
    if direction not in ways:
        raise ValueError(f"direction {direction!r} is not one of {', '.join(ways)}")
    return ways[direction].distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", seed: str = "node") -> DataFrame:
    """(node, depth) of the nodes within ``depth`` steps of the seeds, the least depth of each."""
    steps = cut(oriented(edges, direction))
    reached = seeds.select(F.col(seed).alias("node"), F.lit(0).alias("depth")).distinct()
    front = reached
    for d in range(1, depth + 1):
        front = cut(front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        reached = cut(reached.unionByName(front))
    return reached


#: Edges of a weakly connected part up to which one task finds its closure; larger parts are squared.
CLOSURE_EDGES = 20_000


def closed_parts(schema: pa.Schema, rows: int = 200_000):
    """All (root, node) of each part, as bit sets over its strong components in the order in which they close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, reached = [], []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((roots, reached), schema)], schema=schema)
            roots.clear(), reached.clear()
            return out

        for part in groups_of(batches, "root"):
            successors: dict = {}
            for a, b in set(zip(part["src"], part["dst"])):
                successors.setdefault(a, []).append(b)
            closed = tarjan(list(successors), successors)
            order = [n for c in closed for n in c]
            place = {n: k for k, n in enumerate(order)}
            reach: dict = {}
            for c in closed:
                bits = 0
                for n in c:
                    for m in successors.get(n, ()):
                        bits |= (1 << place[m]) | reach.get(m, 0)
                for n in c:
                    reach[n] = bits
                if not bits:
                    continue
                flags = bin(bits)[:1:-1]
                nodes, k = [], flags.find("1")
                while k >= 0:
                    nodes.append(order[k])
                    k = flags.find("1", k + 1)
                for n in c:
                    roots += [n] * len(nodes)
                    reached += nodes
                    if len(roots) >= rows:
                        yield made()
        if roots:
            yield made()

    return run


def closure(edges: DataFrame, direction: str = "dependencies", part_edges: int = CLOSURE_EDGES) -> DataFrame:
    """All (root, node) with a path of at least one edge from root to node.

    Weakly connected parts of up to ``part_edges`` edges are solved many in a task; larger ones by squaring, in
    log2(longest path) rounds.
    """
    if direction != "dependencies":
        edges = oriented(edges, direction)
    kind = dict(edges.dtypes)["src"]
    parts = weak_parts(edges)
    if not parts.where("root is null").isEmpty():  # an end without a key is in no part
        return squared(parts)
    large = cut(parts.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > part_edges).select("root"))
    shape = f"root {kind}, node {kind}"
    small = parts.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root")
    out = small.mapInArrow(closed_parts(to_arrow_schema(_parse_datatype_string(shape))), shape)
    if large.isEmpty():
        return out
    return out.unionByName(squared(parts.join(large, "root", "left_semi")))


def squared(edges: DataFrame) -> DataFrame:
    """The closure of ``edges`` by joining it with itself until nothing is new."""
    reach = cut(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct())
    size = reach.count()
    while True:
        onward = reach.select(F.col("root").alias("node"), F.col("node").alias("next"))
        reach = cut(reach.unionByName(reach.join(onward, "node").select("root", F.col("next").alias("node"))).distinct())
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def closure_of(edges: DataFrame, roots: DataFrame, direction: str = "dependencies", root: str = "node") -> DataFrame:
    """Nodes reachable from any root, the roots included; ends on cycles."""
    steps = cut(oriented(edges, direction))
    seen = front = cut(roots.select(F.col(root).alias("node")).distinct())
    while not front.isEmpty():
        front = cut(front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(source, target, path) for every pair joined by a path: the least of the shortest node lists.

    A source reaches itself by the path of itself alone.  Breadth first, one join a round; of the equally long
    paths into a node only the least goes on, which keeps the least overall.
    """
    steps = cut(oriented(edges, "dependencies"))
    front = cut(sources.select(F.col(node).alias("source"), F.col(node).alias("target"), F.array(node).alias("path")).distinct())
    seen = front
    while not front.isEmpty():
        tried = front.join(steps, front["target"] == steps["src"]).select("source", F.col("dst").alias("target"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(tried.groupBy("source", "target").agg(F.min("path").alias("path")).join(seen.select("source", "target"), ["source", "target"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen if targets is None else seen.join(targets.select(F.col(node).alias("target")), "target", "left_semi")


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, root) by least labels and pointer jumping; root is the least node of the component."""
    both = cut(oriented(edges, "both").where("src <> dst"))
    roots = cut(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("dst"), F.col("root").alias("got")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("got").alias("got"))
        step = cut(roots.join(near, "node").select("node", F.least("root", "got").alias("root"), F.col("root").alias("old")))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "old"))
        if step.where("root <> old").isEmpty():
            return step.select("node", "root")
        roots = step.drop("old")


#: Edges that one task joins into weakly connected parts at a time.
CHUNK_EDGES = 500_000


def rooted_chunks(schema: pa.Schema, chunk: int):
    """Append to edges the least node of their weakly connected part among ``chunk`` edges of the task."""

    def rooted(src: list, dst: list) -> pa.RecordBatch:
        up: dict = {}

        def top(n):
            up.setdefault(n, n)
            while up[n] != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        for a, b in zip(src, dst):
            if a is None or b is None:
                continue
            a, b = top(a), top(b)
            if a < b:
                up[b] = a
            elif b < a:
                up[a] = b
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((src, dst, [None if a is None or b is None else top(a) for a, b in zip(src, dst)]), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for batch in batches:
            src += batch.column(0).to_pylist()
            dst += batch.column(1).to_pylist()
            if len(src) >= chunk:
                yield rooted(src, dst)
                src, dst = [], []
        if src:
            yield rooted(src, dst)

    return run


def weak_parts(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Edges (src, dst, root), cut, with a root for each weakly connected part; null where an end is. Doubles stay.

    Each task joins the edges that it has; only the roots that some node has several of are joined by
    distributed rounds.  Edges that come from a window or join by a key that keeps parts together leave none.
    """
    kind = dict(edges.dtypes)["src"]
    shape = f"src {kind}, dst {kind}, root {kind}"
    near = cut(edges.select("src", F.col("dst").cast(kind).alias("dst")).mapInArrow(rooted_chunks(to_arrow_schema(_parse_datatype_string(shape)), chunk), shape))
    ends = near.where("root is not null").select(F.explode(F.array("src", "dst")).alias("node"), "root")
    torn = ends.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("node", "low")
    met = cut(ends.join(torn, "node").where("root <> low").select(F.col("root").alias("src"), F.col("low").alias("dst")).distinct())
    if met.isEmpty():
        return near
    final = least_labels(met).select(F.col("root").alias("final"), F.col("node").alias("root"))
    return cut(near.join(final, "root", "left").select("src", "dst", F.coalesce("final", "root").alias("root")))


def tarjan(nodes: list, successors: dict) -> list[list]:
    """Strongly connected components, without recursion."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in nodes:
        if start in index:
            continue
        work = [(start, iter(successors.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(successors.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == node:
                            break
                    out.append(part)
    return out


#: Edges of a weakly connected part up to which one task solves it; larger parts are solved by distributed rounds.
PART_EDGES = 1_000_000


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The columns of each group of rows of equal ``key``; rows are sorted by it."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = batch.to_pydict()
        keys, low = columns[key], 0
        for at in range(1, len(keys) + 1):
            if at < len(keys) and keys[at] == keys[low]:
                continue
            part = {c: v[low:at] for c, v in columns.items()}
            if held and held[key][0] == part[key][0]:
                for c, v in part.items():
                    held[c] += v
            else:
                if held:
                    yield held
                held = part
            low = at
    if held:
        yield held


def solved_parts(node: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in groups_of(batches, "root"):
            successors: dict = {}
            for a, b in sorted(zip(part["src"], part["dst"])):
                successors.setdefault(a, []).append(b)
            for c in tarjan(sorted({*part["src"], *part["dst"]}), successors):
                cyclic, least = len(c) > 1 or c[0] in successors.get(c[0], ()), min(c)
                rows += [(n, least, len(c), cyclic) for n in c]
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def coloured_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of the edges, by rounds of trimming, forward colouring and backward search.

    A node without an edge in or out is a component of its own.  Of the rest each takes the least node that
    reaches it as its colour; the nodes of a colour that reach the node it is named after are its component.
    """
    found = []
    rest = cut(edges.where("src <> dst"))
    left = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    while not rest.isEmpty():
        live = cut(rest.select(F.col("src").alias("node")).intersect(rest.select(F.col("dst").alias("node"))))
        if live.count() < left.count():
            found.append(left.join(live, "node", "left_anti").select("node", F.col("node").alias("component")))
            left, rest = live, cut(view(rest, live))
            continue
        colour = left.select("node", F.col("node").alias("colour"))
        while True:
            met = colour.select(F.col("node").alias("src"), F.col("colour").alias("got")).join(rest, "src").groupBy(F.col("dst").alias("node")).agg(F.min("got").alias("got"))
            new = cut(colour.join(met, "node", "left").select("node", F.least("colour", F.coalesce("got", "colour")).alias("colour"), F.col("colour").alias("old")))
            colour = new.select("node", "colour")
            if new.where("colour <> old").isEmpty():
                break
        of = lambda x: colour.select(F.col("node").alias(x), F.col("colour").alias(f"{x}_colour"))
        inner = cut(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        member = front = cut(colour.where("node = colour"))
        while not front.isEmpty():
            front = cut(front.select(F.col("node").alias("dst"), "colour").join(inner, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct().join(member, ["node", "colour"], "left_anti"))
            member = cut(member.unionByName(front))
        found.append(member.select("node", F.col("colour").alias("component")))
        left = cut(left.join(member, "node", "left_anti"))
        rest = cut(view(rest, left))
    found.append(left.select("node", F.col("node").alias("component")))
    return cut(reduce(DataFrame.unionByName, found))


def strong_components(nodes: DataFrame, edges: DataFrame, node: str = "node", part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component, size, cyclic): component is the least member; cyclic with several members or an edge to itself.

    Weakly connected parts of up to ``part_edges`` edges are solved by Tarjan's algorithm, many in a task;
    larger ones by distributed rounds.  Nodes without edges are components of one.
    """
    kind = dict(nodes.dtypes)[node]
    parts = weak_parts(edges).where("root is not null")
    large = cut(parts.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > part_edges).select("root"))
    schema = to_arrow_schema(_parse_datatype_string(f"{node} {kind}, component {kind}, size long, cyclic boolean"))
    small = parts.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root")
    solved = small.mapInArrow(solved_parts(node, schema), f"{node} {kind}, component {kind}, size long, cyclic boolean")
    if not large.isEmpty():
        big = cut(parts.join(large, "root", "left_semi").select("src", "dst").distinct())
        named = coloured_components(big)
        loops = big.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
        sizes = named.groupBy("component").agg(F.count("*").alias("size"))
        solved = solved.unionByName(named.join(sizes, "component").join(loops, "node", "left").select(F.col("node").alias(node), "component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic")))
    solved = cut(solved)
    alone = nodes.select(node).distinct().join(solved.select(node), node, "left_anti")
    return solved.unionByName(alone.select(node, F.col(node).alias("component"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("cyclic")))


def complete_cycles(selected: DataFrame, components: DataFrame, node: str = "node") -> DataFrame:
    """The selected nodes and all members of every cyclic component that they touch."""
    touched = components.where("cyclic").join(selected.select(node), node, "left_semi").select("component").distinct()
    return selected.select(node).unionByName(components.where("cyclic").join(touched, "component", "left_semi").select(node)).distinct()


def view(edges: DataFrame, selected: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends selected."""
    left = selected.select(F.col(node).alias("src")).distinct()
    return edges.join(left, "src", "left_semi").join(left.select(F.col("src").alias("dst")), "dst", "left_semi")


def stable_ids(nodes: DataFrame, *order: Column, letter: str = "n") -> DataFrame:
    """Append ``id``: letter and position in the whole order, from 0, so that filters don't change it."""
    return with_position(nodes, *order, name="__pos__").withColumn("id", node_id(F.col("__pos__") - 1, letter)).drop("__pos__")


def suggestions(requests: DataFrame, names: DataFrame, n: int = 3, request: str = "request", name: str = "name") -> DataFrame:
    """For each request the ``n`` names of least edit distance, ties by name; exact hits have distance 0.

    Two names are as far apart as their lengths at least.  So a request meets names of about its own length by
    equi-join, and those of other lengths in later rounds, only as long as they could be among its nearest.
    """
    asked = cut(requests.select(request).distinct().withColumn("__long__", F.length(request)))
    known = cut(names.select(name).distinct().withColumn("__long__", F.length(name)))
    lengths = [r[0] for r in known.select("__long__").distinct().collect()]
    found, todo, off, to = None, asked, 0, 4
    far = max([abs(a - b) for a in lengths for b in [r[0] for r in asked.select("__long__").distinct().collect()]], default=-1)
    while off <= far:
        sides = todo.withColumn("__long__", F.explode(F.array_distinct(F.concat(*[F.array(F.col("__long__") - k, F.col("__long__") + k) for k in range(off, to)]))))
        near = sides.join(known, "__long__").select(request, name, F.levenshtein(F.col(request), F.col(name)).cast("long").alias("distance"))
        found = near if found is None else found.unionByName(near)
        best = found.withColumn("position", F.row_number().over(Window.partitionBy(request).orderBy("distance", name))).where(F.col("position") <= n)
        found = cut(best.select(request, name, "distance"))
        off, to = to, 3 * to
        # Those whose worst kept distance is under the least that is left are done.
        done = found.groupBy(request).agg(F.count("*").alias("n"), F.max("distance").alias("worst")).where((F.col("n") == n) & (F.col("worst") < off))
        todo = cut(todo.join(done.select(request), request, "left_anti"))
        if todo.isEmpty():
            break
    if found is None:
        return asked.join(known.select(name), F.lit(False)).select(request, name, F.lit(0).cast("long").alias("distance"), F.lit(0).alias("position"))
    return found.withColumn("position", F.row_number().over(Window.partitionBy(request).orderBy("distance", name)))


def hierarchy(members: DataFrame, segments: Column, member: str) -> DataFrame:
    """(group, parent, depth, direct, descendants) for every prefix of the members' segments."""
    rows = members.select(F.col(member).alias("member"), segments.alias("s")).where(F.size("s") > 0)
    prefix = rows.select("member", F.size("s").alias("full"), F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.slice("s", F.lit(1), i))).alias("p"))
    named = prefix.select(F.array_join("p", "/").alias("group"), F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/")).alias("parent"), F.size("p").cast("long").alias("depth"), (F.size("p") == F.col("full")).alias("own"))
    return named.groupBy("group", "parent", "depth").agg(F.count_if("own").alias("direct"), F.count("*").alias("descendants"))


