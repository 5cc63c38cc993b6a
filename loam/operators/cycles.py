"""Cycle explanations: a shortest closed walk and a small weighted set of edges to cut, one component a task."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loam.operators.graph import groups_of
from loam.operators.review import with_position


def shortest_cycle(successors: dict) -> list:
    """The least of the shortest closed walks, first node repeated at the end; empty without a cycle."""
    best: list = []
    for start in sorted(successors):
        if best and len(best) == 2:
            break
        if start in successors[start]:
            return [start, start]
        before = {start: None}
        queue = deque([(start, 0)])
        found = None
        while queue and found is None:
            node, depth = queue.popleft()
            if best and depth + 2 >= len(best) + 1:
                break
            for nxt in successors.get(node, ()):
                if nxt == start:
                    found = node
                    break
                if nxt not in before:
                    before[nxt] = node
                    queue.append((nxt, depth + 1))
        if found is not None:
            walk = [start]
            while found is not None:
                walk.append(found)
                found = before[found]
            walk.reverse()
            if not best or (len(walk), walk) < (len(best), best):
                best = walk
    return best


def feedback_edges(members: list, weights: dict[tuple, int]) -> list[tuple]:
    """Edges against a greedy order: sinks go last, sources first, else the node of most out- less in-weight, least on ties."""
    outward: dict = {m: {} for m in members}
    inward: dict = {m: {} for m in members}
    for (a, b), w in weights.items():
        outward[a][b] = w
        inward[b][a] = w
    rest, first, last = set(members), [], []

    def drop(node) -> None:
        rest.discard(node)
        for b in outward[node]:
            inward[b].pop(node, None)
        for a in inward[node]:
            outward[a].pop(node, None)

    while rest:
        if sinks := sorted(n for n in rest if not outward[n]):
            for n in sinks[:1]:
                last.append(n)
                drop(n)
        elif sources := sorted(n for n in rest if not inward[n]):
            first.append(sources[0])
            drop(sources[0])
        else:
            node = min(rest, key=lambda n: (sum(inward[n].values()) - sum(outward[n].values()), n))
            first.append(node)
            drop(node)
    place = {n: k for k, n in enumerate([*first, *reversed(last)])}
    return sorted(e for e in weights if place[e[0]] >= place[e[1]])


def explain_cycles(components: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """For each cyclic component: its number in order of least members, members, witness walk and edges to cut.

    ``edges`` may have a ``weight`` (number of evidences, 1 at least).  Cutting the edges leaves no cycle.
    """
    cyclic = components.where("cyclic").select(F.col(node).alias("src"), "component")
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(1)), F.lit(1)) if "weight" in edges.columns else F.lit(1)
    inner = edges.select("src", "dst", weight.cast("long").alias("weight")).join(cyclic, "src").join(cyclic.withColumnsRenamed({"src": "dst", "component": "other"}), "dst").where("component = other")
    kind = dict(components.dtypes)[node]

    schema = to_arrow_schema(_parse_datatype_string(f"component {kind}, members array<{kind}>, witness array<{kind}>, cuts array<array<{kind}>>"))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_of(batches, "component"):
            weights: dict[tuple, int] = {}
            for a, b, w in zip(part["src"], part["dst"], part["weight"]):
                weights[a, b] = weights.get((a, b), 0) + w
            successors: dict = {}
            for a, b in sorted(weights):
                successors.setdefault(a, []).append(b)
            members = sorted({n for e in weights for n in e})
            row = {"component": part["component"][0], "members": members, "witness": shortest_cycle(successors), "cuts": [list(c) for c in feedback_edges(members, weights)]}
            yield pa.RecordBatch.from_pylist([row], schema)

    made = inner.select("component", "src", "dst", "weight").repartition("component").sortWithinPartitions("component").mapInArrow(explain, f"component {kind}, members array<{kind}>, witness array<{kind}>, cuts array<array<{kind}>>")
    return with_position(made, F.col("component"), name="number")
