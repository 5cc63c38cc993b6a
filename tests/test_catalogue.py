"""Registered queries against their SQL in DuckDB, and those without SQL against brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loam.operators import graph
from loam.plans.catalogue import ORACLES, QUERIES
from loam.sources.lines import LEXERS

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert got == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=str)


def plain_lines(data: bytes, c: bool) -> tuple[int, int, int, int]:
    """(total, source, comment, blank), one byte at a time."""
    kind, i = [0] * len(data), 0

    def mark(end: int, what: int) -> int:
        end = min(end, len(data))
        kind[i:end] = [what] * (end - i)
        return end

    while i < len(data):
        byte = data[i : i + 1]
        if c and data[i : i + 2] == b"/*":
            depth, j = 1, i + 2
            while depth and j < len(data):
                two = data[j : j + 2]
                depth += (two == b"/*") - (two == b"*/")
                j += 2 if two in (b"/*", b"*/") else 1
            i = mark(j, 1)
            continue
        if (data[i : i + 2] == b"//") if c else byte == b"#":
            j = i
            while j < len(data) and data[j] != 10:
                j += 1
            i = mark(j, 1)
            continue
        close = None
        if c and byte == b"r":
            j = i + 1
            while data[j : j + 1] in (b"r", b"#"):
                j += 1
            if data[j : j + 1] == b'"':
                close = (j + 1, b'"' + data[i + 1 : j])
        if c and data[i : i + 2] == b'R"':
            j = i + 2
            while j < len(data) and data[j] not in b" \t\n\f\r()" and j - i - 2 < 16:
                j += 1
            if data[j : j + 1] == b"(":
                close = (j + 1, b")" + data[i + 2 : j] + b'"')
        if close:
            j = close[0]
            while j < len(data) and data[j : j + len(close[1])] != close[1]:
                j += 1
            i = mark(j + len(close[1]), 2)
            continue
        if byte in (b"'", b'"'):
            quote = byte * 3 if not c and data[i : i + 3] == byte * 3 else byte
            j = i + len(quote)
            while j < len(data) and data[j : j + len(quote)] != quote:
                j += 2 if data[j] == 0x5C else 1
            i = mark(j + len(quote), 2)
            continue
        i = mark(i + 1, 0 if data[i] in b" \t\n\f\r" else 2)
    lines, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at) + 1 or len(data)
        lines.append(max(kind[at:end]))
        at = end
    return len(lines), lines.count(2), lines.count(1), lines.count(0)


def test_lexed_lines_match_a_plain_reading(spark, small):
    got = {(r["doc_id"], r["language"]): tuple(r)[2:] for r in QUERIES["lexer_line_kinds"](spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert got == {(k, lang): plain_lines(t.encode(), lang == "c") for k, t in texts.items() if t is not None for lang in ("python", "c")}
    assert all(total == source + comment + blank for total, source, comment, blank in got.values())


def test_lexers_match_a_plain_reading_of_any_bytes():
    import random

    rng = random.Random(1)
    parts = [b"'", b'"', b'"""', b"'''", b"#", b"//", b"/*", b"*/", b"\\", b"\n", b" ", b"r", b'r#"', b'R"x(', b')x"', b'"#', b"a", b"\t", b"/"]
    for _ in range(4000):
        data = b"".join(rng.choices(parts, k=rng.randrange(1, 25)))
        assert LEXERS["python"](data) == plain_lines(data, False) and LEXERS["c"](data) == plain_lines(data, True), data


def test_cuts_leave_no_cycle(spark, small):
    from loam.plans import catalogue

    edges = {tuple(r) for r in catalogue.succession(lambda n: spark.read.parquet(f"{small}/{n}.parquet")).collect()}
    explained = QUERIES["cycle_explanations"](spark, small).collect()
    cuts = {tuple(map(int, c.split(">"))) for r in explained for c in r["cuts"].split(",")}
    assert cuts <= edges
    rest: dict = {}
    for a, b in edges - cuts:
        rest.setdefault(a, []).append(b)
    assert all(len(c) == 1 for c in graph.tarjan(sorted({x for e in edges for x in e}), rest))
    for r in explained:
        walk = list(map(int, r["witness"].split(">")))
        assert walk[0] == walk[-1] and all(e in edges for e in zip(walk, walk[1:]))


def test_strong_components_of_large_parts_match_those_of_small_ones(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(90), rng.randrange(90)) for _ in range(110)} | {(k, k + 1) for k in range(100, 130)} | {(130, 118), (104, 104), (200, 201)}
    nodes = spark.createDataFrame([(k,) for k in range(205)], "node long")
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    rest: dict = {}
    for a, b in sorted(edges):
        rest.setdefault(a, []).append(b)
    want = {n: (min(c), len(c), len(c) > 1 or n in rest.get(n, ())) for c in graph.tarjan(range(205), rest) for n in c}
    for limit in (0, 5, 1000):
        got = {r["node"]: tuple(r)[1:] for r in graph.strong_components(nodes, df, part_edges=limit).collect()}
        assert got == want, limit
    named = df.select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"))
    assert graph.strong_components(nodes.select(F.concat(F.lit("n"), "node").alias("node")), named).where("cyclic").count() == sum(c for _, _, c in want.values())


def test_explanations_are_shortest_and_number_their_components(spark):
    """Against all closed walks of a small graph, and the greedy order's cuts."""
    from itertools import permutations

    from loam.operators import cycles

    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("b", "a", 1), ("d", "e", 1), ("e", "f", 3), ("f", "d", 1), ("x", "x", 1), ("c", "d", 1)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    nodes = spark.createDataFrame([(n,) for n in "abcdefxyz"], "node string")
    got = cycles.explain_cycles(graph.strong_components(nodes, df), df).orderBy("number").collect()
    there = {(a, b) for a, b, _ in edges}
    assert [(r["number"], r["component"], r["members"]) for r in got] == [(1, "a", ["a", "b", "c"]), (2, "d", ["d", "e", "f"]), (3, "x", ["x"])]
    for r in got:
        walks = [[*w, w[0]] for n in range(1, 4) for w in permutations(r["members"], n) if all(e in there for e in zip(w, [*w[1:], w[0]]))]
        assert r["witness"] == min(walks, key=lambda w: (len(w), w))
        left = there - {tuple(c) for c in r["cuts"]}
        assert not [w for n in range(1, 4) for w in permutations(r["members"], n) if all(e in left for e in zip(w, [*w[1:], w[0]]))]


def test_suggestions_are_the_nearest_of_all_names(spark):
    names = ["a", "ab", "abc", "abcd", "xyz", "abcdefghijkl", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "abd", "b"]
    asked = ["abc", "", "abcdefghijklm", "q" * 29]

    def far(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    for n in (1, 3, 20):
        got = graph.suggestions(spark.createDataFrame([(a,) for a in asked], "request string"), spark.createDataFrame([(x,) for x in names], "name string"), n)
        want = {(a, x, d, k) for a in asked for k, (d, x) in enumerate(sorted((far(a, x), x) for x in names)[:n], 1)}
        assert {(r["request"], r["name"], r["distance"], r["position"]) for r in got.collect()} == want
    assert graph.suggestions(spark.createDataFrame([("a",)], "request string"), spark.createDataFrame([], "name string")).count() == 0


def test_lookups_do_not_carry_the_targets_of_a_name_to_its_requests(spark):
    from loam.operators import resolve

    held = spark.range(300).select(F.lit("all").alias("name"), "id").unionByName(spark.createDataFrame([("one", 7), ("one", 7), ("none", None)], "name string, id long"))
    asked = spark.createDataFrame([(1, ["gone", "all", "one"]), (2, ["one", "all"]), (3, ["gone"]), (4, ["none"])], "k long, names array<string>")
    found = resolve.by_priority(asked, ["k"], F.col("names"), held, "name", "id")
    got = {r["k"]: (r["hit_name"], r["n_targets"], r["target"], r["kind"]) for r in found.collect()}
    assert got == {1: ("all", 300, 0, "ambiguous"), 2: ("one", 1, 7, "exact"), 3: (None, 0, None, "unresolved"), 4: ("none", 0, None, "ambiguous")}
    assert "collect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_parts_and_closures_match_a_plain_search_however_the_edges_lie(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(70, 90)] + [(90, 80), (95, 95), (70, 71)]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reached(n, steps):
        seen, todo = set(), list(steps.get(n, ()))
        while todo:
            if (m := todo.pop()) not in seen:
                seen.add(m)
                todo += steps.get(m, ())
        return seen

    both: dict = {}
    for a, b in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    for chunk in (7, 1000):
        assert {r["src"]: r["root"] for r in graph.weak_parts(df, chunk).collect()} == {a: min(reached(a, both) | {a}) for a in near}, chunk
    want = sorted((a, b) for a in near for b in reached(a, near))
    for limit in (12, 1000):
        assert sorted(map(tuple, graph.closure(df, part_edges=limit).collect())) == want, limit
    assert sorted(map(tuple, graph.closure(df, "dependents").collect())) == sorted((b, a) for a, b in want)
    odd = spark.createDataFrame([(None, 1), (1, 2), (2, None)], "src long, dst long")
    assert sorted(map(tuple, graph.closure(odd).collect()), key=str) == sorted([(None, 1), (None, 2), (1, 2), (2, None), (1, None), (None, None)], key=str)


def test_parts_that_lie_together_take_no_rounds(spark, monkeypatch):
    from loam.plans import catalogue

    monkeypatch.setattr(graph, "least_labels", lambda edges: pytest.fail("edges of one customer are in one task"))
    monkeypatch.setattr(graph, "squared", lambda edges: pytest.fail("small parts are solved in tasks"))
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    assert catalogue.graph_closure(t).count() > catalogue.succession(t).count()
    assert graph.strong_components(catalogue.order_nodes(t), catalogue.succession_rows(t), part_edges=50).count() == t("orders").count()
