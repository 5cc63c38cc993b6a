"""Registered queries over the driver tables, with their SQL.

The tables hold no source code, so the operators run on what they have alike: documents stand for files,
labels for documentation status, lines of an order for symbols, and the succession of a customer's orders
(with a way back from urgent ones) for a dependency graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam import ready
from loam.functions import scalars as S
from loam.operators import coverage as C
from loam.operators import cycles, graph, inventory, resolve, review
from loam.sources.lines import line_counts
from loam.sources.rules import DEFAULT_RULES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


EXTENSIONS = (".py", ".RS", ".md", ".csv", ".png", ".toml", ".h", "")
PATHS_SQL = "select *, concat_ws('/', source, lang, 'doc' || doc_id || (array[{}])[doc_id % 8 + 1]) as path from documents".format(", ".join(f"'{e}'" for e in EXTENSIONS))
EXT_SQL = "coalesce(nullif(lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]+)$', 1)), ''), '[none]')"
CATEGORY_SQL = f"case when {EXT_SQL} in ('py', 'rs', 'h') then 'source' when {EXT_SQL} = 'md' then 'documentation' when {EXT_SQL} = 'csv' then 'data' when {EXT_SQL} = 'png' then 'assets' else 'uncategorized' end"
LANGUAGE_SQL = f"case {EXT_SQL} when 'py' then 'python' when 'rs' then 'rust' end"


def paths(t) -> DataFrame:
    ends = F.array(*map(F.lit, EXTENSIONS))
    return t("documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc"), "doc_id", F.get(ends, (F.col("doc_id") % 8).cast("int")))))


def classified(t) -> DataFrame:
    docs = paths(t).select("path")
    return inventory.classify(docs, inventory.rules_frame(docs.sparkSession, DEFAULT_RULES))


SUCCESSION_SQL = """
succession as (
  select o_orderkey as node, o_orderpriority as priority,
    lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next from orders),
edges as (
  select node as src, next as dst from succession where next is not null
  union select next, node from succession where next is not null and priority = '1-URGENT')"""


def succession_rows(t) -> DataFrame:
    """The edges of ``succession``, those of a customer together; an order key that rows share may double some."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ends = t("orders").select(F.col("o_orderkey").alias("a"), "o_orderpriority", F.lead("o_orderkey").over(by).alias("b")).where("b is not null")
    there, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    return ends.select(F.explode(F.when(F.col("o_orderpriority") == "1-URGENT", F.array(there, back)).otherwise(F.array(there))).alias("e")).select("e.src", "e.dst")


def succession(t) -> DataFrame:
    """Edges from every order to the customer's next, and back where the earlier one was urgent."""
    return succession_rows(t).distinct()


def order_nodes(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("node"))


def joined(c: str, sep: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


@query(f"with p as ({PATHS_SQL}) select c.category, count(p.path) as n from (values ('source'), ('documentation'), ('configuration'), ('data'), ('assets'), ('uncategorized')) c(category) left join p on {CATEGORY_SQL} = c.category group by 1")
def inventory_category_counts(t):
    return inventory.category_counts(classified(t))


@query(f"with p as ({PATHS_SQL}), q as (select {LANGUAGE_SQL} as language, n_chars from p) select language, grouping(language) = 1 as is_total, count(*) as files, sum(n_chars)::bigint as chars from q where language is not null group by rollup (language)")
def inventory_language_rollup(t):
    return inventory.language_totals(paths(t), chars=F.col("n_chars")).select("language", "is_total", "files", "chars")


@query(f"with p as ({PATHS_SQL}) select {EXT_SQL} as extension, count(*) as n from p where {CATEGORY_SQL} = 'uncategorized' group by 1")
def uncategorized_extensions(t):
    return inventory.uncategorized_extensions(classified(t))


@query("""
with l as (select doc_id, case when text = '' then []::varchar[] when text like '%' || chr(10) then list_slice(string_split(text, chr(10)), 1, -2) else string_split(text, chr(10)) end as lines from documents where text is not null)
select doc_id, len(lines) as total, len(list_filter(lines, lambda x: not regexp_matches(x, '[^ \\t\\n\\f\\r]'))) as blank from l
""")
def physical_lines(t):
    return inventory.blank_line_counts(t("documents").where("text is not null")).select("doc_id", "total", "blank")


@query()
def lexer_line_kinds(t):
    """Lines of every document by kind, read as Python and as C."""
    docs = t("documents").where("text is not null")
    both = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"), F.explode(F.array(F.lit("python"), F.lit("c"))).alias("language"))
    return line_counts(both, "doc_id", "bytes", "language")


@query(f"with p as ({PATHS_SQL}) select path from p where regexp_full_match(path, '.*/en/doc[0-9]+[.]py') or regexp_full_match(path, 'src1/.*')")
def match_selection(t):
    p = F.col("path")
    return paths(t).where(S.full_match(p, ".*/en/doc[0-9]+[.]py") | S.full_match(p, "src1/.*")).select("path")


TESTED_SQL = "select replace(replace(path, '/doc', case when doc_id % 3 = 0 then '/test_doc' else '/doc' end), '/de/', '/tests/') as path from p"


@query(f"with p as ({PATHS_SQL}), q as ({TESTED_SQL}) select path, list_contains(string_split(path, '/'), 'tests') or regexp_matches(path, '/test_[^/]*$') or regexp_matches(path, '_test[.]py$') as is_test from q")
def test_path_filter(t):
    moved = F.replace(F.replace("path", F.lit("/doc"), F.when(F.col("doc_id") % 3 == 0, "/test_doc").otherwise("/doc")), F.lit("/de/"), F.lit("/tests/"))
    return paths(t).select(moved.alias("path")).select("path", S.is_test_path(F.col("path")).alias("is_test"))


@query(f"with p as ({PATHS_SQL}) select path from p a where not exists (select 1 from labels l where l.doc_id = a.doc_id)")
def ignored_anti_join(t):
    docs = paths(t)
    return inventory.ignored(docs.select("path"), docs.join(t("labels").select("doc_id"), "doc_id", "left_semi").select("path"))


@query(f"with p as ({PATHS_SQL}), std as (select path from p where doc_id in (select doc_id from labels)), inc as (select path from p where lang = 'en') select path, false as included_ignored from std union select path, true from inc where path not in (select path from std)")
def include_union(t):
    docs = paths(t)
    standard = docs.join(t("labels").select("doc_id").distinct(), "doc_id", "left_semi").select("path").distinct()
    return inventory.reinclude(standard, docs.where("lang = 'en'").select("path"))


COVERAGE_SQL = """
with i as (select d.source, d.lang, case l.quality when 1 then 'documented' when 0 then 'missing' else 'unavailable' end as s from documents d left join labels l using (doc_id)),
g as (select {what}, count(*) as eligible, count(*) filter (s = 'documented') as documented, count(*) filter (s = 'missing') as missing, count(*) filter (s = 'unavailable') as unavailable from i group by {by})
select {names}, eligible, documented, missing, unavailable, case when documented + missing > 0 then documented * 10000 // (documented + missing) end as basis_points,
  case when documented + missing > 0 then (documented * 10000 // (documented + missing) // 100)::varchar || '.' || lpad((documented * 10000 // (documented + missing) % 100)::varchar, 2, '0') || '%' end as percent,
  case when documented + missing > 0 and unavailable = 0 then documented * 100 >= 80 * (documented + missing) end as met from g
"""


def labelled(t) -> DataFrame:
    return t("documents").select("doc_id", "source", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


def status() -> Column:
    return F.when(F.col("quality") == 1, "documented").when(F.col("quality") == 0, "missing")


@query(COVERAGE_SQL.format(what="source", by="source", names="source"))
def coverage_counts_by_source(t):
    return C.coverage(labelled(t), status(), "source").where("grouping = 'source'").drop("grouping").withColumnRenamed("key", "source")


@query(COVERAGE_SQL.format(what="case when grouping(source) = 0 then 'source' when grouping(lang) = 0 then 'lang' else 'total' end as grouping, coalesce(source, lang) as key", by="grouping sets ((source), (lang), ())", names="grouping, key"))
def coverage_grouping_sets(t):
    return C.coverage(labelled(t), status(), "source", "lang")


@query("""
with c as (select *, max((turn % 2 = 0)::int) over w as any_over, row_number() over (partition by conv_id, role order by case when turn % 2 = 1 then 0 when length(text) > 400 then 1 when length(text) < 100 then 2 else 3 end, turn, text) as place
  from conversations window w as (partition by conv_id, role))
select conv_id, role, turn from c where any_over = 0 or place = 1
""")
def overload_collapse(t):
    size = F.length("text")
    state = F.when(size > 400, "documented").when(size < 100, "unavailable").otherwise("missing")
    return C.collapse_groups(t("conversations"), ["conv_id", "role"], F.col("turn") % 2 == 0, state, F.col("turn"), F.col("text")).select("conv_id", "role", "turn")


BAND_SQL = "case when score >= 21 then 'critical' when score >= 11 then 'high' when score >= 6 then 'moderate' else 'low' end"
SCORES_SQL = "select o_orderkey as item, case when count(l_linenumber) > 0 then 1 + count(l_linenumber) filter (l_quantity > 10) + count(l_linenumber) filter (l_discount > 0.05) end as score from orders left join lineitem on l_orderkey = o_orderkey group by 1"


def order_scores(t) -> DataFrame:
    """Every order as a callable: 1 and a decision for each large line and each discounted one; none without lines."""
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("item")).agg((1 + F.count_if(F.col("l_quantity") > 10) + F.count_if(F.col("l_discount") > 0.05)).alias("score"))
    return t("orders").select(F.col("o_orderkey").alias("item")).join(per, "item", "left")


@query(f"with s as ({SCORES_SQL}) select item, score, row_number() over (order by score desc, item) as position, {BAND_SQL} as risk, score >= 11 as needs_review from s where score is not null")
def complexity_ranking(t):
    return review.complexity_ranking(order_scores(t), "item", "score").select("item", "score", "position", "risk", "needs_review")


EXCEPTIONS_SQL = "select o_orderkey as item, case when o_orderpriority = '2-HIGH' then 9 end as approved_max from orders where o_orderpriority in ('1-URGENT', '2-HIGH')"
FINDINGS_SQL = f"""
with s as ({SCORES_SQL}), e as ({EXCEPTIONS_SQL}),
b as (select s.*, e.item is not null and (approved_max is null or score <= approved_max) as fine from s left join e using (item)),
f as (select 'complexity-threshold' as rule_id, item, score as observed, case when score >= 11 and not fine then 11 else 8 end as threshold, 'score' as unit, {BAND_SQL} as risk,
  case when fine then 'none' when score >= 11 then 'block' else 'human-review' end as action, fine as acknowledged from b where score >= 8
  union all select 'complexity-unavailable', item, score, null, 'score', 'unknown', 'human-review', false from b where score is null)
"""


def order_findings(t) -> DataFrame:
    allowed = t("orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderpriority") == "2-HIGH", 9).cast("long").alias("approved_max"))
    return review.findings(order_scores(t), "item", "score", 8, 11, allowed)


@query(FINDINGS_SQL + "select *, row_number() over (order by case action when 'block' then 2 when 'human-review' then 1 else 0 end desc, case risk when 'unknown' then 4 when 'critical' then 3 when 'high' then 2 when 'moderate' then 1 else 0 end desc, item nulls first, rule_id) as position from f")
def review_findings(t):
    return review.with_position(order_findings(t), *review.finding_order())


@query(FINDINGS_SQL + "select case max(case action when 'block' then 2 when 'human-review' then 1 else 0 end) when 2 then 'blocked' when 1 then 'human-review-required' else 'pass' end as status, case max(case action when 'block' then 2 when 'human-review' then 1 else 0 end) when 2 then 3 when 1 then 2 else 0 end as exit_code, count(*) as findings, count(*) filter (acknowledged) as acknowledged from f")
def gate_status(t):
    return review.gate_status(order_findings(t))


@query("""
with m as (select o_orderkey as item, o_orderpriority as prio, unnest(['lines', 'quantity', 'parts']) as metric, unnest([n, q, p]) as value from
  (select o_orderkey, o_orderpriority, count(l_linenumber) as n, coalesce(sum(l_quantity), 0)::bigint as q, count(distinct l_partkey) as p from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2))
select metric, item, value, row_number() over (partition by metric order by value desc, item) as position from m qualify position <= 3
""")
def top3_per_metric(t):
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.countDistinct("l_partkey").alias("parts"))
    wide = t("orders").select("o_orderkey").join(per, "o_orderkey", "left").na.fill(0, ["lines", "quantity", "parts"])
    long = wide.unpivot(["o_orderkey"], ["lines", "quantity", "parts"], "metric", "value").withColumnRenamed("o_orderkey", "item")
    return review.top_per(long, "metric", 3, F.col("value").desc(), F.col("item"))


@query("""
select s_nationkey as source, p_brand as target, l_returnflag as kind, count(*) as n,
  string_agg(l_orderkey::varchar || ':' || l_linenumber::varchar || ':' || l_shipdate::date::varchar, ',' order by l_orderkey, l_linenumber, l_shipdate) as evidence
from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1, 2, 3
""")
def dep_relations_evidence(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", F.col("l_returnflag").alias("kind"))
    sides = lines.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source")), "l_suppkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("target")), "l_partkey")
    found = graph.relations(sides, "source", "target", "kind", "l_orderkey", "l_linenumber", "l_shipdate")
    text = F.transform("evidence", lambda e: F.concat_ws(":", e["l_orderkey"].cast("string"), e["l_linenumber"].cast("string"), F.to_date(e["l_shipdate"]).cast("string")))
    return found.select("source", "target", "kind", F.size("evidence").cast("long").alias("n"), F.array_join(text, ",").alias("evidence"))


@query("""
with e as (select distinct l_suppkey as src, l_partkey as dst from lineitem)
select s_suppkey as node, 'supplier' as kind, 0::bigint as fan_in, (select count(*) from e where src = s_suppkey) as fan_out from supplier
union all select p_partkey, 'part', (select count(*) from e where dst = p_partkey), 0 from part
""")
def fan_metrics(t):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = t("lineitem").select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))
    nodes = t("supplier").select(name("s", "s_suppkey").alias("node")).unionByName(t("part").select(name("p", "p_partkey").alias("node")))
    found = graph.fan_metrics(nodes, edges)
    return found.select(F.substring("node", 2, 20).cast("long").alias("node"), F.when(F.col("node").startswith("s"), "supplier").otherwise("part").alias("kind"), "fan_in", "fan_out")


@query("""
with r as (select c_custkey, c_nationkey from customer), s as (select s_nationkey as k, count(distinct s_suppkey) as n from supplier group by 1),
x as (select c_custkey, case when coalesce(n, 0) = 1 then 'exact' when coalesce(n, 0) > 1 then 'ambiguous' when c_nationkey in (select n_nationkey from nation where n_regionkey = 0) then 'exact' else 'unresolved' end as kind from r left join s on k = c_nationkey)
select count(*) as total, count(*) filter (kind = 'exact') as exact, count(*) filter (kind = 'ambiguous') as ambiguous, count(*) filter (kind = 'unresolved') as unresolved from x
""")
def resolution_coverage(t):
    local = resolve.grouped(t("supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").cast("string").alias("target")), "name", "target")
    outside = resolve.grouped(t("nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("target")), "name", "target")
    key = F.col("c_nationkey")
    return resolve.outcome_counts(resolve.resolve(t("customer").select("c_custkey", "c_nationkey"), [(key, local, "local"), (key, outside, "outside")], F.lit("not-found")))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def import_binding_last_wins(t):
    return resolve.last_binding(t("events").select("user_id", "event_type", "event_id", "value", "ts"), "user_id", "event_type", "ts", "event_id").drop("ts")


@query("""
with want as (select c_custkey, c_mktsegment, unnest(generate_series(1, 3)) as priority, unnest([c_mktsegment || ':' || c_nationkey, c_mktsegment || ':' || (c_nationkey + 1) % 25, c_mktsegment]) as name from customer),
cat as (select p_brand as v, 'BUILDING:' || p_size % 25 as name, p_partkey from part union all select p_type, 'MACHINERY', p_partkey from part),
hit as (select c_custkey, want.name, priority, count(distinct p_partkey) as n, min(p_partkey) as least from want join cat using (name) group by 1, 2, 3 qualify row_number() over (partition by c_custkey order by priority) = 1)
select c.c_custkey, hit.name as hit_name, coalesce(n, 0) as n_targets, case when n is null then 'unresolved' when n = 1 then 'exact' else 'ambiguous' end as kind from customer c left join hit using (c_custkey)
""")
def call_priority_lookup(t):
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    names = F.array(F.concat_ws(":", seg, nation.cast("string")), F.concat_ws(":", seg, ((nation + 1) % 25).cast("string")), seg)
    part = t("part")
    catalogue = part.select(F.concat(F.lit("BUILDING:"), (F.col("p_size") % 25).cast("string")).alias("name"), "p_partkey").unionByName(part.select(F.lit("MACHINERY").alias("name"), "p_partkey"))
    found = resolve.by_priority(t("customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_custkey"], names, catalogue, "name", "p_partkey")
    return found.select("c_custkey", "hit_name", "n_targets", "kind")


SEEDS_SQL = "select o_orderkey as node from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1"


def seeds(t) -> DataFrame:
    """Every customer's first order."""
    return t("orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("node")).select("node")


@query(f"""
with recursive {SUCCESSION_SQL.strip()}, steps as (select src, dst from edges union select dst, src from edges),
near as (select node, 0 as depth from ({SEEDS_SQL}) union select dst, depth + 1 from near join steps on src = node where depth < 4)
select node, min(depth) as depth from near group by node
""")
def graph_neighbourhood(t):
    return graph.neighbourhood(succession(t), seeds(t), 4)


CLOSURE_SQL = f"with recursive {SUCCESSION_SQL.strip()}, reach as (select src as root, dst as node from edges union select root, dst from reach join edges on src = node)"


@query(CLOSURE_SQL + " select root, node from reach")
def graph_closure(t):
    return graph.closure(succession_rows(t))


@query(f"with recursive {SUCCESSION_SQL.strip()}, reach as (select node from ({SEEDS_SQL}) union select src from reach join edges on dst = node) select node from reach")
def graph_closure_reverse(t):
    return graph.closure_of(succession(t), seeds(t), "dependents")


@query(f"""
with recursive {SUCCESSION_SQL.strip()}, walks as (
  select node as source, node as target, [node] as path from ({SEEDS_SQL})
  union all select source, dst, path || [dst] from walks join edges on src = target where not list_contains(path, dst))
select source, target, array_to_string(arg_min(path, (len(path), path)), '>') as path from walks group by all
""")
def graph_shortest_path(t):
    return graph.shortest_paths(succession(t), seeds(t)).select("source", "target", joined("path", ">").alias("path"))


SCC_SQL = CLOSURE_SQL + ", mutual as (select a.root as node, a.node as other from reach a join reach b on a.root = b.node and a.node = b.root), scc as (select o_orderkey as node, least(o_orderkey, coalesce(min(other), o_orderkey)) as component, count(other) > 0 as cyclic from orders left join mutual on node = o_orderkey group by 1)"


def components(t) -> DataFrame:
    return graph.strong_components(order_nodes(t), succession_rows(t))


@query(SCC_SQL + " select node, component, count(*) over (partition by component) as size, cyclic from scc")
def graph_scc(t):
    return components(t)


@query(SCC_SQL + f", s as ({SEEDS_SQL}) select node from s union select node from scc where cyclic and component in (select component from scc join s using (node))")
def cycle_view_completion(t):
    return graph.complete_cycles(seeds(t), components(t))


@query()
def cycle_explanations(t):
    made = cycles.explain_cycles(components(t), succession(t))
    return made.select("number", "component", joined("members").alias("members"), joined("witness", ">").alias("witness"), F.array_join(F.transform("cuts", lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ">")), ",").alias("cuts"))


@query(f"""
with p as ({PATHS_SQL}), s as (select string_split(path, '/')[1:2] as seg, path from p), g as (select array_to_string(seg[1:i], '/') as "group", case when i > 1 then array_to_string(seg[1:i - 1], '/') end as parent, i as depth, i = len(seg) as own from s, unnest(generate_series(1, len(seg))) u(i))
select "group", parent, depth, count(*) filter (own) as direct, count(*) as descendants from g group by all
""")
def package_hierarchy(t):
    return graph.hierarchy(paths(t), F.slice(F.split("path", "/"), 1, 2), "path")


@query("select request, name, levenshtein(request, name) as distance, row_number() over (partition by request order by levenshtein(request, name), name) as position from (select distinct upper(p_name) as request from part), (select distinct n_name as name from nation) qualify position <= 3")
def did_you_mean(t):
    return graph.suggestions(t("part").select(F.upper("p_name").alias("request")), t("nation").select(F.col("n_name").alias("name")))


@query(f"""
with p as ({PATHS_SQL}), m as (select doc_id, path, replace(regexp_replace(path, '[.][^./]*$', ''), '/', '.') as module, (doc_id % 4)::int as level, lang as name, doc_id % 5 = 0 as package from p),
q as (select *, case when package then string_split(module, '.') else string_split(module, '.')[1:-2] end as pkg from m)
select doc_id, module, level, case when level = 0 then name when len(pkg) - level + 1 > 0 then array_to_string(pkg[1:len(pkg) - level + 1] || [name], '.') end as requested from q
""")
def relative_import(t):
    m = paths(t).select("doc_id", F.replace(F.regexp_replace("path", "[.][^./]*$", ""), F.lit("/"), F.lit(".")).alias("module"), (F.col("doc_id") % 4).cast("int").alias("level"), "lang")
    return m.select("doc_id", "module", "level", S.requested_module(F.col("module"), F.col("doc_id") % 5 == 0, F.col("level"), F.col("lang")).alias("requested"))


@query("select p_partkey, printf('n%04d', (row_number() over (order by p_brand, p_partkey) - 1)::int) as id from part")
def stable_node_ids(t):
    return graph.stable_ids(t("part").select("p_partkey", "p_brand"), F.col("p_brand"), F.col("p_partkey")).select("p_partkey", "id")


@query("select s_suppkey, case s_nationkey % 3 when 0 then 'python:' || s_name || '@' || s_nationkey when 1 then 'python:stdlib:' || s_name else 'python:distribution:' || lower(regexp_replace(s_name, '[-_.#]+', '-', 'g')) end as identity from supplier")
def identity_keys(t):
    kind = F.when(F.col("s_nationkey") % 3 == 0, "local").when(F.col("s_nationkey") % 3 == 1, "stdlib").otherwise("distribution")
    name = F.when(kind == "distribution", S.distribution_name(F.replace("s_name", F.lit("#"), F.lit("-")))).otherwise(F.col("s_name"))
    local = S.identity(F.lit("local"), F.lit("python"), F.col("s_name"), F.col("s_nationkey").cast("string"))
    return t("supplier").select("s_suppkey", F.when(kind == "local", local).otherwise(S.identity(kind, F.lit("python"), name)).alias("identity"))


from loam.plans import code  # noqa: E402, F401  (registers the queries over source code)
