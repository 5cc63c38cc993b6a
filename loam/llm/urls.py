"""URL filtering by a tree of path templates.

Every URL becomes a host and a list of tokens: its path segments with numbers, hashes and UUIDs starred,
then its query's parameter names.  The tokens of a host form a tree.  From the root down, a node's children,
however many, whose share of bad labels is statistically like that of all children together, or that have
no labels, merge into ``*``, those that are clearly cleaner into ``*-`` and those that are clearly worse
into ``*+``, wherever there are two at least.  The templates that remain are rejected if their
labelled purity, smoothed towards the share of bad labels over all, says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import cut, table, with_struct

#: Standard errors within which a child's bad share is like its siblings'.
ALIKE_Z = 2.0
#: Weight, in labels, of the overall share in a template's purity; purity from which a template is rejected.
PRIOR, REJECT_AT = 4.0, 0.5
#: Words of hosts and paths that public block lists are full of; the weak label of the registered query.
SEEDS = "casino|pills|bets|spam|ads-track"
FIELDS = ["template", "n_labelled", "purity", "rejected"]
SCHEME = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?"
STARRED = ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "[0-9a-f]{16,}", "[0-9]+")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME + "([^/?#:]*)", 1))


def tokens_of(url: Column) -> Column:
    """Generalised path segments, then one token of the sorted parameter names, utm_ ones left out."""
    def star(x: Column) -> Column:
        x = F.lower(x)
        for pattern in STARRED:
            x = F.regexp_replace(x, pattern, "*")
        return x

    path = F.regexp_extract(url, SCHEME + "[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, "^[^#?]*[?]([^#]*)", 1)
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), star)
    names = F.filter(F.transform(F.split(query, "&"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))), lambda n: (n != "") & ~n.startswith("utm_"))
    names = F.array_sort(F.array_distinct(names))
    return F.concat(segments, F.when(F.size(names) > 0, F.array(F.concat(F.lit("?"), F.array_join(names, "&")))).otherwise(F.array().cast("array<string>")))


def templates(patterns: DataFrame) -> DataFrame:
    """Generalise (host, key, tokens, labelled, bad) patterns from the root down; tokens become the template's.

    Each round goes from a node to the next one below with more than one child, as those between change
    nothing; it thus takes as many rounds as there are such nodes along a path, however long the paths are.
    """
    final = []
    todo = patterns.select("host", "key", F.array().cast("array<string>").alias("done"), F.col("tokens").alias("rest"), "labelled", "bad")
    while True:
        at = todo.withColumn("parent", F.col("done"))
        longest = at.groupBy("host", "parent").agg(F.max_by("rest", F.size("rest")).alias("ref"))
        apart = F.array_position(F.zip_with("rest", "ref", lambda x, y: F.coalesce(x != y, F.lit(False))), F.lit(True))
        at = at.join(longest, ["host", "parent"]).withColumn("apart", F.nullif(apart, F.lit(0).cast("long"))).drop("ref")
        forks = at.groupBy("host", "parent").agg(F.min("apart").cast("int").alias("fork"))
        at = cut(at.join(forks, ["host", "parent"]))
        on = F.col("fork").isNotNull() & (F.size("rest") >= F.col("fork"))
        final.append(at.where(~on).select("host", "key", F.concat("done", "rest").alias("tokens"), "labelled", "bad"))
        at = at.where(on).withColumn("token", F.get("rest", F.col("fork") - 1))
        kids = at.groupBy("host", "parent", "token").agg(F.sum("labelled").alias("c_lab"), F.sum("bad").alias("c_bad"))
        every = kids.groupBy("host", "parent").agg(F.sum("c_lab").alias("p_lab"), F.sum("c_bad").alias("p_bad"))
        share = (F.col("p_bad") + 1) / (F.col("p_lab") + 2)
        labels = F.nullif("c_lab", F.lit(0))
        off, width = F.col("c_bad") / labels - share, ALIKE_Z * F.sqrt(share * (1 - share) / labels)
        alike = F.when((F.col("c_lab") == 0) | (F.abs(off) <= width), "*").when(off < 0, "*-").otherwise("*+")
        kids = kids.join(every, ["host", "parent"]).withColumn("starred", alike)
        enough = kids.groupBy("host", "parent", "starred").agg(F.count("*").alias("n_alike")).where("n_alike > 1")
        merged = kids.join(enough, ["host", "parent", "starred"]).select("host", "parent", "token", "starred")
        joined = at.join(merged, ["host", "parent", "token"], "left")
        done = F.concat("done", F.slice("rest", 1, F.col("fork") - 1), F.array(F.coalesce("starred", "token")))
        todo = cut(joined.select("host", "key", done.alias("done"), F.slice("rest", F.col("fork") + 1, F.size("rest")).alias("rest"), "labelled", "bad"))
        if todo.isEmpty():
            return cut(reduce(DataFrame.unionByName, final))


def filter_urls(pages: DataFrame, label: Column, url: str = "url") -> DataFrame:
    """Append template, n_labelled, purity (smoothed share of bad labels) and rejected to every row.

    ``label`` is 1 for bad, 0 for good and null for unlabelled rows.  A template without labels has the overall
    share, which is 0 if nothing is labelled.  Null and empty URLs have a null template, n_labelled and
    purity and are not rejected.  Repeated rows each count and stay.  Other columns stay, except those with an
    output's name, which it replaces.  An empty table gives an empty table.  The trees are built on the
    distinct patterns of a host, not on its URLs, by aggregations and joins, so no host is held in one task.
    """
    given = F.nullif(F.trim(F.col(url)), F.lit(""))
    marked = pages.withColumns({"__loam_label__": label, "__loam_host__": host_of(given), "__loam_key__": tokens_of(given)})
    small = marked.where(given.isNotNull()).groupBy(F.col("__loam_host__").alias("host"), F.col("__loam_key__").alias("key")).agg(F.count("__loam_label__").alias("labelled"), F.coalesce(F.sum("__loam_label__"), F.lit(0)).cast("long").alias("bad"))
    small = cut(small)
    grown = templates(small.select("host", "key", F.col("key").alias("tokens"), "labelled", "bad"))
    named = grown.withColumn("template", F.concat("host", F.lit("/"), F.array_join("tokens", "/")))
    whole = small.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("overall"))
    sums = named.groupBy("template").agg(F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("n_bad")).crossJoin(whole)
    purity = (F.col("n_bad") + PRIOR * F.col("overall")) / (F.col("n_labelled") + PRIOR)
    verdicts = named.join(sums, "template").select(F.col("host").alias("__loam_host__"), F.col("key").alias("__loam_key__"), F.col("template").alias("__loam_t__"), F.col("n_labelled").alias("__loam_n__"), purity.alias("__loam_p__"))
    made = F.struct(F.col("__loam_t__").alias("template"), F.col("__loam_n__").alias("n_labelled"), F.round("__loam_p__", 6).alias("purity"), F.coalesce(F.col("__loam_p__") >= REJECT_AT, F.lit(False)).alias("rejected"))
    own = ["__loam_label__", "__loam_host__", "__loam_key__", "__loam_t__", "__loam_n__", "__loam_p__"]
    return with_struct(marked.join(verdicts, ["__loam_host__", "__loam_key__"], "left"), made, FIELDS).drop(*own)


JUNK = r"%%%|\*\*\*|###|\$\$\$|&amp;&amp;"


def weak_label(url: Column, html: Column) -> Column:
    """1 for URLs with a seed word and for pages full of symbol runs, null for null pages, else 0."""
    junk = F.regexp_count(html, F.lit(JUNK)) * 40 > F.length(html)
    return F.when(F.lower(url).rlike(SEEDS) | junk, 1).when(html.isNotNull(), 0)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url", weak_label(F.col("url"), F.col("html")).alias("bad_label")), F.col("bad_label"))


_STARRED_SQL = "lower(x)"
for _p in STARRED:
    _STARRED_SQL = f"regexp_replace({_STARRED_SQL}, '{_p}', '*', 'g')"

URLS_SQL = f"""
with recursive marked as (
  select page_id, url, given, lower(regexp_extract(given, '{SCHEME}([^/?#:]*)', 1)) as host,
    list_transform(list_filter(string_split(regexp_extract(given, '{SCHEME}[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: {_STARRED_SQL}) as segments,
    list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(given, '^[^#?]*[?]([^#]*)', 1), '&'), lambda p: lower(split_part(p, '=', 1))), lambda n: n <> '' and not starts_with(n, 'utm_')))) as names,
    case when regexp_matches(lower(url), '{SEEDS}') or len(regexp_extract_all(html, '{JUNK}')) * 40 > length(html) then 1 when html is not null then 0 end as bad_label
  from (select *, nullif(trim(url), '') as given from pages)
), listed as (
  select *, case when len(names) > 0 then segments || ['?' || array_to_string(names, '&')] else segments end as every from marked
), rows as (
  select page_id, url, given, bad_label, host, every as tokens from listed
), lev0 as (
  select host, tokens as key, tokens, count(bad_label) as labelled, coalesce(sum(bad_label), 0)::bigint as bad from rows where given is not null group by host, tokens
), walk as (
  select 0 as d, host, key, tokens, labelled, bad from lev0
  union all
  select d + 1, host, key, case when alike > 1 then tokens[1:d] || [starred] || tokens[d + 2:] else tokens end, labelled, bad
  from (select *, count(distinct token) over (partition by host, parent, starred) as alike from (
    select *, (p_bad + 1)::double / (p_lab + 2) as share, case when c_lab = 0
        or abs(c_bad::double / nullif(c_lab, 0) - (p_bad + 1)::double / (p_lab + 2)) <= {ALIKE_Z} * sqrt((p_bad + 1)::double / (p_lab + 2) * (1 - (p_bad + 1)::double / (p_lab + 2)) / nullif(c_lab, 0)) then '*'
        when c_bad::double / nullif(c_lab, 0) < (p_bad + 1)::double / (p_lab + 2) then '*-' else '*+' end as starred
    from (
      select *, sum(labelled) over (partition by host, parent, token) as c_lab, sum(bad) over (partition by host, parent, token) as c_bad,
        sum(labelled) over (partition by host, parent) as p_lab, sum(bad) over (partition by host, parent) as p_bad
      from (select *, tokens[1:d] as parent, tokens[d + 1] as token from walk where len(tokens) > d))))
),
named as (select *, host || '/' || array_to_string(tokens, '/') as template from walk where d = len(tokens)),
whole as (select coalesce(sum(bad)::double / nullif(sum(labelled), 0), 0.0) as overall from lev0),
sums as (select template, sum(labelled)::bigint as n_labelled, sum(bad)::bigint as n_bad from named group by all),
verdict as (select host, key, template, n_labelled, (n_bad + {PRIOR} * overall) / (n_labelled + {PRIOR}) as p from named join sums using (template), whole)
select r.page_id, r.url, r.bad_label, v.template, v.n_labelled, round(v.p, 6) as purity, coalesce(v.p >= {REJECT_AT}, false) as rejected
from rows r left join verdict v on r.given is not null and r.host = v.host and r.tokens = v.key
"""
