"""Resolution by joins: imports against modules, standard library and distributions; calls against symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped(catalogue: DataFrame, name: str, target: str) -> DataFrame:
    """Candidates of each name: sorted, each once."""
    return catalogue.groupBy(F.col(name).alias("__name__")).agg(F.array_sort(F.collect_set(target)).alias("candidates"))


def resolve(references: DataFrame, wanted: list[tuple[Column, DataFrame, str]], reason: Column) -> DataFrame:
    """Append kind, target and candidates: the first of ``wanted`` with a hit decides.

    ``wanted`` lists (key, grouped candidates, origin); one candidate is an exact hit, several are ambiguous,
    and without any the reference is unresolved for ``reason``.
    """
    out = references
    found = []
    for k, (key, candidates, origin) in enumerate(wanted):
        out = out.withColumn(f"__k{k}__", key).join(candidates.select(F.col("__name__").alias(f"__k{k}__"), F.col("candidates").alias(f"__c{k}__")), f"__k{k}__", "left")
        found.append(F.when(F.col(f"__c{k}__").isNotNull(), F.struct(F.lit(origin).alias("origin"), F.col(f"__c{k}__").alias("candidates"))))
    hit = F.coalesce(*found)
    size = F.size(hit["candidates"])
    made = out.withColumns({
        "kind": F.when(hit.isNull(), "unresolved").when(size == 1, "exact").otherwise("ambiguous"),
        "origin": hit["origin"],
        "target": F.when(size == 1, hit["candidates"][0]),
        "candidates": F.coalesce(hit["candidates"], F.array().cast("array<string>")),
        "reason": F.when(hit.isNull(), reason),
    })
    return made.drop(*[f"__{x}{k}__" for k in range(len(wanted)) for x in "kc"])


def resolve_imports(imports: DataFrame, modules: DataFrame, stdlib: DataFrame | None = None, providers: DataFrame | None = None) -> DataFrame:
    """Resolve imports (level, requested, imported, problem) in the order: relative-level error, local child, local module, relative failure, no environment, standard library, distribution."""
    local = grouped(modules, "module", "identity")
    sound = F.col("problem").isNull()
    child = F.when(sound & F.col("imported").isNotNull() & (F.col("imported") != "*"), F.concat_ws(".", "requested", "imported"))
    outside = F.when(sound & (F.col("level") == 0), F.split("requested", "[.]")[0])
    wanted = [(child, local, "local"), (F.when(sound, F.col("requested")), local, "local")]
    if stdlib is not None:
        wanted.append((outside, stdlib.select(F.col("name").alias("__name__"), F.array(F.concat(F.lit("python:stdlib:"), "name")).alias("candidates")), "standard-library"))
        wanted.append((outside, grouped(providers.withColumn("target", F.concat(F.lit("python:distribution:"), "distribution")), "import_name", "target"), "distribution"))
    reason = F.coalesce("problem", F.when((F.col("level") > 0) | F.lit(stdlib is not None), "module-not-found").otherwise("environment-unavailable"))
    return resolve(imports, wanted, reason)


def last_binding(imports: DataFrame, scope: str, name: str, *order: str) -> DataFrame:
    """The last import of each name in a file: later bindings win."""
    last = Window.partitionBy(scope, name).orderBy(*[F.col(c).desc() for c in order])
    return imports.withColumn("__at__", F.row_number().over(last)).where("__at__ = 1").drop("__at__")


def by_priority(requests: DataFrame, key: list[str], candidates: Column, catalogue: DataFrame, name: str, target: str) -> DataFrame:
    """For each request the first of its ``candidates`` (array of names, in order of priority) that the catalogue holds.

    Appends hit_name, n_targets (different ones), target (the least, of an exact hit the only one) and kind;
    requests without a hit have kind unresolved.  A name's targets themselves are not carried to its requests.
    """
    spread = requests.select(*key, F.posexplode(candidates).alias("priority", "__name__"))
    counted = catalogue.groupBy(F.col(name).alias("__name__")).agg(F.countDistinct(target).alias("n"), F.min(target).alias("target"))
    met = spread.join(counted, "__name__")
    first = met.groupBy(*key).agg(F.min_by(F.struct(F.col("__name__").alias("name"), "n", "target"), "priority").alias("hit"))
    joined = requests.join(first, key, "left")
    kind = F.when(F.col("hit").isNull(), "unresolved").when(F.col("hit.n") == 1, "exact").otherwise("ambiguous")
    return joined.select(*[requests[c] for c in requests.columns], F.col("hit.name").alias("hit_name"), F.coalesce("hit.n", F.lit(0)).alias("n_targets"), F.col("hit.target").alias("target"), kind.alias("kind"))


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """One row: total, exact, ambiguous and unresolved references."""
    return resolved.agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "ambiguous", "unresolved")])
