"""Classification and counting of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.scalars import extension_of, language_of, name_of

CATEGORIES = ("source", "documentation", "configuration", "data", "assets", "uncategorized")
#: A rule that names a file outranks a pattern, and a pattern an extension.
SPECIFICITY = {"filename": 3, "regex": 2, "extension": 1}


def rules_frame(spark, rules: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Rules as rows (category, kind, value, exclude); a driver-sized table."""
    return spark.createDataFrame(rules, "category string, kind string, value string, exclude boolean")


def matches(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """(path, category, specificity) of every category that claims a file and doesn't exclude it.

    Names and extensions meet by equi-join; only patterns, whose number the configuration bounds, are tried
    on all files.  A pattern with a slash is tested on the whole path, another on the name.
    """
    p = F.col(path)
    subject = files.select(p.alias("path")).distinct().withColumns({"name": name_of(F.col("path")), "ext": extension_of(F.col("path"))})
    fixed = F.when(F.col("kind") == "extension", F.lit("ext:")).otherwise(F.lit("name:"))
    keyed = rules.where("kind <> 'regex'").select("category", "kind", "exclude", F.concat(fixed, F.when(F.col("kind") == "extension", F.lower("value")).otherwise(F.col("value"))).alias("key"))
    keys = subject.select("path", F.explode(F.array(F.concat(F.lit("name:"), "name"), F.concat(F.lit("ext:"), "ext"))).alias("key"))
    equal = keys.join(F.broadcast(keyed), "key").select("path", "category", "kind", "exclude")
    patterns = rules.where("kind = 'regex'").select("category", "kind", "exclude", F.concat(F.lit(r"\A(?:"), "value", F.lit(r")\z")).alias("pattern"), F.contains("value", F.lit("/")).alias("whole"))
    tested = F.when(F.col("whole"), F.col("path")).otherwise(F.col("name"))
    fuzzy = subject.crossJoin(F.broadcast(patterns)).where(F.regexp(tested, F.col("pattern"))).select("path", "category", "kind", "exclude")
    rank = F.when(F.col("kind") == "filename", 3).when(F.col("kind") == "regex", 2).otherwise(1)
    claimed = equal.unionByName(fuzzy).groupBy("path", "category").agg(F.max("exclude").alias("out"), F.max(rank).alias("specificity"))
    return claimed.where("not out").drop("out")


def classify(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Append category, conflict (two categories claim with equal rank) and losers (less specific categories) to ``files``.

    A file that none claims is uncategorized; on a conflict the category is null.
    """
    best = matches(files, rules, path).groupBy("path").agg(
        F.max("specificity").alias("top"), F.collect_list(F.struct("specificity", "category")).alias("all")
    )
    won = F.filter("all", lambda c: c["specificity"] == F.col("top"))
    lost = F.filter("all", lambda c: c["specificity"] < F.col("top"))
    best = best.select(
        F.col("path").alias("__path__"),
        F.when(F.size(won) == 1, won[0]["category"]).alias("category"),
        (F.size(won) > 1).alias("conflict"),
        F.array_sort(F.transform(lost, lambda c: c["category"])).alias("losers"),
    )
    joined = files.join(best, files[path] == best["__path__"], "left")
    conflict = F.coalesce("conflict", F.lit(False))
    return joined.select(
        *[files[c] for c in files.columns if c not in ("category", "conflict", "losers")],
        F.when(~conflict, F.coalesce("category", F.lit("uncategorized"))).alias("category"),
        conflict.alias("conflict"),
        F.coalesce("losers", F.array().cast("array<string>")).alias("losers"),
    )


def category_counts(classified: DataFrame) -> DataFrame:
    """Files by category; all categories occur."""
    every = classified.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(classified.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def uncategorized_extensions(classified: DataFrame, path: str = "path") -> DataFrame:
    return classified.where("category = 'uncategorized'").groupBy(extension_of(F.col(path)).alias("extension")).agg(F.count("*").alias("n"))


def language_totals(files: DataFrame, path: str = "path", **sums: Column) -> DataFrame:
    """Files and sums by language, and over all (language null, is_total true), in one pass."""
    known = files.withColumn("language", language_of(F.col(path))).where("language is not null")
    made = [F.count("*").alias("files"), *[F.sum(c).alias(n) for n, c in sums.items()]]
    return known.rollup("language").agg(*made, (F.grouping("language") == 1).alias("is_total"))


def ignored(every: DataFrame, standard: DataFrame, key: str = "path") -> DataFrame:
    """Entries of the full walk that the standard walk leaves out."""
    return every.join(standard.select(key), key, "left_anti")


def reinclude(standard: DataFrame, included: DataFrame, key: str = "path") -> DataFrame:
    """The standard files and those newly let in, each once, marked included_ignored."""
    new = included.join(standard.select(key), key, "left_anti").dropDuplicates([key])
    return standard.withColumn("included_ignored", F.lit(False)).unionByName(new.withColumn("included_ignored", F.lit(True)))


def blank_line_counts(files: DataFrame, text: str = "text") -> DataFrame:
    """Append total and blank physical lines: lines end at a newline, an empty text has none."""
    lines = F.split(F.col(text), "\n")
    last = F.element_at(lines, -1) == ""
    total = F.when(F.col(text) == "", 0).otherwise(F.size(lines) - last.cast("int"))
    blank = F.size(F.filter(lines, lambda x: ~x.rlike(r"[^ \t\n\f\r]"))) - last.cast("int")
    return files.withColumns({"total": total.cast("long"), "blank": F.when(F.col(text) == "", 0).otherwise(blank).cast("long")})
