"""Documentation coverage: counts over grouping sets, and the collapse of overload groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scalars import basis_points, percent_text, threshold_met


def coverage(items: DataFrame, status: Column, *groups: str, percent: int = 80) -> DataFrame:
    """Eligible, documented, missing and unavailable items over all and by each of ``groups``, with coverage and verdict.

    ``status`` is documented, missing or anything else, which counts as unavailable.  Rows carry the
    grouping's name in ``grouping`` and its value in ``key``, null in the total.
    """
    marked = items.select(*[F.col(g).cast("string").alias(g) for g in groups], F.coalesce(status, F.lit("unavailable")).alias("__status__"))
    names = F.array(F.struct(F.lit("total").alias("grouping"), F.lit(None).cast("string").alias("key")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("key")) for g in groups])
    tallied = marked.groupBy(*groups, "__status__").agg(F.count("*").alias("n")).select(F.explode(names).alias("g"), "__status__", "n")
    has = lambda s: F.coalesce(F.sum(F.when(F.col("__status__") == s, F.col("n"))), F.lit(0))
    sums = tallied.groupBy("g.grouping", "g.key").agg(F.sum("n").alias("eligible"), has("documented").alias("documented"), has("missing").alias("missing"))
    sums = sums.withColumn("unavailable", F.col("eligible") - F.col("documented") - F.col("missing"))
    measured = F.col("documented") + F.col("missing")
    points = basis_points(F.col("documented"), measured)
    return sums.withColumns({"basis_points": points, "percent": percent_text(points), "met": threshold_met(F.col("documented"), measured, F.col("unavailable"), percent)})


def collapse_groups(items: DataFrame, group: list[str], is_overload: Column, status: Column, *order: Column) -> DataFrame:
    """One row for each group that holds an overload, every row of the others.

    The implementation (no overload) stands for its group; without one a documented row, then an
    unavailable one, then the first in order.
    """
    whole = Window.partitionBy(*group)
    priority = F.when(~F.col("__over__"), 0).when(F.col("__status__") == "documented", 1).when(F.col("__status__") == "unavailable", 2).otherwise(3)
    ranked = items.withColumns({"__over__": is_overload, "__status__": status})
    ranked = ranked.withColumn("__any__", F.max("__over__").over(whole)).withColumn("__at__", F.row_number().over(whole.orderBy(priority, *order)))
    return ranked.where("not __any__ or __at__ = 1").drop("__over__", "__status__", "__any__", "__at__")
