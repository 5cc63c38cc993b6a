"""Rankings, findings and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scalars import ACTION_RANK, BANDS, RISK_RANK, rank_of, risk_band
from loam.lineage import cut

FINDING = ["rule_id", "item", "observed", "threshold", "unit", "risk", "action", "acknowledged"]


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Append dense 1-based positions of a total order without gathering the rows in one task.

    The rows are range-partitioned by the order, cut (so that the partitions stay as they are) and numbered
    within; the partitions' sizes, one number each, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = cut(df.repartitionByRange(parts, *order).withColumn("__part__", F.spark_partition_id()))
    local = part.withColumn("__row__", F.row_number().over(Window.partitionBy("__part__").orderBy(*order)))
    sizes = local.groupBy("__part__").agg(F.count("*").alias("__n__"))
    before = sizes.withColumn("__before__", F.sum("__n__").over(Window.orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(F.broadcast(before.select("__part__", F.coalesce("__before__", F.lit(0)).alias("__before__"))), "__part__")
    return out.withColumn(name, F.col("__before__") + F.col("__row__")).drop("__part__", "__row__", "__before__")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order; Spark keeps only n rows of each partition."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, group: str, n: int, *order: Column, name: str = "position") -> DataFrame:
    """The first ``n`` rows of each group with their position."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= n)


def complexity_ranking(items: DataFrame, item: str, score: str, review_at: int = 11, bands: tuple = BANDS) -> DataFrame:
    """Items with a score of at least ``review_at`` or not, in order of score (descending) and item, with band and position."""
    s = F.col(score)
    ranked = with_position(items.where(s.isNotNull()), s.desc(), F.col(item))
    return ranked.withColumns({"risk": risk_band(s, bands), "needs_review": s >= review_at})


def findings(
    items: DataFrame, item: str, score: str, review_at: int, block_at: int | None = None, exceptions: DataFrame | None = None, bands: tuple = BANDS
) -> DataFrame:
    """One row for each item at or over the threshold, and for each without a score.

    ``exceptions`` (item, approved_max; null: unbounded) acknowledge a finding, whose action then is none; a
    score over the approved maximum isn't acknowledged.  The first exception of an item counts.
    """
    base = items.select(F.col(item).alias("item"), F.col(score).alias("observed"))
    if exceptions is None:
        base = base.withColumns({"approved_max": F.lit(None).cast("long"), "excepted": F.lit(False)})
    else:
        allowed = exceptions.groupBy("item").agg(F.min(F.struct("line", "approved_max")).alias("e")).select("item", "e.approved_max", F.lit(True).alias("excepted"))
        base = base.join(allowed, "item", "left").withColumn("excepted", F.coalesce("excepted", F.lit(False)))
    s = F.col("observed")
    fine = F.col("excepted") & (F.col("approved_max").isNull() | (s <= F.col("approved_max")))
    blocks = (s >= block_at) if block_at is not None else F.lit(False)
    over = base.where(s >= review_at).select(
        F.lit("complexity-threshold").alias("rule_id"), "item", "observed",
        F.when(blocks & ~fine, block_at).otherwise(review_at).cast("long").alias("threshold"),
        F.lit("score").alias("unit"), risk_band(s, bands).alias("risk"),
        F.when(fine, "none").when(blocks, "block").otherwise("human-review").alias("action"), fine.alias("acknowledged"),
    )
    absent = base.where(s.isNull()).select(
        F.lit("complexity-unavailable").alias("rule_id"), "item", "observed", F.lit(None).cast("long").alias("threshold"),
        F.lit("score").alias("unit"), F.lit("unknown").alias("risk"), F.lit("human-review").alias("action"), F.lit(False).alias("acknowledged"),
    )
    return over.unionByName(absent)


def finding_order() -> list[Column]:
    """Action and risk descending, then item and rule, nulls first."""
    return [rank_of(F.col("action"), ACTION_RANK).desc(), rank_of(F.col("risk"), RISK_RANK).desc(), F.col("item").asc_nulls_first(), F.col("rule_id")]


def gate_status(found: DataFrame) -> DataFrame:
    """One row: status (the worst action, or pass), exit code and numbers of findings."""
    worst = F.coalesce(F.max(rank_of(F.col("action"), ACTION_RANK)), F.lit(0))
    counted = found.agg(worst.alias("worst"), F.count("*").alias("findings"), F.count_if("acknowledged").alias("acknowledged"))
    return counted.select(
        F.when(F.col("worst") == 2, "blocked").when(F.col("worst") == 1, "human-review-required").otherwise("pass").alias("status"),
        F.when(F.col("worst") == 2, 3).when(F.col("worst") == 1, 2).otherwise(0).cast("int").alias("exit_code"), "findings", "acknowledged",
    )
