"""Scoring of binary classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import held


def auc(df: DataFrame, label: str, score: str) -> float | None:
    """Exact area under the ROC curve; rows with a null or NaN are left out.

    That is the share of (yes, no) pairs in which the yes has the higher score, ties
    counting half.  Equal scores are first combined into one row, so a score held by a
    third of all rows is no burden.  The scores are then split into ranges: pairs within
    a range are counted range by range, pairs across ranges from the ranges' totals.
    None when there are no pairs.
    """
    known = df.select(F.col(label).cast("double").alias("yes"), F.col(score).alias("score"))
    by_score = (
        known.dropna()
        .groupBy("score")
        .agg(F.sum("yes").alias("yes"), F.sum(1 - F.col("yes")).alias("no"))
    )
    ranged = by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id())
    with held(ranged) as scores:
        below = Window.partitionBy("part").orderBy("score")
        parts = (
            scores.withColumn("won", F.col("yes") * (_sum_before("no", below) + F.col("no") / 2))
            .groupBy("part")
            .agg(*(F.sum(c).alias(c) for c in ("yes", "no", "won")))
        )
        # One row per range from here on.
        lower = Window.partitionBy(F.lit(1)).orderBy("part")
        won = F.col("won") + F.col("yes") * _sum_before("no", lower)
        totals = parts.select("yes", "no", won.alias("won")).agg(
            F.try_divide(F.sum("won"), F.sum("yes") * F.sum("no"))
        )
        return totals.head()[0]


def _sum_before(column: str, window: Window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0.0))


def accuracy(label: str, prediction: str) -> Column:
    """Aggregate: share of rows whose prediction equals the label."""
    return F.avg((F.col(label).cast("double") == F.col(prediction)).cast("double"))
