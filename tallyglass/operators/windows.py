"""Ordered-row operators: clusters by gap, merged periods, offsets, quotas, ties and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(rows: DataFrame, key: str, date: str, gap_days: int) -> DataFrame:
    """Adds cluster: a new one starts where the gap to the last date exceeds gap_days. Equal dates share one."""
    w = Window.partitionBy(key).orderBy(date)
    days = rows.select(key, date).distinct()
    starts = days.withColumn("start", F.coalesce((F.datediff(date, F.lag(date).over(w)) > gap_days).cast("long"), F.lit(0)))
    return rows.join(starts.select(key, date, F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster")), [key, date])


def gap_periods(rows: DataFrame, key: str, date: str, gap_days: int) -> DataFrame:
    """(key, cluster_start, cluster_end) of the clusters that `gap_clusters` makes, by one sort and no aggregate.

    A date that repeats the one before it goes as it passes. Of each cluster its first and last date stay; the last one follows
    the first.
    """
    w = Window.partitionBy(key).orderBy(date)
    dated = rows.select(key, date).filter(F.col(date).isNotNull()).withColumn("before", F.lag(date).over(w))
    days = dated.filter(F.col("before").isNull() | (F.col("before") != F.col(date))).select(key, date)
    gap = lambda a, b: F.coalesce(F.datediff(a, b) > gap_days, F.lit(True))
    marked = days.select(key, date, gap(date, F.lag(date).over(w)).alias("first"), gap(F.lead(date).over(w), F.col(date)).alias("last"))
    ends = marked.filter("first or last").withColumn("next", F.lead(date).over(w))
    return ends.filter("first").select(key, F.col(date).alias("cluster_start"), F.when(F.col("last"), F.col(date)).otherwise(F.col("next")).alias("cluster_end"))


def merged_periods(rows: DataFrame, key: str, start: str, end: str, slack_days: int = 1) -> DataFrame:
    """Union of periods that overlap or leave at most slack_days, with the days served before each."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(key, start, end).distinct().withColumn("fresh", F.coalesce((F.datediff(start, reach) > slack_days).cast("int"), F.lit(0)))
    islands = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(key, "island").agg(F.min(start).alias("period_start"), F.max(end).alias("period_end"))
    length = F.datediff("period_end", "period_start") + 1
    before = Window.partitionBy(key).orderBy("period_start").rowsBetween(Window.unboundedPreceding, -1)
    return merged.select(key, "period_start", "period_end", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long").alias("days_before"))


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, ranked from 1. Spark keeps n rows of a group per task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def best_or_ambiguous(rows: DataFrame, key: str, candidate: str, score: str, least: int) -> DataFrame:
    """(key, status, candidate): unmatched under `least`, ambiguous on a tie for the best score, else matched."""
    best = rows.groupBy(key, score).agg(F.countDistinct(candidate).alias("n"), F.min(candidate).alias("pick"))
    top = best.groupBy(key).agg(F.max_by(F.struct("n", "pick"), score).alias("t"), F.max(score).alias("best_score"))
    status = F.when(F.col("best_score") < least, "unmatched").when(F.col("t.n") > 1, "ambiguous").otherwise("matched")
    return top.select(key, status.alias("status"), "best_score", F.when(status == "matched", F.col("t.pick")).alias(candidate))
