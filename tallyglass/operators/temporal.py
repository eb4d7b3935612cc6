"""Joins in time: as-of in both directions, nearest within a tolerance, validity intervals, and bands.

None of them compares all pairs. As-of joins sort points and probes together inside (key, time bucket) partitions and
carry the last point of earlier buckets along, so a hot key is spread over its buckets. Nearest and band joins turn a
distance into equality on a bucket and its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day(col: Column) -> Column:
    return F.datediff(col, F.lit("1970-01-01").cast("date"))


def asof_join(left: DataFrame, points: DataFrame, key: str, at: str, date: str, values: list[str], forward: bool = False, bucket_days: int = 64) -> DataFrame:
    """left plus the values of the last point with date <= at (forward: the first with date >= at), null if none.

    points holds one row per (key, date).
    """
    sign = -1 if forward else 1
    payload = F.struct(F.col(date), *values)
    probes = left.select(F.col(key).alias("__key"), (sign * day(F.col(at))).alias("__t"), F.struct(*left.columns).alias("__row"), F.lit(1).alias("__kind"))
    facts = points.select(F.col(key).alias("__key"), (sign * day(F.col(date))).alias("__t"), payload.alias("__point"), F.lit(0).alias("__kind"))
    both = probes.unionByName(facts, allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("__t") / bucket_days))
    inside = Window.partitionBy("__key", "__bucket").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__own", F.last("__point", ignorenulls=True).over(inside)).filter("__kind = 1")
    ends = both.groupBy("__key", "__bucket").agg(F.max_by("__point", F.when(F.col("__kind") == 0, F.col("__t"))).alias("__end"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__key").alias("__k"), F.col("__bucket").alias("__b"), F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    out = seen.join(carried, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left")
    hit = F.coalesce("__own", "__carry")
    return out.select("__row.*", hit[date].alias(f"asof_{date}"), *[hit[v].alias(f"asof_{v}") for v in values])


def band_join(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """Pairs of equal key with |right_date - left_date| <= days, by buckets four times as wide: a left row meets one or two."""
    width = 4 * max(1, days)
    ends = [F.floor((day(F.col(left_date)) + s * days) / width) for s in (-1, 1)]
    probe = left.withColumn("__bucket", F.explode(F.sequence(*ends)))
    facts = right.withColumn("__bucket", F.floor(day(F.col(right_date)) / width))
    return probe.join(facts, [key, "__bucket"]).filter(F.abs(F.datediff(right_date, left_date)) <= days).drop("__bucket")


def span_join(spans: DataFrame, facts: DataFrame, key: str, start: str, end: str, date: str, days: int = 0, open_end: str = "2100-01-01") -> DataFrame:
    """Pairs of equal key with date from `days` before a span's start to `days` after its end; a null end is open.

    Spans are dealt to the 64-day buckets that they touch up to the key's last fact, so a key's spans and facts aren't all
    compared, and a hot key is spread over its buckets.
    """
    width = 64
    last = facts.groupBy(key).agg(F.max(date).alias("__last"))
    stop = F.least(F.coalesce(F.date_add(end, days), F.lit(open_end).cast("date")), F.col("__last"))
    first = F.date_sub(start, days)
    ends = [F.floor(day(x) / width) for x in (first, stop)]
    probe = spans.join(last, key).filter(first <= stop).withColumn("__bucket", F.explode(F.sequence(*ends))).drop("__last")
    rows = facts.withColumn("__bucket", F.floor(day(F.col(date)) / width))
    inside = (F.col(date) >= F.date_sub(start, days)) & (F.col(end).isNull() | (F.col(date) <= F.date_add(end, days)))
    return probe.join(rows, [key, "__bucket"]).filter(inside).drop("__bucket")


def nearest_join(left: DataFrame, points: DataFrame, key: str, row_id: list[str], at: str, date: str, value: str, days: int) -> DataFrame:
    """(row_id, date, value) of the nearest point within days; ties go to the earlier date."""
    pairs = band_join(left.select(*row_id, key, at).distinct(), points.select(key, date, value), key, at, date, days)
    best = F.min_by(F.struct(date, value), F.struct(F.abs(F.datediff(date, at)), F.col(date))).alias("near")
    return pairs.groupBy(*row_id, key, at).agg(best).select(*row_id, key, at, F.col(f"near.{date}").alias("near_date"), F.col(f"near.{value}").alias("near_value"))


def interval_status(left: DataFrame, intervals: DataFrame, key: str, at: str, row_id: list[str], value: str) -> DataFrame:
    """Resolve a dated mapping (valid_from, valid_to inclusive, null = open) without guessing: value only if one matches."""
    held = intervals.groupBy(key).agg(F.collect_list(F.struct("valid_from", "valid_to", value)).alias("ranges"))
    rows = left.select(*row_id, key, at).join(held, key, "left")
    inside = F.filter("ranges", lambda r: (F.coalesce(r.valid_from, F.col(at)) <= F.col(at)) & (F.coalesce(r.valid_to, F.col(at)) >= F.col(at)))
    rows = rows.withColumn("hits", inside)
    status = (
        F.when(F.col(at).isNull(), "missing_effective_date")
        .when(F.col("ranges").isNull(), "passthrough_no_history")
        .when(F.size("hits") == 1, "date_bounded_mapping")
        .when(F.size("hits") == 0, "outside_effective_range")
        .otherwise("ambiguous")
    )
    return rows.select(*row_id, key, at, status.alias("status"), F.when(F.size("hits") == 1, F.col("hits")[0][value]).alias(value))
