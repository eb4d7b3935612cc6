"""What stands around a person's trades: scored context candidates, and snapshots of series, moves and events by day.

Candidates are chosen per cluster of trades (single trades too) from the relationships within the window, by spans and
buckets rather than all pairs. Snapshots are calendars: one row per day with the last value of each of several series, one
row per symbol and day with the moves that begin there, one row per day with its nearest events. A trade then only looks its
day up, so however many trades fall on a day, a series is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal, windows
from .lineage import cut

# The window, the gap between clusters, who is eligible how near, and what sources add.
WINDOW, GAP, PER_BUCKET, DISPLAYED, NEAR_IDS = 45, 14, 2, 24, 12
NEWS = ["news_publisher", "news_publisher_via_aggregator"]
HORIZONS = (7, 30, 90)
#: A calendar of more days than this isn't sent to every task.
BROADCAST_DAYS = 200_000


def source_bonus() -> Column:
    return F.when(F.col("source_tier") == "official", 10).when(F.col("source_tier").isin(NEWS), 5).otherwise(0)


def eligible(distance: Column) -> Column:
    """Whether a relationship may stand beside a cluster so far away."""
    tier = F.col("relationship_tier")
    curated = F.col("editor_status") == "curated"
    rule = (
        (F.col("relationship_tier_rank") >= 3) | (tier.isin("asset_specific", "jurisdictional") & (distance <= 30)) | ((tier == "sector_context") & (distance <= 14))
        | ((tier == "general_macro") & (distance <= 7)) | ((tier == "general_context") & curated & (distance <= 14))
    )
    return F.coalesce(rule, F.lit(False))


def trade_context_candidates(trades: DataFrame, relationships: DataFrame, window: int = WINDOW, gap: int = GAP) -> DataFrame:
    """The relationships that are selected beside any of their person's trade clusters, scored, ranked and explained.

    trades has person_id, trade_id, date and movement (the largest benchmark-adjusted move after it in per cent, or null);
    relationships has person_id, event_id, date, relationship_tier, relationship_tier_rank, editor_status, source_tier.
    """
    return candidates_of(clustered(trades, gap), relationships, window, gap)


def clustered(trades: DataFrame, gap: int = GAP) -> DataFrame:
    """Dated trades with their cluster, its first and last date (a, b), its largest movement m (0 if none) and the largest of their id.

    A person's trades are sorted as they are, not joined with their days, so they are shuffled once, by person.
    """
    by = Window.partitionBy("person_id").orderBy("date")
    whole = Window.partitionBy("person_id", "cluster")
    dated = trades.filter("person_id is not null and date is not null").withColumn("_start", F.coalesce((F.datediff("date", F.lag("date").over(by)) > gap).cast("long"), F.lit(0)))
    rows = dated.withColumn("cluster", F.sum("_start").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
    rows = rows.withColumns({"a": F.min("date").over(whole), "b": F.max("date").over(whole), "m": F.coalesce(F.max("movement").over(whole), F.lit(0.0))})
    return rows.withColumn("id_movement", F.max("movement").over(Window.partitionBy("person_id", "trade_id")))


def candidates_of(trades: DataFrame, relationships: DataFrame, window: int = WINDOW, gap: int = GAP) -> DataFrame:
    """The candidates of `clustered` trades.

    Each relationship meets the trades near it once. As days of a cluster are at most `gap` apart, it is within a cluster's
    window only if it is that near to one of its trades.
    """
    known = relationships.filter("date is not null")
    keep = ["person_id", "event_id", "date", "relationship_tier", "relationship_tier_rank", "editor_status", "source_tier"]
    side = trades.select("person_id", "trade_id", F.col("date").alias("trade_date"), "cluster", "a", "b", "m", "id_movement")
    pairs = temporal.band_join(known.select(*keep), side, "person_id", "date", "trade_date", max(window, gap))
    early, late = F.datediff("a", "date"), F.datediff("date", "b")
    # A cluster's pairs meet in one partition, where its relationships are told apart and ranked.
    met = pairs.select(*keep, "cluster", "a", "b", "m").filter(F.greatest(early, late) <= window)
    met = met.withColumn("bucket", F.when(early > 0, "before").when(late > 0, "after").otherwise("during")).withColumn("distance", F.greatest(early, late, F.lit(0)))
    met = met.filter(eligible(F.col("distance")))
    curated = F.coalesce(F.col("editor_status") == "curated", F.lit(False))
    score = F.col("relationship_tier_rank") * 100 - F.col("distance") * 2 + F.when(curated, 15).otherwise(0) + source_bonus() + F.least(F.lit(40), F.bround(F.col("m") * 2, 0).cast("int"))
    met = met.select("person_id", "cluster", "bucket", "event_id", "date", "distance", score.alias("score")).repartition("person_id", "cluster").distinct()
    order = [F.desc("score"), F.col("distance"), F.desc("date"), F.desc("event_id")]
    chosen = windows.top_per_group(met, ["person_id", "cluster", "bucket"], order, PER_BUCKET).select("person_id", "event_id").distinct()
    keys = ["person_id", "event_id"]
    near = pairs.select(*keys, "date", "trade_date", "trade_id", "id_movement").filter(F.abs(F.datediff("date", "trade_date")) <= window)
    return _explained(known, near.join(chosen, keys, "left_semi"), window)


def _explained(rows: DataFrame, near: DataFrame, window: int) -> DataFrame:
    """rows that have trades near them, with these; near has a row for each pair."""
    days = F.datediff("date", "trade_date")
    each = Window.partitionBy("person_id", "event_id")
    order = each.orderBy(F.abs("days"), "days", "trade_date", "trade_id")
    # Counted beside the rank, so that the pairs are made and dealt once.
    first = near.select("person_id", "event_id", "trade_date", "trade_id", "id_movement", days.alias("days")).withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(each)).filter(F.col("k") <= NEAR_IDS)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "trade_id"))), lambda x: x.trade_id)
    # The movement is that of all trades that bear one of the named ids.
    moved = F.coalesce(F.max("id_movement"), F.lit(0.0)).alias("movement")
    beside = first.groupBy("person_id", "event_id").agg(F.min_by("days", "k").alias("nearest_trade_days"), ids.alias("nearby_trade_ids"), F.max("n").alias("nearby_trade_count"), moved)
    out = rows.join(beside, ["person_id", "event_id"])
    specificity = F.least(F.lit(60), F.col("relationship_tier_rank") * 10 + source_bonus())
    n = F.col("nearest_trade_days")
    timing = F.round(25 * (1 - F.least(F.abs(n), F.lit(window)) / F.lit(float(window))), 1)
    market = F.round(F.least(F.lit(15.0), F.col("movement") * 1.5), 1)
    reason = F.when(n == 0, "same day as a disclosed transaction").when(n > 0, F.concat(n.cast("string"), F.lit(" days after the nearest disclosed transaction"))).otherwise(F.concat((-n).cast("string"), F.lit(" days before the nearest disclosed transaction")))
    label = F.when(source_bonus() == 10, "official public record").when(source_bonus() == 5, "attributed publisher report").otherwise("general attributed context")
    out = out.withColumns({"relationship_score": specificity, "temporal_score": timing, "market_score": market, "candidate_score": F.round(specificity + timing + market, 1), "timing_reason": reason, "source_label": label})
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("candidate_score"), "date", "event_id"))
    return out.withColumn("candidate_rank", rank).withColumn("display_default", F.col("candidate_rank") <= DISPLAYED)


def _calendar(points: DataFrame, before: int = 0) -> DataFrame:
    span = points.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence(F.date_sub("a", before), F.col("b"))).alias("day"))


def snapshot(rows: DataFrame, observations: DataFrame, at: str, series: list[str]) -> DataFrame:
    """rows plus a struct (date, value) per series: its last observation with a value on or before the day.

    observations (series_id, date, value) become a calendar of days, filled forward, which is as long as the time they cover;
    days after its end take its last row. Of observations of one day the largest counts.
    """
    known = observations.filter("value is not null")
    points = known.groupBy("date").agg(*[F.max(F.when(F.col("series_id") == s, F.struct("date", "value"))).alias(s) for s in series])
    days = _calendar(known)
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as the calendar has days
    filled = days.join(points, days.day == points.date, "left").select("day", *[F.last(s, ignorenulls=True).over(order).alias(s) for s in series])
    last = days.agg(F.max("day").alias("_last"))
    probe = rows.join(F.broadcast(last)).withColumn("_day", F.least(F.col(at), F.col("_last")))
    small = days.count() <= BROADCAST_DAYS
    return probe.join(F.broadcast(filled) if small else filled, probe["_day"] == filled["day"], "left").drop("_day", "_last", "day")


def percent_change(start: Column, end: Column) -> Column:
    """Hundredths of a per cent from whole-number values, half up; null where the start isn't positive."""
    over = 20_000 * (end - start) + start
    return F.when(start > 0, F.floor((over - F.pmod(over, 2 * start)) / (2 * start))).cast("long")


def moves(points: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, day, start, last, move_<h>): for each symbol and day the first value from there on, the last up to there, and the
    change from the first to the last up to h days later.

    points has symbol, date, cents, one row per symbol and date. Days run from the longest horizon before the first point of
    any symbol to the last point of any.
    """
    days = _calendar(points, max(horizons))
    grid = points.select("symbol").distinct().join(F.broadcast(days))
    rows = grid.join(points.select("symbol", F.col("date").alias("day"), "cents"), ["symbol", "day"], "left")
    by = Window.partitionBy("symbol").orderBy("day")
    rows = rows.withColumn("start", F.last("cents", ignorenulls=True).over(Window.partitionBy("symbol").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.last("cents", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.last("last").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_final", final)
    return rows.select("symbol", "day", "start", "last", *[percent_change(F.col("start"), F.when(F.lead("day", h).over(by).isNull(), F.col("_final")).otherwise(F.lead("last", h).over(by))).alias(f"move_{h}") for h in horizons])


def nearby_events(events: DataFrame, days: DataFrame, window: int = 14, most: int = 5) -> DataFrame:
    """(day, events): of each of the given days the nearest events, by distance, then date, then id; no row where there is none."""
    # Of the events of one date only the first by id can be near enough.
    events = windows.top_per_group(events.select("event_id", "date"), ["date"], [F.col("event_id")], most, "k").drop("k")
    near = temporal.band_join(days.select("day", F.lit(1).alias("_k")), events.select("event_id", "date", F.lit(1).alias("_k")), "_k", "day", "date", window)
    order = [F.abs(F.datediff("date", "day")), F.col("date"), F.col("event_id")]
    top = windows.top_per_group(near, ["day"], order, most, "k")
    return top.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id", F.datediff("date", "day").alias("days_from_trade")))), lambda x: F.struct(x.event_id.alias("event_id"), x.days_from_trade.alias("days_from_trade"))).alias("events"))


def trade_context_rows(trades: DataFrame, points: DataFrame, references: DataFrame, observations: DataFrame, events: DataFrame, series: list[str], default: str = "SPY") -> DataFrame:
    """One row per trade: its symbol or the benchmark it falls back to, moves of both, the move to the report, macro values, events.

    trades has trade_id, person_id, ticker, trade_date, reported_date; references (ticker, benchmark_symbol) one row per ticker.
    """
    points = cut(points)
    grid = cut(moves(points))
    small = F.broadcast if grid.count() <= BROADCAST_DAYS else lambda frame: frame
    symbols = small(points.select("symbol").distinct())
    known = references.select("ticker", "benchmark_symbol").join(symbols.withColumnRenamed("symbol", "benchmark_symbol"), "benchmark_symbol", "left_semi")
    known = small(known)
    rows = trades.join(known, "ticker", "left").join(small(symbols.select(F.col("symbol").alias("ticker"), F.lit(True).alias("covered"))), "ticker", "left")
    rows = rows.withColumn("benchmark_symbol", F.coalesce("benchmark_symbol", F.lit(default))).withColumn("coverage_status", F.when(F.col("covered"), "covered").otherwise("fallback_to_benchmark"))
    rows = rows.withColumn("symbol", F.when(F.col("covered"), F.col("ticker")).otherwise(F.col("benchmark_symbol"))).drop("covered")
    span = grid.agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    rows = rows.join(F.broadcast(span))
    # Before the calendar the first value is that of its first day, and nothing ends within a horizon; after it nothing starts.
    clamp = lambda d: F.greatest(F.least(F.col(d), F.col("_b")), F.col("_a"))
    rows = rows.withColumn("_t", clamp("trade_date")).withColumn("_r", clamp("reported_date"))
    for name, key in (("asset", "symbol"), ("benchmark", "benchmark_symbol")):
        at = grid.select(F.col("symbol").alias(key), F.col("day").alias("_t"), F.col("start").alias(f"_{name}_start"), *[F.col(f"move_{h}").alias(f"{name}_{h}") for h in HORIZONS])
        till = grid.select(F.col("symbol").alias(key), F.col("day").alias("_r"), F.col("last").alias(f"_{name}_last"))
        rows = rows.join(small(at), [key, "_t"], "left").join(small(till), [key, "_r"], "left")
        starts, ends = F.col("trade_date") <= F.col("_b"), F.col("trade_date") >= F.col("_a")
        rows = rows.withColumns({f"{name}_{h}": F.when(starts & ends, F.col(f"{name}_{h}")) for h in HORIZONS})
        rows = rows.withColumn(f"{name}_to_report", F.when(starts & (F.col("reported_date") >= F.col("_a")), percent_change(F.col(f"_{name}_start"), F.col(f"_{name}_last"))))
    rows = snapshot(rows, observations, "trade_date", series)
    near = nearby_events(events, trades.select(F.col("trade_date").alias("day")).distinct())
    near = cut(near)
    rows = rows.join((F.broadcast if near.count() <= BROADCAST_DAYS else lambda frame: frame)(near.withColumnRenamed("day", "trade_date")), "trade_date", "left")
    return rows.drop("_a", "_b", "_t", "_r", "_asset_start", "_asset_last", "_benchmark_start", "_benchmark_last")
