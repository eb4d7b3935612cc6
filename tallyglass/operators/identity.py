"""Identity matching: one verdict per row from candidates that are counted by day under the keys in which they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_join
from .windows import merged_periods


def calendar(spans: DataFrame, key: str, start: str, end: str, candidate: str) -> DataFrame:
    """(key, date, n, only): from that date to the key's next one, how many candidates have a span over the day.

    `only` is the candidate where it is one. Spans include both ends, a null end is open; candidates are whole numbers. A key
    has two rows for each of its spans at most, so candidates are counted without being met with whoever asks for them.
    """
    stop = F.coalesce(end, F.lit("9000-01-01").cast("date"))
    rows = spans.select(key, candidate, F.col(start).alias("start"), stop.alias("stop")).filter("start <= stop")
    held = merged_periods(rows.withColumn("who", F.struct(key, candidate)), "who", "start", "stop").select("who.*", "period_start", "period_end")
    step = lambda at, sign: F.struct(at.alias("date"), F.lit(sign).cast("long").alias("by"), (sign * F.col(candidate)).cast("decimal(38,0)").alias("named"))
    steps = held.select(key, F.explode(F.array(step(F.col("period_start"), 1), step(F.date_add("period_end", 1), -1))).alias("s")).select(key, "s.*")
    steps = steps.groupBy(key, "date").agg(F.sum("by").alias("by"), F.sum("named").cast("decimal(38,0)").alias("named"))
    so_far = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    n, named = F.sum("by").over(so_far), F.sum("named").over(so_far)
    return steps.select(key, "date", n.alias("n"), named.alias("named")).select(key, "date", "n", F.when(F.col("n") == 1, F.col("named").cast("long")).alias("only"))


def on_day(asked: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, candidate: str) -> DataFrame:
    """asked plus n and only of its key's `calendar` on its day."""
    found = asof_join(asked, calendar(spans, key, start, end, candidate), key, at, "date", ["n", "only"])
    return found.select(*asked.columns, F.coalesce("asof_n", F.lit(0)).cast("long").alias("n"), F.col("asof_only").alias("only"))


def best_of(hits: DataFrame, row: list[str], points: str, every) -> DataFrame:
    """(row, top, low, n_all): of hits with `points`, `n` candidates and the `only` one, the most points and who has them.

    top.many where several have them; else top.last and the negative of low.first are the one. n_all is n where `every` holds.
    """
    return hits.filter("n > 0").groupBy(*row).agg(
        F.max(F.struct(F.col(points).alias("points"), (F.col("n") > 1).alias("many"), F.col("only").alias("last"))).alias("top"),
        F.max(F.struct(F.col(points).alias("points"), (-F.col("only")).alias("first"))).alias("low"), F.max(F.when(every, F.col("n"))).alias("n_all"),
    )


def verdict(rows: DataFrame, row: list[str], top, low, least: int, candidate: str, n) -> DataFrame:
    """(row, match_status, match_score, candidate, n_candidates) from the columns of `best_of`.

    The verdict is matched for a single best candidate with at least `least` points, ambiguous where the best ones tie,
    unmatched below that or without candidates. Only matches name one.
    """
    score = F.coalesce(top.points, F.lit(0))
    status = F.when(score < least, "unmatched").when(top.many | (top.last != -low.first), "ambiguous").otherwise("matched")
    return rows.select(*row, status.alias("match_status"), score.cast("int").alias("match_score"), F.when(status == "matched", top.last).alias(candidate), F.coalesce(n, F.lit(0)).alias("n_candidates"))
