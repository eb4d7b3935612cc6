"""Several sources of the same records: field by field the value of the most trusted one, and series by provider chains.

A record's rows from all sources meet in one aggregation per key, whatever their number; each field keeps the first value
that isn't null in order of trust, names its source, and tells whether another source says otherwise. A chain of providers
gives each symbol the series of the first provider that has points for it, whole: series aren't mixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How the series of a provider count: fresh ones cover a symbol, kept ones of an earlier run are cached.
EXTREME_PERCENT = 35


def merged_fields(sources: list[tuple[str, DataFrame]], key: str, fields: list[str]) -> DataFrame:
    """(key, for each field its value, <field>_source and <field>_conflict, sources): sources in falling trust.

    Of several rows of one source and key, each field's smallest value counts. Null and empty values say nothing; records
    without any are kept, those with a null key aren't.
    """
    kinds = {f: next(df.schema[f].dataType.simpleString() for _, df in sources if f in df.columns) for f in fields}
    rows = []
    for k, (name, df) in enumerate(sources):
        own = [F.col(f).cast(kinds[f]).alias(f) if f in df.columns else F.lit(None).cast(kinds[f]).alias(f) for f in fields]
        rows.append(df.select(F.col(key), F.lit(k).alias("_k"), F.lit(name).alias("_s"), *own))
    both = reduce(DataFrame.unionByName, rows).filter(F.col(key).isNotNull())
    said = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    best = [F.min(F.when(said(f), F.struct("_k", F.col(f).alias("v"), "_s"))).alias(f"_{f}") for f in fields]
    # Two values differ just where the smallest and the largest do.
    clash = [(F.min(F.when(said(f), F.col(f))) != F.max(F.when(said(f), F.col(f)))).alias(f"_{f}_c") for f in fields]
    out = both.groupBy(key).agg(*best, *clash, F.array_sort(F.collect_set("_s")).alias("sources"))
    columns = [c for f in fields for c in (F.col(f"_{f}.v").alias(f), F.col(f"_{f}._s").alias(f"{f}_source"), F.coalesce(f"_{f}_c", F.lit(False)).alias(f"{f}_conflict"))]
    return out.select(key, *columns, "sources")


def provider_chain(requested: DataFrame, providers: list[tuple[str, str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(coverage, series) of requested symbols; providers are (name, status, points), in order of preference.

    Points (symbol, date, value) without a positive value don't count. coverage (symbol, status, provider, point_count,
    first_date, last_date, passed_over): the provider that serves a symbol and those before it that had nothing; a symbol
    that none serves has status error. series has the points of the provider chosen.
    """
    tagged = [p.filter("value > 0 and date is not null").select("symbol", "date", "value", F.lit(k).alias("rank"), F.lit(n).alias("provider"), F.lit(s).alias("status")) for k, (n, s, p) in enumerate(providers)]
    points = reduce(DataFrame.unionByName, tagged).join(requested.select("symbol").distinct(), "symbol", "left_semi")
    held = points.groupBy("symbol", "rank", "provider", "status").agg(F.countDistinct("date").alias("point_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    chosen = held.groupBy("symbol").agg(F.min(F.struct("rank", "provider", "status", "point_count", "first_date", "last_date")).alias("c")).select("symbol", "c.*")
    names = F.array(*[F.lit(n) for n, _, _ in providers])
    rows = requested.select("symbol").distinct().join(chosen, "symbol", "left")
    coverage = rows.select("symbol", F.coalesce("status", F.lit("error")).alias("status"), "provider", F.coalesce("point_count", F.lit(0)).alias("point_count"), "first_date", "last_date", F.slice(names, F.lit(1), F.coalesce("rank", F.lit(len(providers)))).alias("passed_over"))
    series = points.join(chosen.select("symbol", "rank"), ["symbol", "rank"], "left_semi").groupBy("symbol", "date", "provider").agg(F.max("value").alias("value"))
    return coverage, series


def extreme_moves(series: DataFrame, least: int = EXTREME_PERCENT) -> DataFrame:
    """(symbol, date, previous_date, change): consecutive points at least so many per cent apart, change in hundredths of one, half up."""
    order = Window.partitionBy("symbol").orderBy("date")
    rows = series.withColumn("previous", F.lag("value").over(order)).withColumn("previous_date", F.lag("date").over(order))
    over = 20_000 * (F.col("value") - F.col("previous")) + F.col("previous")
    change = F.floor((over - F.pmod(over, 2 * F.col("previous"))) / (2 * F.col("previous"))).cast("long")
    far = F.abs(F.col("value") - F.col("previous")) * 100 >= least * F.col("previous")
    return rows.filter(F.col("previous").isNotNull() & far).select("symbol", "date", "previous_date", change.alias("change"))
