"""Decisions merged from three sources and price series from a chain of providers, over the bound tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import precedence as P
from ..operators.lineage import cut
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}


def decisions(spark, sf):
    """Orders as court decisions: what their document, their metadata and an index say of them, each in part and not always alike."""
    o, k = B.table(spark, sf, "orders"), C("o_orderkey")
    day = C("o_orderdate").cast("date")
    pdf = o.filter(k % 3 == 0).select(k.alias("docket"), F.when(k % 2 == 0, F.date_add(day, F.when(k % 5 == 0, 1).otherwise(0))).alias("decision_date"), F.when(k % 7 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(" U.S."))).alias("citation"))
    meta = o.filter(k % 4 != 1).select(k.alias("docket"), day.alias("decision_date"), F.concat(F.lit("Case "), C("o_custkey").cast("string")).alias("title"), F.when(k % 11 == 0, "old").alias("citation"))
    index = o.filter(k % 5 != 2).select(k.alias("docket"), F.when(k % 6 == 0, "Case unknown").alias("title"), C("o_orderpriority").alias("court"), F.when(k % 8 == 0, F.date_sub(day, 2)).alias("decision_date"))
    return P.merged_fields([("pdf", pdf), ("metadata", meta), ("index", index)], "docket", ["decision_date", "title", "citation", "court"])


QUERIES["dm62_decision_merge"] = lambda spark, sf: decisions(spark, sf).withColumn("sources", F.array_join("sources", "|"))


def _chain(spark, sf):
    """Trades are read once: of each symbol and day the largest value that each provider knows."""
    k, v = F.substring("ticker", 2, 2).cast("int"), C("value_cents")
    known = {"tiingo": F.when(k % 3 == 0, F.when(k == 6, 0).otherwise(v)), "kept": F.when((k % 4 <= 1) & (C("action") == "BUY"), v), "nasdaq": F.when((k % 5 != 2) & (C("action") != "BUY"), v)}
    days = cut(B.trades(spark, sf).groupBy("ticker", C("trade_date").alias("date")).agg(*[F.max(x).alias(n) for n, x in known.items()]))
    points = lambda name: days.filter(C(name).isNotNull()).select(C("ticker").alias("symbol"), "date", C(name).alias("value"))
    requested = days.select(C("ticker").alias("symbol")).distinct().unionByName(days.select(F.concat(F.lit("Q"), F.substring("ticker", 2, 2)).alias("symbol")).distinct())
    return P.provider_chain(requested, [("tiingo", "covered", points("tiingo")), ("kept", "cached", points("kept")), ("nasdaq", "covered", points("nasdaq"))])


QUERIES["dm63_price_coverage"] = lambda spark, sf: _chain(spark, sf)[0].withColumn("passed_over", F.array_join("passed_over", "|"))
QUERIES["dm63_price_series"] = lambda spark, sf: _chain(spark, sf)[1]
QUERIES["dm63_extreme_moves"] = lambda spark, sf: P.extreme_moves(_chain(spark, sf)[1])

_SAY = """s AS (SELECT o_orderkey AS docket, 0 AS r, 'pdf' AS src, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS decision_date, NULL AS title, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey || ' U.S.' END AS citation, NULL AS court FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, 1, 'metadata', CAST(o_orderdate AS DATE), 'Case ' || o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'old' END, NULL FROM orders WHERE o_orderkey % 4 <> 1
 UNION ALL SELECT o_orderkey, 2, 'index', CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderdate AS DATE) - 2 END, CASE WHEN o_orderkey % 6 = 0 THEN 'Case unknown' END, NULL, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 2)"""
ORACLES["dm62_decision_merge"] = f"""WITH {_SAY} SELECT docket, {", ".join(f"arg_min({f}, r) FILTER ({f} IS NOT NULL) AS {f}, arg_min(src, r) FILTER ({f} IS NOT NULL) AS {f}_source, count(DISTINCT {f}) > 1 AS {f}_conflict" for f in ("decision_date", "title", "citation", "court"))},
 string_agg(DISTINCT src, '|' ORDER BY src) AS sources FROM s GROUP BY 1"""
_PTS = """p AS (SELECT ticker AS symbol, trade_date AS date, value_cents AS value, 0 AS r FROM trades WHERE CAST(ticker[2:] AS INTEGER) % 3 = 0 AND ticker <> 'P6' UNION ALL SELECT ticker, trade_date, value_cents, 1 FROM trades WHERE CAST(ticker[2:] AS INTEGER) % 4 <= 1 AND action = 'BUY'
 UNION ALL SELECT ticker, trade_date, value_cents, 2 FROM trades WHERE CAST(ticker[2:] AS INTEGER) % 5 <> 2 AND action <> 'BUY'), c AS (SELECT symbol, min(r) AS r FROM p GROUP BY 1), x AS (SELECT symbol, date, r, max(value) AS value FROM p JOIN c USING (symbol, r) GROUP BY 1, 2, 3),
 q AS (SELECT DISTINCT ticker AS symbol FROM trades UNION SELECT 'Q' || ticker[2:] FROM trades)"""
ORACLES["dm63_price_coverage"] = B.sql(f""", {_PTS} SELECT q.symbol, CASE any_value(r) WHEN 0 THEN 'covered' WHEN 1 THEN 'cached' WHEN 2 THEN 'covered' ELSE 'error' END AS status, CASE any_value(r) WHEN 0 THEN 'tiingo' WHEN 1 THEN 'kept' WHEN 2 THEN 'nasdaq' END AS provider, count(date) AS point_count, min(date) AS first_date, max(date) AS last_date,
 CASE any_value(r) WHEN 0 THEN '' WHEN 1 THEN 'tiingo' WHEN 2 THEN 'tiingo|kept' ELSE 'tiingo|kept|nasdaq' END AS passed_over FROM q LEFT JOIN x USING (symbol) GROUP BY 1""", "trades")
ORACLES["dm63_price_series"] = B.sql(f", {_PTS} SELECT symbol, date, value, CASE r WHEN 0 THEN 'tiingo' WHEN 1 THEN 'kept' ELSE 'nasdaq' END AS provider FROM x", "trades")
ORACLES["dm63_extreme_moves"] = B.sql(f""", {_PTS}, l AS (SELECT symbol, date, value, lag(value) OVER w AS pv, lag(date) OVER w AS previous_date FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, date, previous_date, CAST((20000 * (value - pv) + pv - (((20000 * (value - pv) + pv) % (2 * pv)) + 2 * pv) % (2 * pv)) // (2 * pv) AS BIGINT) AS change FROM l WHERE abs(value - pv) * 100 >= 35 * pv""", "trades")
