"""Trade context over the bound tables: candidates, context rows and career timelines, with SQL by as-of joins.

A person's filings stand for events related to them; their priority gives the tier. Twenty symbols have trades, a third of
them no prices; the benchmark of some isn't priced either, so that they fall back twice.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context as X
from ..operators.lineage import staged
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}
TIERS = {"1-URGENT": ("direct_entity", 4), "2-HIGH": ("asset_specific", 2), "3-MEDIUM": ("sector_context", 2), "4-NOT SPECIFIED": ("general_macro", 1), "5-LOW": ("general_context", 0)}
SERIES = ["FEDFUNDS", "CPIAUCSL", "DGS10", "DGS2", "USREC"]


def _by(col, values):
    out = F.when(F.lit(False), None)
    for k, v in values.items():
        out = out.when(col == k, v)
    return out


def trades(spark, sf):
    """Trades with an id that repeats for some, and their movement; staged, as each query reads them several times."""
    t = B.trades(spark, sf)
    movement = F.when(C("value_cents") % 7 != 0, (C("value_cents") % 120) / F.lit(4.0))
    rows = staged(t.select("person_id", (C("filing_id") * 10 + C("line")).alias("trade_id"), movement.alias("movement"), "ticker", "trade_date", "reported_date", "action", "value_cents"))
    return rows.withColumn("date", C("trade_date"))


def relationships(spark, sf):
    f = B.filings(spark, sf)
    return f.select(
        "person_id", C("filing_id").alias("event_id"), C("filed_date").alias("date"), _by(C("filing_type"), {k: v[0] for k, v in TIERS.items()}).alias("relationship_tier"), _by(C("filing_type"), {k: v[1] for k, v in TIERS.items()}).cast("int").alias("relationship_tier_rank"),
        F.when(C("status") == "F", "curated").when(C("status") == "O", "fixture").alias("editor_status"), F.element_at(F.array(F.lit("official"), F.lit("news_publisher"), F.lit("other")), (C("filing_id") % 3 + 1).cast("int")).alias("source_tier"),
    )


def candidates(spark, sf):
    return X.trade_context_candidates(trades(spark, sf).select("person_id", "trade_id", "date", "movement"), relationships(spark, sf))


QUERIES["dm18_trade_context_candidates"] = lambda spark, sf: candidates(spark, sf).withColumn("nearby_trade_ids", F.array_join(F.transform("nearby_trade_ids", lambda x: x.cast("string")), "|"))


def points(spark, sf, t):
    """Prices in cents: of priced symbols the largest value of a day, of two benchmarks that of the day's orders."""
    own = t.filter(F.substring("ticker", 2, 2).cast("int") % 3 != 1).groupBy(C("ticker").alias("symbol"), C("trade_date").alias("date")).agg(F.max("value_cents").alias("cents"))
    f = B.filings(spark, sf)
    market = f.filter("filing_id % 4 = 0").groupBy(C("filed_date").alias("date")).agg(F.max("cents").alias("cents")).select(F.lit("SPY").alias("symbol"), "date", "cents")
    sector = f.filter("filing_id % 9 = 2").groupBy(C("filed_date").alias("date")).agg(F.max("cents").alias("cents")).select(F.lit("B1").alias("symbol"), "date", "cents")
    return own.unionByName(market).unionByName(sector)


def references(t):
    k = F.substring("ticker", 2, 2).cast("int")
    return t.select("ticker").distinct().filter(k % 4 != 3).select("ticker", F.when(k % 4 == 0, "B1").when(k % 4 == 1, "B9").alias("benchmark_symbol"))


def observations(spark, sf):
    f = B.filings(spark, sf).filter("filing_id % 5 = 1")
    return f.select(_by(C("filing_type"), dict(zip(TIERS, SERIES, strict=True))).alias("series_id"), C("filed_date").alias("date"), F.when(C("cents") % 6 != 0, C("cents")).alias("value"))


def context_rows(spark, sf, t=None):
    t = trades(spark, sf) if t is None else t
    ev = B.civic_events(spark, sf).filter("event_type = 'signup'").select("event_id", "date")
    more = B.filings(spark, sf).filter("filing_id % 30 = 4").select((C("filing_id") + 10_000_000).alias("event_id"), C("filed_date").alias("date"))
    return X.trade_context_rows(t.select("trade_id", "person_id", "ticker", "trade_date", "reported_date"), points(spark, sf, t), references(t), observations(spark, sf), ev.unionByName(more), SERIES)


def flat_rows(spark, sf):
    rows = context_rows(spark, sf)
    macro = [c for s in SERIES for c in (C(f"{s}.date").alias(f"{s.lower()}_date"), C(f"{s}.value").alias(f"{s.lower()}_value"))]
    near = F.coalesce(F.array_join(F.transform("events", lambda e: F.concat_ws(":", e.event_id.cast("string"), e.days_from_trade.cast("string"))), "|"), F.lit(""))
    keep = [f"{n}_{h}" for n in ("asset", "benchmark") for h in (*X.HORIZONS, "to_report")]
    return rows.select("trade_id", "person_id", "ticker", "symbol", "benchmark_symbol", "coverage_status", "trade_date", *keep, *macro, near.alias("nearby_events"))


QUERIES["dm20_trade_context_rows"] = flat_rows


def career(spark, sf):
    """One row per person: trades and their clusters, how many have a price of their own, candidates, the best one, gaps of moves."""
    t = trades(spark, sf)
    held = X.clustered(t.select("person_id", "trade_id", "date", "movement", (C("action") == "BUY").alias("buy")))
    # A cluster of several trades has one second trade; clusters are numbered from 0. So persons are counted without their clusters.
    before = lambda k: F.lag("cluster", k, -1).over(Window.partitionBy("person_id").orderBy("cluster"))
    held = staged(held.withColumn("second", (before(1) == C("cluster")) & (before(2) != C("cluster"))))
    base = held.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_trades"), (F.max("cluster") + 1).alias("n_groups"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if("buy").alias("n_buys"), F.count_if("second").alias("n_clusters"))
    rows = context_rows(spark, sf, t)
    moved = rows.groupBy("person_id").agg(F.count_if(C("coverage_status") == "covered").alias("n_covered"), F.count_if(C("asset_30").isNull()).alias("n_without_move"), F.max("asset_30").alias("best_30"))
    cand = X.candidates_of(held, relationships(spark, sf))
    best = cand.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.min_by("event_id", "candidate_rank").alias("first_candidate"))
    return base.join(moved, "person_id").join(best, "person_id", "left").na.fill(0, ["n_candidates"])


QUERIES["dm60_career_timeline"] = career

_T = """t AS (SELECT o_custkey AS person_id, l_orderkey * 10 + l_linenumber AS trade_id, CAST(l_shipdate AS DATE) AS date, CAST(o_orderdate AS DATE) AS reported, 'P' || (l_partkey % 20) AS ticker, l_partkey % 20 AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, l_returnflag = 'A' AS buy FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 m AS (SELECT *, CASE WHEN v % 7 <> 0 THEN (v % 120) / 4.0 END AS movement FROM t)"""
_CAND = f"""{_T}, r AS (SELECT o_custkey AS person_id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in TIERS.items())} END AS relationship_tier, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in TIERS.items())} END AS rk,
 CASE o_orderstatus WHEN 'F' THEN 'curated' WHEN 'O' THEN 'fixture' END AS editor_status, ['official', 'news_publisher', 'other'][o_orderkey % 3 + 1] AS source_tier, [10, 5, 0][o_orderkey % 3 + 1] AS bonus FROM orders),
 d AS (SELECT person_id, date, CASE WHEN date - lag(date) OVER (PARTITION BY person_id ORDER BY date) > 14 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT person_id, date FROM m)), c AS (SELECT person_id, date, sum(s) OVER (PARTITION BY person_id ORDER BY date) AS cluster FROM d),
 g AS (SELECT person_id, cluster, min(date) AS a, max(date) AS b, coalesce(max(movement), 0) AS mv, count(*) AS n FROM m JOIN c USING (person_id, date) GROUP BY 1, 2),
 x AS (SELECT g.person_id, cluster, r.*, mv, CASE WHEN r.date < a THEN 'before' WHEN r.date > b THEN 'after' ELSE 'during' END AS bucket, greatest(a - r.date, r.date - b, 0) AS dist FROM g JOIN r ON r.person_id = g.person_id WHERE greatest(a - r.date, r.date - b, 0) <= 45),
 e AS (SELECT *, rk * 100 - dist * 2 + CASE WHEN editor_status = 'curated' THEN 15 ELSE 0 END + bonus + least(40, round_even(mv * 2, 0)) AS score FROM x WHERE rk >= 3 OR relationship_tier = 'asset_specific' AND dist <= 30 OR relationship_tier = 'sector_context' AND dist <= 14 OR relationship_tier = 'general_macro' AND dist <= 7 OR relationship_tier = 'general_context' AND editor_status = 'curated' AND dist <= 14),
 sel AS (SELECT DISTINCT person_id, event_id FROM (SELECT person_id, event_id, row_number() OVER (PARTITION BY person_id, cluster, bucket ORDER BY score DESC, dist, date DESC, event_id DESC) AS k FROM e) WHERE k <= 2),
 n AS (SELECT r.*, m.trade_id, m.movement, r.date - m.date AS days, row_number() OVER (PARTITION BY r.event_id ORDER BY abs(r.date - m.date), r.date - m.date, m.date, m.trade_id) AS k FROM r JOIN sel USING (person_id, event_id) JOIN m ON m.person_id = r.person_id AND abs(r.date - m.date) <= 45),
 ids AS (SELECT event_id, any_value(person_id) AS person_id, count(*) AS nearby_trade_count, min(days) FILTER (k = 1) AS nearest, string_agg(CAST(trade_id AS VARCHAR), '|' ORDER BY k) FILTER (k <= 12) AS nearby_trade_ids FROM n GROUP BY 1),
 mvs AS (SELECT n.event_id, coalesce(max(m.movement), 0) AS movement FROM (SELECT DISTINCT event_id, person_id, trade_id FROM n WHERE k <= 12) n JOIN m USING (person_id, trade_id) GROUP BY 1),
 s AS (SELECT r.person_id, r.event_id, r.date, relationship_tier, rk AS relationship_tier_rank, editor_status, source_tier, CAST(nearest AS INTEGER) AS nearest_trade_days, nearby_trade_ids, nearby_trade_count, CAST(movement AS DOUBLE) AS movement, least(60, rk * 10 + bonus) AS relationship_score, CAST(round(25 * (1 - abs(nearest) / 45.0), 1) AS DOUBLE) AS temporal_score, CAST(round(least(15, movement * 1.5), 1) AS DOUBLE) AS market_score, bonus
 FROM r JOIN ids USING (person_id, event_id) JOIN mvs USING (event_id)),
 cand AS (SELECT * EXCLUDE (bonus), round(relationship_score + temporal_score + market_score, 1) AS candidate_score, CASE WHEN nearest_trade_days = 0 THEN 'same day as a disclosed transaction' WHEN nearest_trade_days > 0 THEN nearest_trade_days || ' days after the nearest disclosed transaction' ELSE -nearest_trade_days || ' days before the nearest disclosed transaction' END AS timing_reason,
 CASE bonus WHEN 10 THEN 'official public record' WHEN 5 THEN 'attributed publisher report' ELSE 'general attributed context' END AS source_label, CAST(row_number() OVER (PARTITION BY person_id ORDER BY round(relationship_score + temporal_score + market_score, 1) DESC, date, event_id) AS INTEGER) AS candidate_rank FROM s)"""
ORACLES["dm18_trade_context_candidates"] = f"WITH {_CAND} SELECT *, candidate_rank <= 24 AS display_default FROM cand"
_FLOOR = lambda s, e: f"CAST(CASE WHEN {s} > 0 THEN (20000 * ({e} - {s}) + {s} - (((20000 * ({e} - {s}) + {s}) % (2 * {s})) + 2 * {s}) % (2 * {s})) // (2 * {s}) END AS BIGINT)"
_MOVE = "ASOF LEFT JOIN pts {n} ON {k} = {n}.symbol AND {d} >= {n}.date"
_ROWS = f"""pts AS (SELECT ticker AS symbol, date, max(v) AS cents FROM t WHERE k % 3 <> 1 GROUP BY 1, 2 UNION ALL SELECT 'SPY', CAST(o_orderdate AS DATE), max(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 2 UNION ALL SELECT 'B1', CAST(o_orderdate AS DATE), max(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders WHERE o_orderkey % 9 = 2 GROUP BY 2),
 b AS (SELECT row_number() OVER () AS row, *, CASE WHEN k % 4 = 0 AND 'B1' IN (SELECT symbol FROM pts) THEN 'B1' ELSE 'SPY' END AS bench, ticker IN (SELECT symbol FROM pts) AS covered FROM t),
 w AS (SELECT *, CASE WHEN covered THEN ticker ELSE bench END AS sym, date + 7 AS d7, date + 30 AS d30, date + 90 AS d90 FROM b),
 a AS (SELECT w.*, s.cents AS s, e7.cents AS e7, e30.cents AS e30, e90.cents AS e90, er.cents AS er FROM w ASOF LEFT JOIN pts s ON sym = s.symbol AND w.date <= s.date {_MOVE.format(n='e7', k='sym', d='d7')} {_MOVE.format(n='e30', k='sym', d='d30')} {_MOVE.format(n='e90', k='sym', d='d90')} {_MOVE.format(n='er', k='sym', d='reported')}),
 z AS (SELECT a.*, q.cents AS bs, f7.cents AS f7, f30.cents AS f30, f90.cents AS f90, fr.cents AS fr FROM a ASOF LEFT JOIN pts q ON bench = q.symbol AND a.date <= q.date {_MOVE.format(n='f7', k='bench', d='d7')} {_MOVE.format(n='f30', k='bench', d='d30')} {_MOVE.format(n='f90', k='bench', d='d90')} {_MOVE.format(n='fr', k='bench', d='reported')}),
 ob AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS od, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS val FROM orders WHERE o_orderkey % 5 = 1 AND CAST(round(o_totalprice * 100) AS BIGINT) % 6 <> 0 GROUP BY 1, 2),
 {", ".join(f"o{i} AS (SELECT od, val FROM ob WHERE p = '{p}')" for i, p in enumerate(TIERS))},
 evs AS (SELECT event_id, CAST(CAST(ts AS DATE) - 9000 AS DATE) AS ed FROM events WHERE event_type = 'signup' UNION ALL SELECT o_orderkey + 10000000, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 30 = 4),
 nr AS (SELECT day, string_agg(event_id || ':' || (ed - day), '|' ORDER BY k) AS nearby_events FROM (SELECT day, event_id, ed, row_number() OVER (PARTITION BY day ORDER BY abs(ed - day), ed, event_id) AS k FROM (SELECT DISTINCT date AS day FROM t) JOIN evs ON ed BETWEEN day - 14 AND day + 14) WHERE k <= 5 GROUP BY 1),
 ctx AS (SELECT trade_id, person_id, ticker, sym AS symbol, bench AS benchmark_symbol, CASE WHEN covered THEN 'covered' ELSE 'fallback_to_benchmark' END AS coverage_status, z.date AS trade_date, {_FLOOR('s', 'e7')} AS asset_7, {_FLOOR('s', 'e30')} AS asset_30, {_FLOOR('s', 'e90')} AS asset_90, {_FLOOR('s', 'er')} AS asset_to_report,
 {_FLOOR('bs', 'f7')} AS benchmark_7, {_FLOOR('bs', 'f30')} AS benchmark_30, {_FLOOR('bs', 'f90')} AS benchmark_90, {_FLOOR('bs', 'fr')} AS benchmark_to_report, {", ".join(f"o{i}.od AS {s.lower()}_date, o{i}.val AS {s.lower()}_value" for i, s in enumerate(SERIES))}, coalesce(nearby_events, '') AS nearby_events
 FROM z {" ".join(f"ASOF LEFT JOIN o{i} ON z.date >= o{i}.od" for i in range(5))} LEFT JOIN nr ON nr.day = z.date)"""
ORACLES["dm20_trade_context_rows"] = f"WITH {_T}, {_ROWS} SELECT * FROM ctx"
ORACLES["dm60_career_timeline"] = f"""WITH {_CAND}, {_ROWS.replace(' a AS (', ' aa AS (').replace('FROM a ASOF', 'FROM aa a ASOF').replace(' b AS (', ' bb AS (').replace('FROM b)', 'FROM bb)')}
 SELECT p.*, coalesce(n_clusters, 0) AS n_clusters, n_covered, n_without_move, best_30, coalesce(n_candidates, 0) AS n_candidates, first_candidate FROM (SELECT person_id, sum(n) AS n_trades0, count(*) AS n_groups, min(a) AS first_date, max(b) AS last_date, count(*) FILTER (n > 1) AS n_clusters FROM g GROUP BY 1) h
 JOIN (SELECT person_id, count(*) AS n_trades, count(*) FILTER (buy) AS n_buys FROM t GROUP BY 1) p0 USING (person_id) JOIN (SELECT person_id, count(*) FILTER (coverage_status = 'covered') AS n_covered, count(*) FILTER (asset_30 IS NULL) AS n_without_move, max(asset_30) AS best_30 FROM ctx GROUP BY 1) q USING (person_id)
 LEFT JOIN (SELECT person_id, count(*) AS n_candidates, min(event_id) FILTER (candidate_rank = 1) AS first_candidate FROM cand GROUP BY 1) c2 USING (person_id)
 JOIN (SELECT person_id, count(*) AS n_trades, count(*) FILTER (buy) AS n_buys FROM t GROUP BY 1) p USING (person_id)"""
ORACLES["dm60_career_timeline"] = ORACLES["dm60_career_timeline"].replace("SELECT p.*, coalesce(n_clusters, 0) AS n_clusters,", "SELECT person_id, p0.n_trades, n_groups, first_date, last_date, p0.n_buys, coalesce(n_clusters, 0) AS n_clusters,").replace("\n JOIN (SELECT person_id, count(*) AS n_trades, count(*) FILTER (buy) AS n_buys FROM t GROUP BY 1) p USING (person_id)", "")
