"""Filters, paging, joins, aggregates, windows and set operations over the domain views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import temporal, windows
from . import bindings as B
from .bindings import sql

QUERIES, ORACLES = {}, {}
C = F.col

def ONE():  # noqa: N802
    return F.count(F.lit(1))



def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def facets(frame, **wanted):
    """Rows equal on every facet that is set."""
    return reduce(lambda f, kv: f.filter(C(kv[0]) == kv[1]), [(k, v) for k, v in wanted.items() if v is not None], frame)


# -- filters and paging


@query("f1_people_facets", sql("SELECT person_id, full_name, state, count(*) OVER () AS total FROM people WHERE branch = 'Executive' AND party = 'BUILDING'", "people"))
def f1(spark, sf):
    found = facets(B.people(spark, sf), branch="Executive", party="BUILDING", state=None)
    return found.select("person_id", "full_name", "state").crossJoin(F.broadcast(found.agg(ONE().alias("total"))))


@query("f2_trade_filter", sql("SELECT filing_id, line, trade_date, ticker, value_cents FROM trades WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND action = 'BUY' AND lag_days >= 45", "trades"))
def f2(spark, sf):
    t = B.trades(spark, sf).filter(C("trade_date").between("1997-01-01", "1997-12-31") & (C("action") == "BUY") & (C("lag_days") >= 45))
    return t.select("filing_id", "line", "trade_date", "ticker", "value_cents")


@query("f4_person_search", sql("SELECT person_id, full_name FROM people WHERE full_name ILIKE '%00042%' ORDER BY full_name, person_id LIMIT 20", "people"))
def f4(spark, sf):
    return B.people(spark, sf).filter(C("full_name").ilike("%00042%")).select("person_id", "full_name").orderBy("full_name", "person_id").limit(20)


@query("f6_series_range", sql("SELECT symbol, date, cents FROM series WHERE symbol IN ('1-URGENT', '2-HIGH') AND date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'", "series"))
def f6(spark, sf):
    return B.series(spark, sf).filter(C("symbol").isin("1-URGENT", "2-HIGH") & C("date").between("1996-03-01", "1996-06-30"))


@query("f7_filings_with_children", sql("SELECT f.filing_id, f.filed_date, CAST(count(t.line) AS BIGINT) AS n_trades, string_agg(DISTINCT t.ticker, ',' ORDER BY t.ticker) AS tickers FROM filings f LEFT JOIN trades t USING (filing_id) WHERE f.filed_date >= DATE '2000-01-01' GROUP BY 1, 2", "filings", "trades"))
def f7(spark, sf):
    f = B.filings(spark, sf).filter(C("filed_date") >= "2000-01-01").select("filing_id", "filed_date")
    t = B.trades(spark, sf).groupBy("filing_id").agg(ONE().alias("n"), F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"))
    return f.join(t, "filing_id", "left").select("filing_id", "filed_date", F.coalesce("n", F.lit(0)).alias("n_trades"), "tickers")


@query("f14_default_hoisting", sql(", d AS (SELECT branch, mode(party ORDER BY party) AS party_default FROM people GROUP BY 1), k AS (SELECT branch, party, count(*) n FROM people GROUP BY 1, 2), b AS (SELECT branch, arg_max(party, (n, party)) AS party_default FROM k GROUP BY 1) SELECT person_id, p.branch, nullif(party, party_default) AS party_override FROM people p JOIN b USING (branch)", "people"))
def f14(spark, sf):
    p = B.people(spark, sf)
    best = p.groupBy("branch", "party").count().groupBy("branch").agg(F.max_by("party", F.struct("count", "party")).alias("party_default"))
    return p.join(F.broadcast(best), "branch").select("person_id", "branch", F.nullif(C("party"), C("party_default")).alias("party_override"))


@query("l2_page_with_total", sql("SELECT filing_id, filed_date, cents, count(*) OVER () AS total FROM filings WHERE status = 'F' ORDER BY cents DESC, filing_id LIMIT 25 OFFSET 50", "filings"))
def l2(spark, sf):
    f = B.filings(spark, sf).filter("status = 'F'")
    page = f.orderBy(C("cents").desc(), "filing_id").offset(50).limit(25).select("filing_id", "filed_date", "cents")
    return page.crossJoin(F.broadcast(f.agg(ONE().alias("total"))))


@query("l3_priority_queue", sql("SELECT filing_id, status, cents FROM filings ORDER BY CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, cents DESC NULLS LAST, filing_id LIMIT 100", "filings"))
def l3(spark, sf):
    rank = F.when(C("status") == "P", 0).when(C("status") == "O", 1).otherwise(2)
    return B.filings(spark, sf).orderBy(rank, C("cents").desc_nulls_last(), "filing_id").limit(100).select("filing_id", "status", "cents")


# -- joins


@query("j2_left_provenance", sql("SELECT p.person_id, count(f.filing_id) AS n_filings, max(f.filed_date) AS last_filed FROM people p LEFT JOIN filings f ON p.person_id = f.person_id AND f.status = 'P' GROUP BY 1", "people", "filings"))
def j2(spark, sf):
    f = B.filings(spark, sf).filter("status = 'P'").groupBy("person_id").agg(ONE().alias("n"), F.max("filed_date").alias("last_filed"))
    return B.people(spark, sf).join(f, "person_id", "left").select("person_id", F.coalesce("n", F.lit(0)).alias("n_filings"), "last_filed")


@query("j6_without_filings", sql("SELECT person_id, full_name FROM people p WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.person_id = p.person_id AND f.filed_date >= DATE '2000-06-01')", "people", "filings"))
def j6(spark, sf):
    recent = B.filings(spark, sf).filter(C("filed_date") >= "2000-06-01").select("person_id")
    return B.people(spark, sf).join(recent, "person_id", "left_anti").select("person_id", "full_name")


@query("j7_drift", sql(", a AS (SELECT filing_type, count(*) n FROM filings WHERE filed_date < DATE '1998-01-01' GROUP BY 1), b AS (SELECT filing_type, count(*) n FROM filings WHERE filed_date >= DATE '1998-01-01' AND filing_type <> '5-LOW' GROUP BY 1) SELECT coalesce(a.filing_type, b.filing_type) AS source_id, a.n AS baseline, b.n AS current, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'missing' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS drift FROM a FULL JOIN b ON a.filing_type = b.filing_type", "filings"))
def j7(spark, sf):
    f = B.filings(spark, sf)
    a = f.filter(C("filed_date") < "1998-01-01").groupBy(C("filing_type").alias("source_id")).agg(ONE().alias("baseline"))
    b = f.filter((C("filed_date") >= "1998-01-01") & (C("filing_type") != "5-LOW")).groupBy(C("filing_type").alias("source_id")).agg(ONE().alias("current"))
    drift = F.when(C("baseline").isNull(), "new").when(C("current").isNull(), "missing").when(C("baseline") == C("current"), "unchanged").otherwise("changed")
    return a.join(b, "source_id", "full_outer").select("source_id", "baseline", "current", drift.alias("drift"))


_ASOF = """, l AS (SELECT DISTINCT filing_type AS symbol, CAST(t.trade_date AS DATE) AS trade_date FROM trades t JOIN filings USING (filing_id))
SELECT l.symbol, l.trade_date, s.date AS asof_date, s.cents AS asof_cents FROM l ASOF LEFT JOIN series s ON l.symbol = s.symbol AND l.trade_date {op} s.date"""


def _probes(spark, sf):
    t = B.trades(spark, sf).select("filing_id", "trade_date")
    return t.join(B.filings(spark, sf).select("filing_id", C("filing_type").alias("symbol")), "filing_id").select("symbol", "trade_date").distinct()


@query("j9_asof_forward", sql(_ASOF.format(op="<="), "filings", "trades", "series"))
def j9(spark, sf):
    return temporal.asof_join(_probes(spark, sf), B.series(spark, sf), "symbol", "trade_date", "date", ["cents"], forward=True)


@query("j10_asof_backward", sql(_ASOF.format(op=">="), "filings", "trades", "series"))
def j10(spark, sf):
    return temporal.asof_join(_probes(spark, sf), B.series(spark, sf), "symbol", "trade_date", "date", ["cents"])


@query("j11_nearest", sql(", e AS (SELECT event_id, date, '1-URGENT' AS symbol FROM civic_events), s AS (SELECT symbol, date AS point_date, cents FROM series), c AS (SELECT event_id, e.symbol, e.date, point_date, cents, row_number() OVER (PARTITION BY event_id ORDER BY abs(point_date - e.date), point_date) r FROM e JOIN s ON e.symbol = s.symbol AND abs(point_date - e.date) <= 7) SELECT event_id, symbol, date, point_date AS near_date, cents AS near_value FROM c WHERE r = 1", "civic_events", "series"))
def j11(spark, sf):
    e = B.civic_events(spark, sf).select("event_id", "date", F.lit("1-URGENT").alias("symbol"))
    s = B.series(spark, sf).select("symbol", C("date").alias("point_date"), "cents")
    return temporal.nearest_join(e, s, "symbol", ["event_id"], "date", "point_date", "cents", 7)


@query("j12_interval_status", sql(""", h AS (SELECT 'P' || k AS ticker, DATE '1995-01-01' AS valid_from, DATE '1997-12-31' AS valid_to, 'OLD' || k AS issuer FROM range(0, 10) r(k)
 UNION ALL SELECT 'P' || k, CASE WHEN k % 3 = 0 THEN DATE '1997-06-01' ELSE DATE '1998-06-01' END, CAST(NULL AS DATE), 'NEW' || k FROM range(0, 10) r(k)),
t AS (SELECT DISTINCT ticker, trade_date FROM trades), m AS (SELECT t.ticker, t.trade_date, count(h.issuer) AS n, min(h.issuer) AS issuer FROM t LEFT JOIN h ON t.ticker = h.ticker AND t.trade_date >= coalesce(valid_from, t.trade_date) AND t.trade_date <= coalesce(valid_to, t.trade_date) GROUP BY 1, 2)
SELECT ticker, trade_date, CASE WHEN ticker NOT IN (SELECT ticker FROM h) THEN 'passthrough_no_history' WHEN n = 1 THEN 'date_bounded_mapping' WHEN n = 0 THEN 'outside_effective_range' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN issuer END AS issuer FROM m""", "trades"))
def j12(spark, sf):
    k = spark.range(10)
    ticker = F.concat(F.lit("P"), C("id"))
    day = lambda d: F.lit(d).cast("date")
    old = k.select(ticker.alias("ticker"), day("1995-01-01").alias("valid_from"), day("1997-12-31").alias("valid_to"), F.concat(F.lit("OLD"), "id").alias("issuer"))
    new = k.select(ticker.alias("ticker"), F.when(C("id") % 3 == 0, day("1997-06-01")).otherwise(day("1998-06-01")).alias("valid_from"), day(None).alias("valid_to"), F.concat(F.lit("NEW"), "id").alias("issuer"))
    t = B.trades(spark, sf).select("ticker", "trade_date").distinct()
    return temporal.interval_status(t, old.unionByName(new), "ticker", "trade_date", [], "issuer")


@query("j14_common_dates", sql("SELECT a.date, a.cents AS asset_cents, b.cents AS benchmark_cents FROM series a JOIN series b ON a.date = b.date WHERE a.symbol = '1-URGENT' AND b.symbol = '5-LOW'", "series"))
def j14(spark, sf):
    s = B.series(spark, sf)
    a = s.filter("symbol = '1-URGENT'").select("date", C("cents").alias("asset_cents"))
    return a.join(s.filter("symbol = '5-LOW'").select("date", C("cents").alias("benchmark_cents")), "date")


@query("j16_nearby_filings", sql(", a AS (SELECT person_id, filing_id, filed_date FROM filings WHERE status = 'P') SELECT a.filing_id, count(*) AS n_near, min(abs(b.filed_date - a.filed_date)) AS nearest_days FROM a JOIN filings b ON a.person_id = b.person_id AND a.filing_id <> b.filing_id AND abs(b.filed_date - a.filed_date) <= 45 GROUP BY 1", "filings"))
def j16(spark, sf):
    f = B.filings(spark, sf)
    a = f.filter("status = 'P'").select("person_id", "filing_id", "filed_date")
    b = f.select("person_id", C("filing_id").alias("other_id"), C("filed_date").alias("other_date"))
    pairs = temporal.band_join(a, b, "person_id", "filed_date", "other_date", 45).filter("filing_id <> other_id")
    return pairs.groupBy("filing_id").agg(ONE().alias("n_near"), F.min(F.abs(F.datediff("other_date", "filed_date"))).cast("long").alias("nearest_days"))


@query("j19_null_safe_duplicates", sql(", k AS (SELECT person_id, trade_date, action, nullif(ticker, 'P7') AS ticker, min(filing_id) AS first_filing, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4) SELECT person_id, trade_date, action, ticker, first_filing, n FROM k WHERE n > 1", "trades"))
def j19(spark, sf):
    t = B.trades(spark, sf).withColumn("ticker", F.nullif(C("ticker"), F.lit("P7")))
    return t.groupBy("person_id", "trade_date", "action", "ticker").agg(F.min("filing_id").alias("first_filing"), ONE().alias("n")).filter("n > 1")


@query("j20_alias_in_text", "WITH a(alias, pos) AS (VALUES ('red', 0), ('ring', 1), ('widget', 2), ('small', 3)) SELECT p_partkey, arg_min(alias, pos) AS alias FROM part JOIN a ON contains(p_name, alias) GROUP BY 1")
def j20(spark, sf):
    names = F.array(*[F.lit(x) for x in ("red", "ring", "widget", "small")])
    hit = F.filter(names, lambda a: F.contains(C("p_name"), a))
    return B.table(spark, sf, "part").select("p_partkey", F.get(hit, F.lit(0)).alias("alias")).filter("alias is not null")


# -- aggregates


@query("a6_median_and_percentiles", sql("SELECT filing_type, median(cents) AS median_cents, quantile_disc(cents, 0.95) AS p95_cents, CAST(count(*) AS BIGINT) AS n FROM filings GROUP BY 1", "filings"))
def a6(spark, sf):
    return B.filings(spark, sf).groupBy("filing_type").agg(F.median("cents").alias("median_cents"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY cents)").cast("long").alias("p95_cents"), ONE().alias("n"))


@query("a8_conditional_counts", sql("SELECT person_id, CAST(count(*) FILTER (action = 'BUY') AS BIGINT) AS buys, CAST(count(*) FILTER (action = 'SELL') AS BIGINT) AS sells, CAST(count(*) FILTER (lag_days < 0) AS BIGINT) AS negative_lag, CAST(count(*) FILTER (confidence_pct < 50) AS BIGINT) AS low_confidence, CAST(sum(value_cents) AS BIGINT) AS cents FROM trades GROUP BY 1", "trades"))
def a8(spark, sf):
    return B.trades(spark, sf).groupBy("person_id").agg(
        count_if(C("action") == "BUY").alias("buys"), count_if(C("action") == "SELL").alias("sells"), count_if(C("lag_days") < 0).alias("negative_lag"),
        count_if(C("confidence_pct") < 50).alias("low_confidence"), F.sum("value_cents").alias("cents"),
    )


@query("a11_two_level_rollup", sql("SELECT branch, filing_type, count(*) AS n, count(DISTINCT person_id) AS people FROM people JOIN filings USING (person_id) GROUP BY GROUPING SETS ((branch, filing_type), (branch))", "people", "filings"))
def a11(spark, sf):
    j = B.people(spark, sf).select("person_id", "branch").join(B.filings(spark, sf), "person_id")
    each = j.groupBy("branch", "filing_type", "person_id").agg(ONE().alias("n"))
    fine = each.groupBy("branch", "filing_type").agg(F.sum("n").alias("n"), ONE().alias("people"))
    whole = each.groupBy("branch", "person_id").agg(F.sum("n").alias("n")).groupBy("branch").agg(F.sum("n").alias("n"), ONE().alias("people"))
    return fine.unionByName(whole.withColumn("filing_type", F.lit(None).cast("string")))


@query("a13_sorted_sets", sql("SELECT person_id, string_agg(DISTINCT asset_class, '|' ORDER BY asset_class) AS classes, count(DISTINCT ticker) AS n_tickers FROM trades GROUP BY 1", "trades"))
def a13(spark, sf):
    return B.trades(spark, sf, parts=True).groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("asset_class")), "|").alias("classes"), F.countDistinct("ticker").alias("n_tickers"))


@query("a14_most_complete_row", sql("SELECT person_id, arg_max(filing_id, (cents, filing_id)) AS filing_id, max(cents) AS cents FROM filings GROUP BY 1", "filings"))
def a14(spark, sf):
    best = F.max(F.struct("cents", "filing_id"))
    return B.filings(spark, sf).groupBy("person_id").agg(best.alias("b")).select("person_id", "b.filing_id", "b.cents")


@query("a15_month_pivot", sql(", m AS (SELECT date_trunc('month', date)::DATE AS month, symbol, arg_max(cents, date) AS v FROM series GROUP BY 1, 2) SELECT month, max(v) FILTER (symbol = '1-URGENT') AS urgent, max(v) FILTER (symbol = '5-LOW') AS low FROM m WHERE symbol IN ('1-URGENT', '5-LOW') GROUP BY 1 HAVING count(*) = 2", "series"))
def a15(spark, sf):
    m = B.series(spark, sf).groupBy(F.trunc("date", "month").alias("month")).pivot("symbol", ["1-URGENT", "5-LOW"]).agg(F.max_by("cents", "date"))
    return m.select("month", C("1-URGENT").alias("urgent"), C("5-LOW").alias("low")).na.drop()


@query("a17_duplicate_keys", sql("SELECT filing_id, line, count(*) AS n FROM trades GROUP BY 1, 2 HAVING count(*) > 1", "trades"))
def a17(spark, sf):
    """Keys of several trades. Lines are counted before they meet the orders, which only the few repeated keys then do."""
    orders = B.table(spark, sf, "orders").groupBy(C("o_orderkey").alias("filing_id")).agg(ONE().alias("orders"))
    lines = B.table(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("filing_id"), C("l_linenumber").cast("long").alias("line")).agg(ONE().alias("lines"))
    again = orders.filter("orders > 1").select("filing_id", F.lit(True).alias("again"))
    some = lines.join(again, "filing_id", "left").filter("lines > 1 or again").drop("again")
    return some.join(orders, "filing_id").select("filing_id", "line", (C("lines") * C("orders")).alias("n"))


@query("a21_adaptive_bins", sql(", s AS (SELECT min(trade_date) AS lo, greatest(7, CAST(ceil((max(trade_date) - min(trade_date)) / 40.0) AS BIGINT)) AS w FROM trades) SELECT CAST(floor((trade_date - lo) / w) AS BIGINT) AS bin, action, count(*) AS n, CAST(sum(value_cents) AS BIGINT) AS cents FROM trades, s GROUP BY 1, 2", "trades"))
def a21(spark, sf):
    t = B.trades(spark, sf).groupBy("trade_date", "action").agg(ONE().alias("n"), F.sum("value_cents").alias("cents"))
    span = t.agg(F.min("trade_date").alias("lo"), F.greatest(F.lit(7), F.ceil(F.datediff(F.max("trade_date"), F.min("trade_date")) / 40.0)).alias("w"))
    b = F.floor(F.datediff("trade_date", "lo") / C("w"))
    return t.crossJoin(F.broadcast(span)).groupBy(b.alias("bin"), "action").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@query("a22_active_by_year", sql(", y AS (SELECT person_id, year(min(filed_date)) AS a, year(max(filed_date)) AS b FROM filings GROUP BY 1) SELECT CAST(u AS BIGINT) AS active_year, count(DISTINCT person_id) AS people FROM (SELECT person_id, unnest(range(a, b + 1)) AS u FROM y) GROUP BY 1", "filings"))
def a22(spark, sf):
    y = B.filings(spark, sf).groupBy("person_id").agg(F.year(F.min("filed_date")).alias("a"), F.year(F.max("filed_date")).alias("b"))
    return y.select(F.explode(F.sequence(C("a").cast("long"), C("b").cast("long"))).alias("active_year")).groupBy("active_year").agg(ONE().alias("people"))


@query("a23_weekly_growth", sql(", w AS (SELECT date_trunc('week', filed_date)::DATE AS week, count(*) AS n FROM filings GROUP BY 1) SELECT week, n, n - lag(n) OVER (ORDER BY week) AS delta FROM w", "filings"))
def a23(spark, sf):
    w = B.filings(spark, sf).groupBy(F.date_trunc("week", "filed_date").cast("date").alias("week")).agg(ONE().alias("n"))
    return w.withColumn("delta", C("n") - F.lag("n").over(Window.orderBy("week")))


@query("a24_confusion", sql(", c AS (SELECT cents > 20000000 AS said, status = 'P' AS truth FROM filings), m AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM c), r AS (SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 4), 0.0) AS precision_, coalesce(round(tp / nullif(tp + fn, 0), 4), 0.0) AS recall FROM m) SELECT tp, fp, fn, tn, precision_, recall, coalesce(round(2 * precision_ * recall / nullif(precision_ + recall, 0), 4), 0.0) AS f1 FROM r", "filings"))
def a24(spark, sf):
    said, truth = C("cents") > 20000000, C("status") == "P"
    m = B.filings(spark, sf).agg(count_if(said & truth).alias("tp"), count_if(said & ~truth).alias("fp"), count_if(~said & truth).alias("fn"), count_if(~said & ~truth).alias("tn"))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    m = m.withColumn("precision_", share(C("tp"), C("tp") + C("fp"))).withColumn("recall", share(C("tp"), C("tp") + C("fn")))
    return m.withColumn("f1", share(2 * C("precision_") * C("recall"), C("precision_") + C("recall")))


# -- windows


@query("w2_top_per_group", sql("SELECT person_id, filing_id, cents, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY cents DESC, filing_id DESC) AS r FROM filings) WHERE r <= 2", "filings"))
def w2(spark, sf):
    return windows.top_per_group(B.filings(spark, sf), ["person_id"], [C("cents").desc(), C("filing_id").desc()], 2).select("person_id", "filing_id", "cents", "rank")


@query("w3_quota_per_year", sql("SELECT yr, filing_type, filing_id, CAST(r AS INTEGER) AS selection_rank FROM (SELECT CAST(year(filed_date) AS BIGINT) AS yr, filing_type, filing_id, row_number() OVER (PARTITION BY year(filed_date), filing_type ORDER BY cents DESC, filing_id) AS r FROM filings) WHERE r <= 3 + CAST(filing_type LIKE '1%' AS INTEGER) * 2", "filings"))
def w3(spark, sf):
    f = B.filings(spark, sf).withColumn("yr", F.year("filed_date").cast("long"))
    top = windows.top_per_group(f, ["yr", "filing_type"], [C("cents").desc(), C("filing_id")], 5, "selection_rank")
    return top.filter(C("selection_rank") <= F.when(C("filing_type").startswith("1"), 5).otherwise(3)).select("yr", "filing_type", "filing_id", "selection_rank")


@query("w4_best_margin", sql("SELECT person_id, cents AS best, cents - coalesce(lead(cents) OVER w, 0) AS margin FROM filings WINDOW w AS (PARTITION BY person_id ORDER BY cents DESC, filing_id) QUALIFY row_number() OVER w = 1", "filings"))
def w4(spark, sf):
    top = windows.top_per_group(B.filings(spark, sf), ["person_id"], [C("cents").desc(), C("filing_id")], 2)
    best, second = (F.max(F.when(C("rank") == k, C("cents"))) for k in (1, 2))
    return top.groupBy("person_id").agg(best.alias("best"), (best - F.coalesce(second, F.lit(0))).alias("margin"))


@query("w5_ambiguous_best", sql(", s AS (SELECT DISTINCT person_id, party, length(full_name) % 3 + person_id % 4 AS score, state FROM people), b AS (SELECT state, max(score) AS m FROM s GROUP BY 1), t AS (SELECT state, m, count(DISTINCT party) AS n, min(party) AS pick FROM s JOIN b USING (state) WHERE score = m GROUP BY 1, 2) SELECT state, CASE WHEN m < 4 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, m AS best_score, CASE WHEN m >= 4 AND n = 1 THEN pick END AS party FROM t", "people"))
def w5(spark, sf):
    p = B.people(spark, sf).withColumn("score", F.length("full_name") % 3 + C("person_id") % 4)
    return windows.best_or_ambiguous(p, "state", "party", "score", 4)


@query("w6_extreme_moves", sql(", m AS (SELECT symbol, date, cents, lag(cents) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM series) SELECT symbol, date, cents, prev, abs(cents - prev) * 100 >= 35 * prev AS extreme FROM m WHERE prev IS NOT NULL", "series"))
def w6(spark, sf):
    m = B.series(spark, sf).withColumn("prev", F.lag("cents").over(Window.partitionBy("symbol").orderBy("date"))).filter("prev is not null")
    return m.select("symbol", "date", "cents", "prev", (F.abs(C("cents") - C("prev")) * 100 >= 35 * C("prev")).alias("extreme"))


@query("w7_session_windows", sql("SELECT symbol, date, lag(cents, 5) OVER w AS before_5, lead(cents, 5) OVER w AS after_5, lead(cents, 20) OVER w AS after_20 FROM series WINDOW w AS (PARTITION BY symbol ORDER BY date)", "series"))
def w7(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    return B.series(spark, sf).select("symbol", "date", F.lag("cents", 5).over(w).alias("before_5"), F.lead("cents", 5).over(w).alias("after_5"), F.lead("cents", 20).over(w).alias("after_20"))


@query("w8_trade_clusters", sql(", d AS (SELECT person_id, trade_date, CASE WHEN trade_date - lag(trade_date) OVER (PARTITION BY person_id ORDER BY trade_date) > 14 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT person_id, trade_date FROM trades)), c AS (SELECT person_id, trade_date, sum(s) OVER (PARTITION BY person_id ORDER BY trade_date) AS cluster FROM d) SELECT person_id, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n, CAST(sum(value_cents) AS BIGINT) AS cents FROM trades JOIN c USING (person_id, trade_date) GROUP BY person_id, cluster HAVING count(*) > 1", "trades"))
def w8(spark, sf):
    t = windows.gap_clusters(B.trades(spark, sf), "person_id", "trade_date", 14)
    return t.groupBy("person_id", "cluster").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), ONE().alias("n"), F.sum("value_cents").alias("cents")).filter("n > 1").drop("cluster")


@query("w9_service_periods", sql(", s AS (SELECT DISTINCT person_id, filed_date AS a, filed_date + CAST(filing_id % 400 AS INTEGER) AS b FROM filings), m AS (SELECT *, max(b) OVER (PARTITION BY person_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN a - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), p AS (SELECT person_id, min(a) AS period_start, max(b) AS period_end FROM i GROUP BY person_id, island) SELECT person_id, period_start, period_end, CAST(coalesce(sum(period_end - period_start + 1) OVER (PARTITION BY person_id ORDER BY period_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS days_before FROM p", "filings"))
def w9(spark, sf):
    s = B.filings(spark, sf).select("person_id", C("filed_date").alias("a"), F.date_add("filed_date", (C("filing_id") % 400).cast("int")).alias("b"))
    return windows.merged_periods(s, "person_id", "a", "b")


@query("w12_rebase", sql("SELECT symbol, date, round(cents * 100.0 / first_value(cents) OVER (PARTITION BY symbol ORDER BY date), 3) AS rebased FROM series WHERE date >= DATE '1996-01-01' AND cents > 0", "series"))
def w12(spark, sf):
    s = B.series(spark, sf).filter((C("date") >= "1996-01-01") & (C("cents") > 0))
    first = F.first("cents").over(Window.partitionBy("symbol").orderBy("date"))
    return s.select("symbol", "date", F.round(C("cents") * F.lit(100.0) / first, 3).alias("rebased"))


@query("w16_primary_role", sql("SELECT person_id, arg_max(filing_id, (status = 'O', filed_date, filing_id)) AS role_id FROM filings GROUP BY 1", "filings"))
def w16(spark, sf):
    return B.filings(spark, sf).groupBy("person_id").agg(F.max_by("filing_id", F.struct(C("status") == "O", "filed_date", "filing_id")).alias("role_id"))


# -- sets, text, dates


@query("s2_union_last_wins", sql(", u AS (SELECT person_id AS id, full_name AS name, 0 AS p FROM people UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) SELECT id, arg_max(name, p) AS name FROM u GROUP BY 1", "people"))
def s2(spark, sf):
    a = B.people(spark, sf).select(C("person_id").alias("id"), C("full_name").alias("name"), F.lit(0).alias("p"))
    b = B.table(spark, sf, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name"), F.lit(1).alias("p"))
    return a.unionByName(b).groupBy("id").agg(F.max_by("name", "p").alias("name"))


@query("s4_key_reconciliation", sql(", f AS (SELECT DISTINCT user_id * 11 AS person_id FROM civic_events) (SELECT person_id, 'no_filing' AS side FROM (SELECT person_id FROM people EXCEPT SELECT person_id FROM f)) UNION ALL (SELECT person_id, 'no_person' FROM (SELECT person_id FROM f EXCEPT SELECT person_id FROM people))", "people", "civic_events"))
def s4(spark, sf):
    """Keys of the index and of the partitions that the other side lacks; users stand for every eleventh person, and beyond."""
    p, f = B.people(spark, sf).select("person_id").distinct(), B.civic_events(spark, sf).select((C("user_id") * 11).alias("person_id")).distinct()
    return p.join(f, "person_id", "left_anti").withColumn("side", F.lit("no_filing")).unionByName(f.join(p, "person_id", "left_anti").withColumn("side", F.lit("no_person")))


@query("st1_fold_and_slug", f"SELECT p_partkey, trim(regexp_replace(translate(lower(p_name), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', ' ', 'g')) AS folded, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def st1(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", T.fold(C("p_name")).alias("folded"), T.slug(C("p_brand")).alias("slug"))


@query("st6_canonical_url", r"""WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, u, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|mc_[^=]*|email_[^=]*|ref)(=|$)'))) AS kept FROM b)
SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+://[^/?]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/{2,}', '/', 'g'), '/$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM q""")
def st6(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.canonical_url(C("url")).alias("url"))


@query("h1_row_signatures", sql("SELECT filing_id, substr(sha256(person_id || '|' || CAST(filed_date AS VARCHAR) || '|' || filing_type), 1, 24) AS signature FROM filings", "filings"))
def h1(spark, sf):
    return B.filings(spark, sf).select("filing_id", F.substring(F.sha2(F.concat_ws("|", C("person_id").cast("string"), C("filed_date").cast("string"), "filing_type"), 256), 1, 24).alias("signature"))


@query("d5_calendar_spine", sql(", b AS (SELECT date_trunc('month', trade_date)::DATE AS bucket, count(*) AS n FROM trades WHERE ticker = 'P3' GROUP BY 1), s AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 MONTH))::DATE AS bucket FROM b) SELECT s.bucket, coalesce(n, 0) AS n, n IS NULL AS gap FROM s LEFT JOIN b USING (bucket)", "trades"))
def d5(spark, sf):
    b = B.trades(spark, sf).filter("ticker = 'P3'").groupBy(F.trunc("trade_date", "month").alias("bucket")).agg(ONE().alias("n"))
    spine = b.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo is not null").select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("bucket"))
    return spine.join(b, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), C("n").isNull().alias("gap"))


@query("ar2_term_dictionary", sql(", t AS (SELECT DISTINCT state AS term FROM people), d AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS code FROM t) SELECT person_id, code FROM people JOIN d ON state = term", "people"))
def ar2(spark, sf):
    p = B.people(spark, sf)
    codes = p.select("state").distinct().withColumn("code", F.row_number().over(Window.orderBy("state")) - 1)
    return p.join(F.broadcast(codes), "state").select("person_id", "code")
