"""Further operators of the inventory: facets, graph-like joins, dictionaries, dates, reconciliation and release checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import temporal, windows
from . import bindings as B
from .bindings import sql
from .relational import ONE, C, count_if

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


@query("f8_reviewed_candidates", sql("SELECT filing_id, cents FROM filings f WHERE status IN ('O', 'P') AND EXISTS (SELECT 1 FROM trades t WHERE t.filing_id = f.filing_id AND t.action = 'SELL') AND NOT EXISTS (SELECT 1 FROM trades t WHERE t.filing_id = f.filing_id AND t.lag_days > 365)", "filings", "trades"))
def f8(spark, sf):
    t = B.trades(spark, sf)
    f = B.filings(spark, sf).filter(C("status").isin("O", "P"))
    return f.join(t.filter("action = 'SELL'"), "filing_id", "left_semi").join(t.filter("lag_days > 365"), "filing_id", "left_anti").select("filing_id", "cents")


@query("f10_search_documents", sql("SELECT person_id FROM people WHERE contains(lower(concat_ws(' ', full_name, branch, state, chamber, party)), 'executive nation_1 ')", "people"))
def f10(spark, sf):
    doc = F.lower(F.concat_ws(" ", "full_name", "branch", "state", "chamber", "party"))
    return B.people(spark, sf).filter(F.contains(doc, F.lit("executive nation_1 "))).select("person_id")


@query("f11_event_visibility", sql("SELECT event_id, CASE WHEN event_type = 'error' THEN 'hidden' WHEN k >= 50 THEN 'macro' ELSE 'focused' END AS visibility FROM civic_events", "civic_events"))
def f11(spark, sf):
    return B.civic_events(spark, sf).select("event_id", F.when(C("event_type") == "error", "hidden").when(C("k") >= 50, "macro").otherwise("focused").alias("visibility"))


@query("f15_provenance_complete", "SELECT page_id, coalesce(length(url) > 0, FALSE) AND coalesce(length(html) > 1000, FALSE) AS complete, sha256(coalesce(html, '')) AS file_hash FROM pages")
def f15(spark, sf):
    has = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    return B.table(spark, sf, "pages").select("page_id", (has("url", 0) & has("html", 1000)).alias("complete"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("file_hash"))


@query("f16_official_urls", r"SELECT page_id, regexp_matches(url, '^https://([a-z0-9-]+\.)*example\.(com|org)(/|$)') AS official FROM pages")
def f16(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", C("url").rlike(r"^https://([a-z0-9-]+\.)*example\.(com|org)(/|$)").alias("official"))


@query("j1_candidate_rows", sql("SELECT t.filing_id, t.line, p.full_name, f.filing_type, t.action FROM trades t JOIN filings f ON t.filing_id = f.filing_id JOIN people p ON p.person_id = f.person_id WHERE t.lag_days BETWEEN 0 AND 30", "trades", "filings", "people"))
def j1(spark, sf):
    t = B.trades(spark, sf).filter(C("lag_days").between(0, 30)).select("filing_id", "line", "action")
    return t.join(B.filings(spark, sf), "filing_id").join(B.people(spark, sf), "person_id").select("filing_id", "line", "full_name", "filing_type", "action")


@query("j4_batch_stats", sql(", ids AS (SELECT CAST(i AS BIGINT) AS person_id FROM range(0, 400, 7) r(i)), s AS (SELECT person_id, count(*) AS n, median(lag_days) AS med FROM trades GROUP BY 1), f AS (SELECT person_id, max(filed_date) AS last_filed FROM filings GROUP BY 1) SELECT ids.person_id, coalesce(n, 0) AS n_trades, med AS median_lag, last_filed FROM ids LEFT JOIN s USING (person_id) LEFT JOIN f ON ids.person_id = f.person_id", "trades", "filings"))
def j4(spark, sf):
    ids = spark.range(0, 400, 7).toDF("person_id")
    s = B.trades(spark, sf).join(F.broadcast(ids), "person_id", "left_semi").groupBy("person_id").agg(ONE().alias("n"), F.median("lag_days").alias("median_lag"))
    f = B.filings(spark, sf).join(F.broadcast(ids), "person_id", "left_semi").groupBy("person_id").agg(F.max("filed_date").alias("last_filed"))
    return ids.join(s, "person_id", "left").join(f, "person_id", "left").select("person_id", F.coalesce("n", F.lit(0)).alias("n_trades"), "median_lag", "last_filed")


@query("j5_last_duplicate_wins", sql(", r AS (SELECT filing_id, arg_max(action, (line, trade_date, action)) AS resolution FROM trades GROUP BY 1) SELECT f.filing_id, r.resolution FROM filings f LEFT JOIN r USING (filing_id)", "filings", "trades"))
def j5(spark, sf):
    r = B.trades(spark, sf).groupBy("filing_id").agg(F.max_by("action", F.struct("line", "trade_date", "action")).alias("resolution"))
    return B.filings(spark, sf).select("filing_id").join(r, "filing_id", "left")


@query("j8_counter_union", sql(", a AS (SELECT state, count(*) AS n FROM people WHERE branch = 'Judicial' GROUP BY 1), b AS (SELECT state, count(*) AS n FROM people WHERE branch = 'Executive' AND party = 'BUILDING' GROUP BY 1) SELECT coalesce(a.state, b.state) AS state, coalesce(a.n, 0) AS judicial, coalesce(b.n, 0) AS executive FROM a FULL JOIN b ON a.state = b.state", "people"))
def j8(spark, sf):
    p = B.people(spark, sf)
    a = p.filter("branch = 'Judicial'").groupBy("state").agg(ONE().alias("a"))
    b = p.filter("branch = 'Executive' and party = 'BUILDING'").groupBy("state").agg(ONE().alias("b"))
    return a.join(b, "state", "full_outer").select("state", F.coalesce("a", F.lit(0)).alias("judicial"), F.coalesce("b", F.lit(0)).alias("executive"))


_ROLES = """, roles AS (SELECT filing_id AS role_id, person_id, filed_date AS a, filed_date + 300 AS b FROM filings WHERE status <> 'F')
SELECT t.filing_id, t.line, count(role_id) AS n_active, min(role_id) AS first_role FROM trades t LEFT JOIN roles r ON t.person_id = r.person_id AND t.trade_date >= a AND t.trade_date {op} b GROUP BY t.filing_id, t.line"""


def active_roles(spark, sf, closed: bool):
    """Roles active on the trade date: half-open, or closed at both ends. Rows repeat (filing_id, line)."""
    r = B.filings(spark, sf).filter("status <> 'F'").select("person_id", C("filing_id").alias("role_id"), C("filed_date").alias("a"), F.date_add("filed_date", 300).alias("b"))
    t = B.trades(spark, sf).select("filing_id", "line", "person_id", "trade_date")
    held = r if closed else r.withColumn("b", F.date_sub("b", 1))
    found = temporal.span_join(held, t, "person_id", "a", "b", "trade_date").groupBy("filing_id", "line").agg(F.count("role_id").alias("n_active"), F.min("role_id").alias("first_role"))
    return t.select("filing_id", "line").distinct().join(found, ["filing_id", "line"], "left").select("filing_id", "line", F.coalesce("n_active", F.lit(0)).alias("n_active"), "first_role")


QUERIES["j13_active_roles_half_open"] = lambda spark, sf: active_roles(spark, sf, False)
ORACLES["j13_active_roles_half_open"] = sql(_ROLES.format(op="<"), "filings", "trades")
QUERIES["j13_active_roles_closed"] = lambda spark, sf: active_roles(spark, sf, True)
ORACLES["j13_active_roles_closed"] = sql(_ROLES.format(op="<="), "filings", "trades")


@query("j21_crosswalk", sql(", x(party, agency) AS (VALUES ('BUILDING', 'hud'), ('BUILDING', 'gsa'), ('MACHINERY', 'doe'), ('HOUSEHOLD', 'hud')) SELECT agency, count(*) AS n, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM people JOIN x USING (party) GROUP BY 1", "people"))
def j21(spark, sf):
    x = spark.createDataFrame([("BUILDING", ["hud", "gsa"]), ("MACHINERY", ["doe"]), ("HOUSEHOLD", ["hud"])], "party string, agencies array<string>")
    j = B.people(spark, sf).join(F.broadcast(x), "party").select("state", F.explode("agencies").alias("agency"))
    return j.groupBy("agency").agg(ONE().alias("n"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))


def latest_active(o, e):
    """The officer with the latest start, then the largest id, among those active on each event date."""
    days = o.select("officer", "a", F.explode(F.sequence("a", F.date_add("a", 89))).alias("date"))
    return e.select("date").distinct().join(days, "date").groupBy("date").agg(F.max_by("officer", F.struct("a", "officer")).alias("officer"))


@query("j22_latest_active", sql(", o AS (SELECT filing_id AS officer, filed_date AS a, filed_date + 90 AS b FROM filings), e AS (SELECT DISTINCT date FROM civic_events) SELECT date, arg_max(officer, (a, officer)) AS officer FROM e JOIN o ON date >= a AND date < b GROUP BY 1", "filings", "civic_events"))
def j22(spark, sf):
    # Of officers with the same start only the largest id can win, so one row a start date is enough.
    return latest_active(B.filings(spark, sf).groupBy(C("filed_date").alias("a")).agg(F.max("filing_id").alias("officer")), B.civic_events(spark, sf))


QUERIES["j22_latest_active_all"], ORACLES["j22_latest_active_all"] = j22, ORACLES["j22_latest_active"]


@query("a3_counts_by_source", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY 1, 2")
def a3(spark, sf):
    return B.table(spark, sf, "documents").groupBy("source", "lang").agg(ONE().alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("a10_multi_key_counters", sql("SELECT branch, CAST(year(filed_date) AS BIGINT) AS term, filing_type, count(*) AS n, count(DISTINCT person_id) AS people FROM people JOIN filings USING (person_id) GROUP BY 1, 2, 3", "people", "filings"))
def a10(spark, sf):
    j = B.filings(spark, sf).join(B.people(spark, sf).select("person_id", "branch"), "person_id")
    return j.groupBy("branch", F.year("filed_date").cast("long").alias("term"), "filing_type").agg(ONE().alias("n"), F.countDistinct("person_id").alias("people"))


@query("a12_exploded_counter", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def a12(spark, sf):
    return B.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(ONE().alias("n"))


@query("a16_coverage_diagnostics", sql("SELECT count(*) AS n, count(*) FILTER (lag_days < 0) AS negative, count(*) FILTER (confidence_pct >= 90) AS confident, count(DISTINCT ticker) AS tickers, min(trade_date) AS first_date, max(trade_date) AS last_date FROM trades", "trades"))
def a16(spark, sf):
    return B.trades(spark, sf).agg(ONE().alias("n"), count_if(C("lag_days") < 0).alias("negative"), count_if(C("confidence_pct") >= 90).alias("confident"), F.countDistinct("ticker").alias("tickers"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query("a18_duplicate_report", "WITH k AS (SELECT lower(trim(p_name)) AS name, p_brand, count(*) AS n, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part GROUP BY 1, 2) SELECT * FROM k WHERE n > 1")
def a18(spark, sf):
    k = B.table(spark, sf, "part").groupBy(F.lower(F.trim("p_name")).alias("name"), "p_brand").agg(ONE().alias("n"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id"))
    return k.filter("n > 1")


@query("w1_ranked_display", sql("SELECT person_id, filing_id, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w <= 3 AS displayed FROM filings WINDOW w AS (PARTITION BY person_id ORDER BY cents DESC, filed_date, filing_id)", "filings"))
def w1(spark, sf):
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(C("cents").desc(), "filed_date", "filing_id"))
    return B.filings(spark, sf).select("person_id", "filing_id", rank.alias("rank")).withColumn("displayed", C("rank") <= 3)


@query("w10_career_day", sql(", s AS (SELECT DISTINCT person_id, filed_date AS a, filed_date + 100 AS b FROM filings), m AS (SELECT *, max(b) OVER (PARTITION BY person_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN a - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), p AS (SELECT person_id, min(a) AS ps, max(b) AS pe FROM i GROUP BY person_id, island), o AS (SELECT *, coalesce(sum(pe - ps + 1) OVER (PARTITION BY person_id ORDER BY ps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), t AS (SELECT DISTINCT person_id, trade_date FROM trades) SELECT t.person_id, t.trade_date, CAST(before + (trade_date - ps) AS BIGINT) AS career_day FROM t LEFT JOIN o ON t.person_id = o.person_id AND trade_date BETWEEN ps AND pe", "filings", "trades"))
def w10(spark, sf):
    s = B.filings(spark, sf).select("person_id", C("filed_date").alias("a"), F.date_add("filed_date", 100).alias("b"))
    o = windows.merged_periods(s, "person_id", "a", "b")
    t = B.trades(spark, sf).select("person_id", "trade_date").distinct()
    j = temporal.span_join(o, t, "person_id", "period_start", "period_end", "trade_date")
    return t.join(j, ["person_id", "trade_date"], "left").select("person_id", "trade_date", (C("days_before") + F.datediff("trade_date", "period_start")).alias("career_day"))


@query("w11_out_of_order", "SELECT event_type, count(*) AS n, CAST(count(*) FILTER (user_id < p) AS BIGINT) AS out_of_order FROM (SELECT event_type, user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1")
def w11(spark, sf):
    e = B.table(spark, sf, "events").select("event_type", "user_id", F.lag("user_id").over(Window.partitionBy("event_type").orderBy("event_id")).alias("p"))
    return e.groupBy("event_type").agg(ONE().alias("n"), count_if(C("user_id") < C("p")).alias("out_of_order"))


@query("w13_downsample", sql("SELECT symbol, date, cents FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS r FROM series) WHERE r % 2 = 1 AND r < 64", "series"))
def w13(spark, sf):
    return windows.top_per_group(B.series(spark, sf), ["symbol"], ["date"], 63).filter("rank % 2 = 1").drop("rank")


@query("w15_latest_retained", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def w15(spark, sf):
    return B.table(spark, sf, "events").orderBy(C("ts").desc(), C("event_id").desc()).limit(200).select("event_id", "ts")


@query("st3_asset_names", r"SELECT p_partkey, upper(trim(regexp_replace(regexp_replace(p_name || ' [' || p_type || '] (' || p_brand || ')', '\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g'))) AS asset_name FROM part")
def st3(spark, sf):
    raw = F.concat("p_name", F.lit(" ["), "p_type", F.lit("] ("), "p_brand", F.lit(")"))
    return B.table(spark, sf, "part").select("p_partkey", F.upper(T.squeeze(F.regexp_replace(raw, r"\[[^\]]*\]", " "))).alias("asset_name"))


@query("st9_action_codes", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' WHEN 'N' THEN 'EXCHANGE' ELSE 'UNKNOWN' END AS action, CASE WHEN l_linestatus = 'F' THEN 'final' ELSE 'open' END AS state FROM lineitem")
def st9(spark, sf):
    code = F.when(C("l_returnflag") == "R", "SELL").when(C("l_returnflag") == "A", "BUY").when(C("l_returnflag") == "N", "EXCHANGE").otherwise("UNKNOWN")
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", code.alias("action"), F.when(C("l_linestatus") == "F", "final").otherwise("open").alias("state"))


@query("d1_date_formats", "WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'n/a' END AS s FROM orders) SELECT o_orderkey, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%m/%d/%Y')) AS DATE) AS parsed FROM d")
def d1(spark, sf):
    k = C("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("n/a")
    parsed = F.coalesce(*[F.expr(f"try_to_date(s, '{f}')") for f in ("yyyy-MM-dd", "MM/dd/yyyy")])
    return B.table(spark, sf, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", parsed.alias("parsed"))


@query("d6_freshness", sql(", m AS (SELECT max(filed_date) AS d FROM filings), l AS (SELECT filing_type, status, max(filed_date) AS latest FROM filings GROUP BY 1, 2) SELECT filing_type, status, CASE WHEN d - latest <= 3 THEN 'fresh' WHEN d - latest <= 7 THEN 'recent' WHEN d - latest > 14 THEN 'stale' ELSE 'aging' END AS band FROM l, m", "filings"))
def d6(spark, sf):
    f = B.filings(spark, sf)
    x = f.groupBy("filing_type", "status").agg(F.max("filed_date").alias("latest")).crossJoin(F.broadcast(f.agg(F.max("filed_date").alias("d"))))
    age = F.datediff("d", "latest")
    return x.select("filing_type", "status", F.when(age <= 3, "fresh").when(age <= 7, "recent").when(age > 14, "stale").otherwise("aging").alias("band"))


@query("m5_jaccard", sql(", s AS (SELECT person_id, list(DISTINCT ticker) AS t FROM trades GROUP BY 1), p AS (SELECT a.person_id, a.t AS x, b.t AS y FROM s a JOIN s b ON b.person_id = a.person_id + 1) SELECT person_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM p", "trades"))
def m5(spark, sf):
    s = B.trades(spark, sf).groupBy("person_id").agg(F.collect_set("ticker").alias("x"))
    b = s.select((C("person_id") - 1).alias("person_id"), C("x").alias("y"))
    return s.join(b, "person_id").select("person_id", F.round(T.jaccard(C("x"), C("y")), 6).alias("jaccard"))


@query("dm2_static_scorecard", sql(", s AS (SELECT person_id, median(lag_days) AS med, count(*) FILTER (confidence_pct < 50) AS low FROM trades GROUP BY 1) SELECT p.person_id, 100 - CASE WHEN s.person_id IS NULL THEN 30 ELSE 0 END - CASE WHEN med > 90 THEN 25 WHEN med > 45 THEN 15 ELSE 0 END - CASE WHEN low > 0 THEN 10 ELSE 0 END AS score, concat_ws('; ', CASE WHEN s.person_id IS NULL THEN 'no trades' END, CASE WHEN med > 90 THEN 'very late' WHEN med > 45 THEN 'late' END, CASE WHEN low > 0 THEN 'low confidence' END) AS deductions FROM people p LEFT JOIN s USING (person_id)", "people", "trades"))
def dm2(spark, sf):
    s = B.trades(spark, sf).groupBy("person_id").agg(F.median("lag_days").alias("med"), count_if(C("confidence_pct") < 50).alias("low"), F.lit(True).alias("has"))
    x = B.people(spark, sf).join(s, "person_id", "left")
    none, late, low = C("has").isNull(), C("med"), C("low") > 0
    score = 100 - F.when(none, 30).otherwise(0) - F.when(late > 90, 25).when(late > 45, 15).otherwise(0) - F.when(low, 10).otherwise(0)
    why = F.concat_ws("; ", F.when(none, "no trades"), F.when(late > 90, "very late").when(late > 45, "late"), F.when(low, "low confidence"))
    return x.select("person_id", score.alias("score"), why.alias("deductions"))


def timeline(trades):
    """Trades and buys of each person by month, with the months without trades marked as gaps."""
    b = trades.groupBy("person_id", F.trunc("trade_date", "month").alias("bucket")).agg(ONE().alias("n"), count_if(C("action") == "BUY").alias("buys"))
    r = b.groupBy("person_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    s = r.select("person_id", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("bucket"))
    return s.join(b, ["person_id", "bucket"], "left").select("person_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("buys", F.lit(0)).alias("buys"), F.when(C("n").isNull(), "no_trades").alias("gap"))


@query("dm3_timeline", sql(", b AS (SELECT person_id, date_trunc('month', trade_date)::DATE AS bucket, count(*) AS n, CAST(count(*) FILTER (action = 'BUY') AS BIGINT) AS buys FROM trades GROUP BY 1, 2), r AS (SELECT person_id, min(bucket) AS lo, max(bucket) AS hi FROM b GROUP BY 1), s AS (SELECT person_id, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS bucket FROM r) SELECT person_id, bucket, coalesce(n, 0) AS n, coalesce(buys, 0) AS buys, CASE WHEN n IS NULL THEN 'no_trades' END AS gap FROM s LEFT JOIN b USING (person_id, bucket)", "trades"))
def dm3(spark, sf):
    return timeline(B.trades(spark, sf))


QUERIES["dm3_timeline_all"], ORACLES["dm3_timeline_all"] = dm3, ORACLES["dm3_timeline"]


@query("dm10_series_diagnostics", sql(", n AS (SELECT symbol, date, cents, lag(date) OVER w AS pd, lag(cents) OVER w AS pc FROM series WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, count(*) AS points, CAST(count(*) FILTER (date - pd > 7) AS BIGINT) AS gaps, CAST(count(*) FILTER (abs(cents - pc) * 100 >= 35 * pc) AS BIGINT) AS extreme, min(date) AS first_date, max(date) AS last_date FROM n GROUP BY 1", "series"))
def dm10(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    n = B.series(spark, sf).withColumn("pd", F.lag("date").over(w)).withColumn("pc", F.lag("cents").over(w))
    return n.groupBy("symbol").agg(ONE().alias("points"), count_if(F.datediff("date", "pd") > 7).alias("gaps"), count_if(F.abs(C("cents") - C("pc")) * 100 >= 35 * C("pc")).alias("extreme"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("dm17_relevance_tier", sql("SELECT event_id, CASE WHEN k % 10 = 0 THEN 'direct' WHEN event_type = 'error' THEN 'macro' WHEN k > 80 THEN 'asset_specific' WHEN k > 50 THEN 'jurisdictional' WHEN k > 20 THEN 'sector' ELSE 'general' END AS tier, CASE WHEN k % 10 = 0 THEN 6 WHEN event_type = 'error' THEN 5 WHEN k > 80 THEN 4 WHEN k > 50 THEN 3 WHEN k > 20 THEN 1 ELSE 0 END AS tier_rank FROM civic_events", "civic_events"))
def dm17(spark, sf):
    ladder = [(C("k") % 10 == 0, "direct", 6), (C("event_type") == "error", "macro", 5), (C("k") > 80, "asset_specific", 4), (C("k") > 50, "jurisdictional", 3), (C("k") > 20, "sector", 1)]
    tier, rank = F.lit("general"), F.lit(0)
    for when, name, n in reversed(ladder):
        tier, rank = F.when(when, name).otherwise(tier), F.when(when, n).otherwise(rank)
    return B.civic_events(spark, sf).select("event_id", tier.alias("tier"), rank.alias("tier_rank"))


@query("dm30_batch_digest", sql(", b AS (SELECT filing_id FROM filings WHERE status = 'P' ORDER BY cents DESC, filing_id LIMIT 50) SELECT count(*) AS n, sha256(string_agg(CAST(filing_id AS VARCHAR), ',' ORDER BY filing_id)) AS digest FROM b", "filings"))
def dm30(spark, sf):
    b = B.filings(spark, sf).filter("status = 'P'").orderBy(C("cents").desc(), "filing_id").limit(50)
    return b.agg(ONE().alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("filing_id")), lambda x: x.cast("string")), ","), 256).alias("digest"))


@query("dm33_promotion_gate", sql(", g AS (SELECT filing_id, list_filter([CASE WHEN cents IS NULL OR cents <= 0 THEN 'amount' END, CASE WHEN status = 'P' THEN 'pending' END, CASE WHEN filing_type LIKE '4%' THEN 'unspecified' END, CASE WHEN filed_date > DATE '2001-01-01' THEN 'too_recent' END], lambda x: x IS NOT NULL) AS failed FROM filings) SELECT filing_id, len(failed) = 0 AS eligible, array_to_string(failed, '|') AS failed FROM g", "filings"))
def dm33(spark, sf):
    failed = F.array_compact(F.array(F.when(C("cents").isNull() | (C("cents") <= 0), "amount"), F.when(C("status") == "P", "pending"), F.when(C("filing_type").startswith("4"), "unspecified"), F.when(C("filed_date") > "2001-01-01", "too_recent")))
    return B.filings(spark, sf).select("filing_id", failed.alias("f")).select("filing_id", (F.size("f") == 0).alias("eligible"), F.array_join("f", "|").alias("failed"))


@query("dm41_telemetry", "WITH r AS (SELECT user_id AS source_id, CAST(epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS BIGINT) AS seconds, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1) SELECT count(*) AS runs, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95, max(seconds) AS longest, CAST(count(*) FILTER (failures > 0) AS BIGINT) AS failed_runs FROM r")
def dm41(spark, sf):
    secs = F.unix_seconds(F.max(C("ts").cast("timestamp"))) - F.unix_seconds(F.min(C("ts").cast("timestamp")))
    r = B.table(spark, sf, "events").groupBy("user_id").agg(secs.alias("seconds"), count_if(C("event_type") == "error").alias("failures"))
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)").cast("long")
    return r.agg(ONE().alias("runs"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max("seconds").alias("longest"), count_if(C("failures") > 0).alias("failed_runs"))


@query("dm58_official_index", sql(", f AS (SELECT person_id, count(*) AS n_roles, CAST(min(year(filed_date)) AS BIGINT) AS first_year, CAST(max(year(filed_date)) AS BIGINT) AS last_year, string_agg(DISTINCT filing_type, '|' ORDER BY filing_type) AS kinds FROM filings GROUP BY 1) SELECT person_id, lower(full_name) AS search, branch, n_roles, first_year, last_year, kinds FROM people JOIN f USING (person_id)", "people", "filings"))
def dm58(spark, sf):
    y = F.year("filed_date").cast("long")
    f = B.filings(spark, sf).groupBy("person_id").agg(ONE().alias("n_roles"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.array_join(F.array_sort(F.collect_set("filing_type")), "|").alias("kinds"))
    return B.people(spark, sf).join(f, "person_id").select("person_id", F.lower("full_name").alias("search"), "branch", "n_roles", "first_year", "last_year", "kinds")


@query("v2_role_conflicts", sql("SELECT left(full_name, 17) AS full_name, count(DISTINCT branch) AS branches, count(*) AS n FROM people GROUP BY 1 HAVING count(DISTINCT branch) > 1 OR count(*) > 1", "people"))
def v2(spark, sf):
    """Names held by several people or in several branches; a name's last digit is left out, so that there are some."""
    return B.people(spark, sf).withColumn("full_name", F.substring("full_name", 1, 17)).groupBy("full_name").agg(F.countDistinct("branch").alias("branches"), ONE().alias("n")).filter("branches > 1 or n > 1")


@query("v6_trades_outside_periods", sql(", p AS (SELECT person_id, min(filed_date) - 365 AS a, max(filed_date) + 365 AS b FROM filings GROUP BY 1) SELECT filing_id, line, trade_date FROM trades t LEFT JOIN p ON t.person_id = p.person_id WHERE a IS NULL OR trade_date < a OR trade_date > b", "filings", "trades"))
def v6(spark, sf):
    p = B.filings(spark, sf).groupBy("person_id").agg(F.date_sub(F.min("filed_date"), 365).alias("a"), F.date_add(F.max("filed_date"), 365).alias("b"))
    return B.trades(spark, sf).join(p, "person_id", "left").filter("a is null or trade_date < a or trade_date > b").select("filing_id", "line", "trade_date")
