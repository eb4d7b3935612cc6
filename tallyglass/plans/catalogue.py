"""Searches, sorts, set operations, scalar functions and checks that the other plans leave open."""

from __future__ import annotations

from functools import reduce

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


# -- searches, sorts and pages


@query("f3_role_search", sql("SELECT f.filing_id, p.full_name FROM filings f JOIN people p USING (person_id) WHERE p.chamber = 'ASIA' AND (f.filing_type ILIKE '%urgent%' OR p.full_name ILIKE '%0001%')", "people", "filings"))
def f3(spark, sf):
    p = B.people(spark, sf).filter("chamber = 'ASIA'").select("person_id", "full_name")
    wanted = C("filing_type").ilike("%urgent%") | C("full_name").ilike("%0001%")
    return B.filings(spark, sf).join(p, "person_id").filter(wanted).select("filing_id", "full_name")


@query("f5_evidence_search", "SELECT event_id FROM events WHERE event_type ILIKE '%urch%' OR props ILIKE '%\"k\": 7%'")
def f5(spark, sf):
    return B.table(spark, sf, "events").filter(C("event_type").ilike("%urch%") | C("props").ilike('%"k": 7%')).select("event_id")


@query("f9_roster_facets", sql(", k AS (SELECT person_id, list(DISTINCT filing_type) AS kinds, max(filed_date) AS latest FROM filings GROUP BY 1) SELECT person_id, latest >= DATE '2000-01-01' AS active FROM k WHERE list_contains(kinds, '1-URGENT') AND list_contains(kinds, '5-LOW')", "filings"))
def f9(spark, sf):
    k = B.filings(spark, sf).groupBy("person_id").agg(F.collect_set("filing_type").alias("kinds"), F.max("filed_date").alias("latest"))
    both = F.array_contains("kinds", "1-URGENT") & F.array_contains("kinds", "5-LOW")
    return k.filter(both).select("person_id", (C("latest") >= F.lit("2000-01-01").cast("date")).alias("active"))


@query("f12_asset_window", sql("SELECT filing_id, line, abs(trade_date - DATE '1997-07-01') AS distance FROM trades WHERE ticker = split_part('ticker:P3', ':', 2) AND abs(trade_date - DATE '1997-07-01') <= 30", "trades"))
def f12(spark, sf, asset: str = "ticker:P3", center: str = "1997-07-01", days: int = 30):
    kind, _, value = asset.partition(":")
    distance = F.abs(F.datediff("trade_date", F.lit(center).cast("date"))).cast("long")
    column = {"ticker": "ticker", "class": "asset_class"}[kind]
    return B.trades(spark, sf, parts=column == "asset_class").filter(C(column) == value).select("filing_id", "line", distance.alias("distance")).filter(C("distance") <= days)


def dynamic_sort(frame, wanted: str, allowed: dict, default: str, ties: list):
    """Order by an allowed column (-name: descending); an unknown name falls back to the default."""
    name = wanted.lstrip("-")
    column = allowed.get(name, allowed[default])
    down = wanted.startswith("-") and name in allowed
    return frame.orderBy(column.desc_nulls_last() if down else column.asc_nulls_last(), *ties)


@query("l1_dynamic_sort", sql("SELECT filing_id, cents FROM filings ORDER BY cents DESC NULLS LAST, filing_id LIMIT 40", "filings"))
def l1(spark, sf):
    return dynamic_sort(B.filings(spark, sf), "-amount", {"amount": C("cents"), "filed": C("filed_date")}, "filed", ["filing_id"]).limit(40).select("filing_id", "cents")


@query("l1_sort_fallback", sql("SELECT filing_id, filed_date FROM filings ORDER BY filed_date NULLS LAST, filing_id LIMIT 40", "filings"))
def l1_fallback(spark, sf):
    return dynamic_sort(B.filings(spark, sf), "-unknown", {"amount": C("cents"), "filed": C("filed_date")}, "filed", ["filing_id"]).limit(40).select("filing_id", "filed_date")


@query("l5_null_substitutes", sql("SELECT filing_id, CASE WHEN status = 'P' THEN NULL ELSE filed_date END AS closed FROM filings ORDER BY coalesce(closed, DATE '9999-12-31') DESC, filing_id LIMIT 60", "filings"))
def l5(spark, sf):
    closed = F.when(C("status") != "P", C("filed_date"))
    return B.filings(spark, sf).select("filing_id", closed.alias("closed")).orderBy(F.coalesce("closed", F.lit("9999-12-31").cast("date")).desc(), "filing_id").limit(60)


# -- aggregates


@query("a2_distinct_over_join", sql("SELECT p.branch, count(DISTINCT f.filing_id) AS n FROM people p JOIN filings f USING (person_id) JOIN trades t ON t.filing_id = f.filing_id WHERE t.lag_days > 45 GROUP BY 1", "people", "filings", "trades"))
def a2(spark, sf):
    late = B.trades(spark, sf).filter("lag_days > 45").select("filing_id")
    f = B.filings(spark, sf).join(late, "filing_id", "left_semi")
    return f.join(B.people(spark, sf).select("person_id", "branch"), "person_id").groupBy("branch").agg(F.countDistinct("filing_id").alias("n"))


@query("a4_decisions_with_total", sql("SELECT status, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM filings GROUP BY 1", "filings"))
def a4(spark, sf):
    n = B.filings(spark, sf).groupBy("status").agg(ONE().alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))


@query("a9_nullable_sums", sql("SELECT person_id, CAST(coalesce(sum(CASE WHEN status = 'P' THEN NULL ELSE cents END), 0) AS BIGINT) AS cents, CAST(count(*) FILTER (status = 'P') AS BIGINT) AS unknown FROM filings GROUP BY 1", "filings"))
def a9(spark, sf):
    known = F.when(C("status") != "P", C("cents"))
    return B.filings(spark, sf).groupBy("person_id").agg(F.sum(F.coalesce(known, F.lit(0))).alias("cents"), count_if(known.isNull()).alias("unknown"))


@query("a19_scope_histogram", sql("SELECT CAST(year(filed_date) AS BIGINT) AS yr, filing_type, count(*) AS n, min(filed_date) AS first_date, max(filed_date) AS last_date FROM filings GROUP BY 1, 2", "filings"))
def a19(spark, sf):
    return B.filings(spark, sf).groupBy(F.year("filed_date").cast("long").alias("yr"), "filing_type").agg(ONE().alias("n"), F.min("filed_date").alias("first_date"), F.max("filed_date").alias("last_date"))


@query("a20_document_signatures", sql("SELECT filing_id, string_agg(DISTINCT action || ':' || ticker, ',' ORDER BY action || ':' || ticker) AS signatures FROM trades GROUP BY 1", "trades"))
def a20(spark, sf):
    signature = F.concat_ws(":", "action", "ticker")
    return B.trades(spark, sf).groupBy("filing_id").agg(F.array_join(F.array_sort(F.collect_set(signature)), ",").alias("signatures"))


# -- sets


@query("s1_tagged_union", sql("SELECT person_id AS id, full_name AS name, 'people' AS source FROM people UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier", "people"))
def s1(spark, sf):
    a = B.people(spark, sf).select(C("person_id").alias("id"), C("full_name").alias("name"), F.lit("people").alias("source"))
    return a.unionByName(B.table(spark, sf, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name"), F.lit("supplier").alias("source")))


@query("s3_array_sets", sql(", s AS (SELECT person_id, list(DISTINCT ticker) FILTER (action = 'BUY') AS b, list(DISTINCT ticker) FILTER (action = 'SELL') AS s FROM trades GROUP BY 1) SELECT person_id, CAST(len(list_intersect(b, s)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(b, s))) AS BIGINT) AS either FROM s WHERE b IS NOT NULL AND s IS NOT NULL", "trades"))
def s3(spark, sf):
    pick = lambda a: F.collect_set(F.when(C("action") == a, C("ticker")))
    s = B.trades(spark, sf).groupBy("person_id").agg(pick("BUY").alias("b"), pick("SELL").alias("s")).filter((F.size("b") > 0) & (F.size("s") > 0))
    return s.select("person_id", F.size(F.array_intersect("b", "s")).cast("long").alias("both"), F.size(F.array_union("b", "s")).cast("long").alias("either"))


@query("w14_keep_first", sql(", u AS (SELECT lower(full_name) AS name, 0 AS priority, person_id AS id FROM people UNION ALL SELECT lower(c_mktsegment), 1, c_custkey FROM customer) SELECT name, arg_min(id, (priority, id)) AS id, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1", "people"))
def w14(spark, sf):
    a = B.people(spark, sf).select(F.lower("full_name").alias("name"), F.lit(0).alias("priority"), C("person_id").alias("id"))
    b = B.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("name"), F.lit(1).alias("priority"), C("c_custkey").alias("id"))
    return a.unionByName(b).groupBy("name").agg(F.min_by("id", F.struct("priority", "id")).alias("id"), ONE().alias("n"))


# -- scalar functions


@query("st2_noise_tokens", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda t: t NOT IN ('red', 'small', 'the')), ' ') AS core FROM part")
def st2(spark, sf):
    noise = F.array(*[F.lit(x) for x in ("red", "small", "the")])
    return B.table(spark, sf, "part").select("p_partkey", F.array_join(F.filter(F.split(F.lower("p_name"), " "), lambda t: ~F.array_contains(noise, t)), " ").alias("core"))


@query("st7_district", "SELECT c_custkey, upper(substr(n_name, 1, 2)) AS state, CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE ltrim(CAST(lpad(CAST(c_custkey % 53 AS VARCHAR), 2, '0') AS VARCHAR), '0') END AS district FROM customer JOIN nation ON c_nationkey = n_nationkey")
def st7(spark, sf):
    n = B.table(spark, sf, "customer").join(F.broadcast(B.table(spark, sf, "nation")), C("c_nationkey") == C("n_nationkey"))
    raw = F.when(C("c_custkey") % 5 == 0, "at large").otherwise(F.lpad((C("c_custkey") % 53).cast("string"), 2, "0"))
    return n.select("c_custkey", F.upper(F.substring("n_name", 1, 2)).alias("state"), F.when(raw == "at large", "0").otherwise(F.ltrim(raw, F.lit("0"))).alias("district"))


@query("st10_asset_class", "SELECT p_partkey, CASE WHEN p_type ILIKE '%steel%' THEN 'metal' WHEN p_type ILIKE '%standard%' THEN 'standard' WHEN p_size > 40 THEN 'large' ELSE 'other' END AS kind FROM part")
def st10(spark, sf):
    kind = F.when(C("p_type").ilike("%steel%"), "metal").when(C("p_type").ilike("%standard%"), "standard").when(C("p_size") > 40, "large").otherwise("other")
    return B.table(spark, sf, "part").select("p_partkey", kind.alias("kind"))


@query("st11_symbol_alias", sql("SELECT DISTINCT ticker, CASE ticker WHEN 'P1' THEN 'ONE' WHEN 'P2' THEN 'TWO' ELSE ticker END AS symbol, regexp_matches(ticker, '^[A-Z][A-Z0-9.-]{1,2}$') AS valid FROM trades", "trades"))
def st11(spark, sf):
    alias = F.create_map(*[F.lit(x) for x in ("P1", "ONE", "P2", "TWO")])
    return B.trades(spark, sf).select("ticker").distinct().select("ticker", F.coalesce(F.try_element_at(alias, C("ticker")), C("ticker")).alias("symbol"), C("ticker").rlike("^[A-Z][A-Z0-9.-]{1,2}$").alias("valid"))


@query("d2_future_year", "WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, year(d) > 1998 AS corrected, CASE WHEN year(d) <= 1998 THEN d WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE make_date(1998, month(d), day(d)) END AS fixed FROM d")
def d2(spark, sf, report_year: int = 1998):
    """A year after the report's is read as the report's; a date that does not exist then is null."""
    d = B.table(spark, sf, "orders").select("o_orderkey", C("o_orderdate").cast("date").alias("d"))
    late = F.year("d") > report_year
    moved = F.expr(f"try_to_date(date_format(d, '{report_year}-MM-dd'), 'yyyy-MM-dd')")
    return d.select("o_orderkey", late.alias("corrected"), F.when(late, moved).otherwise(C("d")).alias("fixed"))


@query("d4_bucket_floor", sql("SELECT filing_id, date_trunc('month', filed_date)::DATE AS month, date_trunc('week', filed_date)::DATE AS week FROM filings", "filings"))
def d4(spark, sf):
    return B.filings(spark, sf).select("filing_id", F.trunc("filed_date", "month").alias("month"), F.trunc("filed_date", "week").alias("week"))


@query("d8_elapsed_clamp", "SELECT event_id, greatest(0, CAST(epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-02 00:00:00') // 1000000 AS BIGINT)) AS seconds FROM events")
def d8(spark, sf):
    start = F.unix_seconds(F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return B.table(spark, sf, "events").select("event_id", F.greatest(F.lit(0), F.unix_seconds(C("ts").cast("timestamp")) - start).alias("seconds"))


@query("m2_amount_bands", "WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Over $1,000,000' WHEN 1 THEN '$1,001 - $15,000' ELSE 'unknown' END AS label FROM part) SELECT p_partkey, CAST(replace(regexp_extract(label, '\\$([\\d,]+)', 1), ',', '') AS BIGINT) AS low, CAST(replace(regexp_extract(label, '- \\$([\\d,]+)', 1), ',', '') AS BIGINT) AS high FROM t WHERE label <> 'unknown' AND label NOT LIKE 'Over%' UNION ALL SELECT p_partkey, 1000000, NULL FROM t WHERE label LIKE 'Over%' UNION ALL SELECT p_partkey, NULL, NULL FROM t WHERE label = 'unknown'".replace("\\\\", "\\"))
def m2(spark, sf):
    k = C("p_partkey") % 3
    label = F.when(k == 0, "Over $1,000,000").when(k == 1, "$1,001 - $15,000").otherwise("unknown")
    amounts = F.transform(F.regexp_extract_all("label", F.lit(r"\$([\d,]+)"), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit("")).cast("long"))
    return B.table(spark, sf, "part").select("p_partkey", label.alias("label")).select("p_partkey", F.get(amounts, F.lit(0)).alias("low"), F.get(amounts, F.lit(1)).alias("high"))


@query("m3_finite_positive", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND isfinite(c_acctbal) THEN c_acctbal END AS balance FROM customer")
def m3(spark, sf):
    x = C("c_acctbal")
    return B.table(spark, sf, "customer").select("c_custkey", F.when((x > 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), x).alias("balance"))


@query("ar1_representative", sql(", k AS (SELECT ticker, asset_class, count(*) AS n FROM trades GROUP BY 1, 2) SELECT ticker, arg_min(asset_class, (-n, length(asset_class), asset_class)) AS representative, CAST(count(*) AS BIGINT) AS variants FROM k GROUP BY 1", "trades"))
def ar1(spark, sf):
    k = B.trades(spark, sf, parts=True).groupBy("ticker", "asset_class").agg(ONE().alias("n"))
    return k.groupBy("ticker").agg(F.min_by("asset_class", F.struct(-C("n"), F.length("asset_class"), C("asset_class"))).alias("representative"), ONE().alias("variants"))


@query("h2_canonical_hash", sql("SELECT filing_id, sha256('{\"cents\":' || cents || ',\"status\":\"' || status || '\"}') AS hash FROM filings", "filings"))
def h2(spark, sf):
    return B.filings(spark, sf).select("filing_id", F.sha2(F.to_json(F.struct("cents", "status"), {"ignoreNullFields": "false"}), 256).alias("hash"))


# -- composites and checks


@query("dm6_market_move", sql(", e AS (SELECT filing_id, filed_date AS d FROM filings WHERE status = 'O'), b AS (SELECT date, cents FROM series WHERE symbol = '2-HIGH'), s AS (SELECT e.*, b.cents AS sv FROM e ASOF LEFT JOIN b ON e.d <= b.date), x AS (SELECT s.*, b.cents AS ev FROM s ASOF LEFT JOIN b ON s.d + 90 >= b.date) SELECT filing_id, round((CAST(ev AS DOUBLE) / nullif(sv, 0) - 1) * 100, 2) AS move_pct FROM x", "filings", "series"))
def dm6(spark, sf, horizon: int = 90):
    e = B.filings(spark, sf).filter("status = 'O'").select("filing_id", C("filed_date").alias("d"), F.date_add("filed_date", horizon).alias("until"), F.lit("2-HIGH").alias("symbol"))
    s = B.series(spark, sf).filter("symbol = '2-HIGH'")
    a = temporal.asof_join(e, s, "symbol", "d", "date", ["cents"], forward=True).withColumnsRenamed({"asof_date": "sd", "asof_cents": "sv"})
    b = temporal.asof_join(a, s, "symbol", "until", "date", ["cents"])
    return b.select("filing_id", F.round((F.try_divide(C("asof_cents").cast("double"), C("sv")) - 1) * 100, 2).alias("move_pct"))


@query("dm29_priority_score", sql("SELECT filing_id, CASE WHEN cents > 10000000 THEN 30 ELSE 0 END + CASE WHEN status = 'P' THEN 25 ELSE 0 END + CASE WHEN filing_type LIKE '1%' THEN 20 ELSE 0 END + CASE WHEN filed_date >= DATE '2000-01-01' THEN 15 WHEN filed_date >= DATE '1998-01-01' THEN 10 ELSE 5 END AS score FROM filings", "filings"))
def dm29(spark, sf):
    points = [(C("cents") > 10000000, 30), (C("status") == "P", 25), (C("filing_type").startswith("1"), 20)]
    recent = F.when(C("filed_date") >= "2000-01-01", 15).when(C("filed_date") >= "1998-01-01", 10).otherwise(5)
    return B.filings(spark, sf).select("filing_id", reduce(lambda a, b: a + F.when(b[0], b[1]).otherwise(0), points, recent).alias("score"))


@query("dm38_retrieval_batches", sql("SELECT filing_type, filing_id, CAST(r AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY filing_type ORDER BY CASE status WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, cents DESC, filing_id) AS r FROM filings) WHERE r <= 24", "filings"))
def dm38(spark, sf):
    rank = F.when(C("status") == "P", 0).when(C("status") == "O", 1).otherwise(2)
    return windows.top_per_group(B.filings(spark, sf), ["filing_type"], [rank, C("cents").desc(), C("filing_id")], 24, "position").select("filing_type", "filing_id", "position")


@query("dm47_vote_collapse", sql(", v AS (SELECT person_id, trade_date, count(*) AS n, count(DISTINCT ticker) AS tickers FROM trades GROUP BY 1, 2) SELECT person_id, trade_date, n, tickers > 1 AS conflict FROM v", "trades"))
def dm47(spark, sf):
    v = B.trades(spark, sf).groupBy("person_id", "trade_date").agg(ONE().alias("n"), F.countDistinct("ticker").alias("tickers"))
    return v.select("person_id", "trade_date", "n", (C("tickers") > 1).alias("conflict"))


@query("dm48_review_priority", sql("SELECT event_id, least(100, greatest(0, CASE event_type WHEN 'purchase' THEN 70 WHEN 'error' THEN 40 ELSE 50 END + CASE WHEN k >= 50 THEN 3 WHEN k = 0 THEN -10 ELSE 0 END + CASE WHEN user_id % 7 = 0 THEN 5 ELSE 0 END)) AS score FROM civic_events", "civic_events"))
def dm48(spark, sf):
    base = F.when(C("event_type") == "purchase", 70).when(C("event_type") == "error", 40).otherwise(50)
    extra = F.when(C("k") >= 50, 3).when(C("k") == 0, -10).otherwise(0) + F.when(C("user_id") % 7 == 0, 5).otherwise(0)
    return B.civic_events(spark, sf).select("event_id", F.least(F.lit(100), F.greatest(F.lit(0), base + extra)).alias("score"))


@query("dm49_shared_sources", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def dm49(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return B.table(spark, sf, "pages").groupBy(host.alias("host")).agg(ONE().alias("pages"), F.countDistinct("url").alias("urls"))


@query("v5_period_overlaps", sql(", p AS (SELECT person_id, filing_id, filed_date AS a, filed_date + 20 AS b FROM filings) SELECT person_id, filing_id FROM (SELECT *, lag(b) OVER (PARTITION BY person_id ORDER BY a, filing_id) AS prev FROM p) WHERE prev >= a OR b < a", "filings"))
def v5(spark, sf):
    p = B.filings(spark, sf).select("person_id", "filing_id", C("filed_date").alias("a"), F.date_add("filed_date", 20).alias("b"))
    return p.withColumn("prev", F.lag("b").over(Window.partitionBy("person_id").orderBy("a", "filing_id"))).filter("prev >= a or b < a").select("person_id", "filing_id")


@query("v12_reconciliation", sql("SELECT 'people' AS check_name, count(*) AS actual, count(*) >= 100 AS ok FROM people UNION ALL SELECT 'filings', count(*), count(*) >= 1000 FROM filings UNION ALL SELECT 'orphans', count(*), count(*) = 0 FROM filings f WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.person_id = f.person_id)", "people", "filings"))
def v12(spark, sf):
    p, f = B.people(spark, sf), B.filings(spark, sf)
    check = lambda name, rows, ok: rows.agg(ONE().alias("actual")).select(F.lit(name).alias("check_name"), "actual", ok(C("actual")).alias("ok"))
    rows = [check("people", p, lambda n: n >= 100), check("filings", f, lambda n: n >= 1000), check("orphans", f.join(p, "person_id", "left_anti"), lambda n: n == 0)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("v14_referential", sql("SELECT t.filing_id, t.line FROM trades t WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.filing_id = t.filing_id AND f.status <> 'P')", "trades", "filings"))
def v14(spark, sf):
    known = B.filings(spark, sf).filter("status <> 'P'").select("filing_id")
    return B.trades(spark, sf).join(known, "filing_id", "left_anti").select("filing_id", "line")
