"""Asset resolution, full market reactions, cross-filing duplicates, amendments, recognition quality and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as T
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


# -- asset resolution: names are the parts' names with planted derivatives, aliases and standalone symbols

# Disclosure suffixes, form codes and notes that are not part of an asset's name.
SUFFIX = r"(?i)\b(?:FILING\s+STATUS|SUBHOLDING\s+OF|LOCATION|DESCRIPTION)\s*:.*$"
FORM_CODE = r"(?i)\[(?:EF|ETF|MF|OT|ST)\]"
OWNERSHIP = r"(?i)\((?:S|DC|RETIREMENT)\)"
DERIVATIVE = r"(?i)^\s*(?:CALL|PUT)(?:\s|/)"


def asset_name(x: Column) -> Column:
    """Upper-case words of an asset's name: accents folded, recognition slips repaired, notes and suffixes cut."""
    y = F.translate(F.coalesce(x, F.lit("")), T.ACCENTED, T.PLAIN)
    y = F.regexp_replace(F.regexp_replace(y, r"(?i)(?<![A-Z])!SHARES", "ISHARES"), r"(?i)\bMSC!", "MSCI")
    y = F.regexp_replace(F.regexp_replace(F.regexp_replace(y, SUFFIX, ""), FORM_CODE, " "), OWNERSHIP, " ")
    y = F.regexp_replace(F.regexp_replace(y, r"(?i)\b(?:UNSOLICITED|SOLICITED)\b", " "), r"(?i)\s+-\s+DNQ\b|\bDNQ\b", " ")
    return F.upper(F.trim(F.regexp_replace(y, "[^A-Za-z0-9]+", " ")))


def disclosed_assets(spark, sf):
    """(filing_id, line, name, ticker, kind) of each trade, in five planted forms by line number."""
    t = B.table(spark, sf, "lineitem").select(C("l_orderkey").alias("filing_id"), C("l_linenumber").cast("long").alias("line"), (C("l_partkey") % 40).alias("k"))
    symbol = F.concat(F.lit("SYM"), C("k"))
    name = (
        F.when(C("line") == 1, F.concat(F.lit("Fund No "), C("k"), F.lit(" [MF] (S) Filing Status: New")))
        .when(C("line") == 2, F.concat(F.lit("call/"), symbol))
        .when(C("line") == 3, F.concat(F.lit("Shares of "), symbol, F.lit(" unsolicited")))
        .when(C("line") == 4, F.concat(symbol, F.lit(" or SYM"), (C("k") + 1) % 40))
        .otherwise(F.concat(F.lit("Unknown holding "), C("k")))
    )
    return t.select("filing_id", "line", name.alias("name"), symbol.alias("ticker"), F.when(C("k") % 4 == 3, "bond").otherwise("fund").alias("kind"))


def references(spark):
    """Known assets: an identifier and a normalised alias each; in use, a table."""
    return spark.range(40).filter("id % 10 <> 9").select(F.concat(F.lit("SYM"), "id").alias("identifier"), F.concat(F.lit("FUND NO "), "id").alias("alias"))


def resolved(assets, known, classes=("fund", "etf", "mutual_fund")):
    """The identifier by exact normalised name, else by the only known symbol among the name's words."""
    rows = assets.withColumn("normalized", asset_name(C("name"))).withColumn("derivative", C("name").rlike(DERIVATIVE))
    by_name = rows.join(F.broadcast(known.select("alias", C("identifier").alias("by_name"))), C("normalized") == C("alias"), "left")
    words = rows.filter("not derivative").select("normalized").distinct().select("normalized", F.explode(F.array_distinct(F.split("normalized", " "))).alias("word"))
    hits = words.join(F.broadcast(known.select("identifier").distinct()), C("word") == C("identifier"), "left_semi")
    only = hits.groupBy("normalized").agg(F.min("word").alias("by_symbol"), ONE().alias("n")).filter("n = 1").drop("n")
    both = by_name.join(only, "normalized", "left")
    found = F.when(C("derivative") | (C("normalized") == ""), F.lit(None)).otherwise(F.coalesce("by_name", "by_symbol"))
    gate = F.when(C("kind").isin(*classes) | C("name").rlike(r"(?i)(?<![A-Z0-9])529(?![A-Z0-9])"), found)
    method = F.when(gate.isNull(), F.lit(None)).when(C("by_name").isNotNull(), "curated_normalized_name").otherwise("curated_explicit_symbol")
    return both.select("filing_id", "line", "normalized", gate.alias("identifier"), method.alias("match_method"))


_ASSETS = """d AS (SELECT l_orderkey AS filing_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 40 AS k FROM lineitem),
 a AS (SELECT *, CASE line WHEN 1 THEN 'FUND NO ' || k WHEN 2 THEN 'CALL SYM' || k WHEN 3 THEN 'SHARES OF SYM' || k WHEN 4 THEN 'SYM' || k || ' OR SYM' || ((k + 1) % 40) ELSE 'UNKNOWN HOLDING ' || k END AS normalized FROM d),
 r AS (SELECT filing_id, line, normalized, CASE WHEN k % 4 = 3 THEN NULL WHEN line = 1 AND k % 10 <> 9 THEN 'SYM' || k WHEN line = 3 AND k % 10 <> 9 THEN 'SYM' || k
  WHEN line = 4 AND k % 10 = 9 THEN 'SYM' || ((k + 1) % 40) WHEN line = 4 AND k % 10 = 8 THEN 'SYM' || k END AS identifier, line FROM a),
 res AS (SELECT filing_id, line, normalized, identifier, CASE WHEN identifier IS NULL THEN NULL WHEN line = 1 THEN 'curated_normalized_name' ELSE 'curated_explicit_symbol' END AS match_method FROM (SELECT filing_id, line, normalized, identifier FROM r))"""


@query("dm13_asset_resolution", f"WITH {_ASSETS} SELECT * FROM res")
def dm13(spark, sf):
    return resolved(disclosed_assets(spark, sf), references(spark))


@query("dm14_resolution_by_name", f"WITH {_ASSETS} SELECT normalized, count(*) AS transactions, CAST(count(identifier) AS BIGINT) AS resolved, min(identifier) AS identifier, min(filing_id) AS first_filing FROM res GROUP BY 1")
def dm14(spark, sf):
    r = dm13(spark, sf)
    return r.groupBy("normalized").agg(ONE().alias("transactions"), F.count("identifier").alias("resolved"), F.min("identifier").alias("identifier"), F.min("filing_id").alias("first_filing"))


# -- prices and reactions


@query("dm9_price_index", "WITH p AS (SELECT upper(o_orderpriority) AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS adj_close, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice / 2 END AS close, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_totalprice / 4 END AS value FROM orders), q AS (SELECT symbol, date, position, coalesce(adj_close, close, value) AS price, CASE WHEN adj_close IS NOT NULL THEN 'adj_close' WHEN close IS NOT NULL THEN 'close' ELSE 'value' END AS price_field FROM p) SELECT symbol, date, round(arg_max(price, position), 4) AS price, arg_max(price_field, position) AS price_field FROM q WHERE price > 0 GROUP BY 1, 2")
def dm9(spark, sf):
    """One price a day and symbol: adjusted close, else close, else value; the last valid one in source order stays."""
    o = B.table(spark, sf, "orders")
    key = C("o_orderkey")
    rows = o.select(F.upper("o_orderpriority").alias("symbol"), C("o_orderdate").cast("date").alias("date"), key.alias("position"), F.when(key % 3 == 0, C("o_totalprice")).alias("adj_close"), F.when(key % 3 != 1, C("o_totalprice") / 2).alias("close"), F.when(key % 7 == 0, -1).otherwise(C("o_totalprice") / 4).alias("value"))
    field = F.when(C("adj_close").isNotNull(), "adj_close").when(C("close").isNotNull(), "close").otherwise("value")
    rows = rows.select("symbol", "date", "position", F.coalesce("adj_close", "close", "value").alias("price"), field.alias("price_field")).filter("price > 0 and price < double('infinity')")
    last = rows.groupBy("symbol", "date").agg(F.max_by(F.struct("price", "price_field"), "position").alias("m"))
    return last.select("symbol", "date", F.round("m.price", 4).alias("price"), C("m.price_field").alias("price_field"))


SESSIONS, DAYS = (1, 5, 20), (7, 30, 90)
_REACTION = """, c AS (SELECT a.symbol, a.date, a.cents AS ac, b.cents AS bc, row_number() OVER (PARTITION BY a.symbol ORDER BY a.date) AS i FROM series a JOIN series b USING (date) WHERE b.symbol = '5-LOW' AND a.symbol <> '5-LOW'),
 e AS (SELECT DISTINCT filing_type AS symbol, filed_date AS event_date FROM filings WHERE status = 'P' AND filing_type <> '5-LOW'),
 k AS (SELECT e.symbol, e.event_date, m.date AS anchor_date, m.ac, m.bc, m.i FROM e ASOF LEFT JOIN c m ON e.symbol = m.symbol AND e.event_date <= m.date),
 w AS (SELECT unnest(['pre', 'post', 'pre', 'post', 'pre', 'post', 'pre', 'post', 'pre', 'post', 'pre', 'post']) AS direction, unnest(['session', 'session', 'session', 'session', 'session', 'session', 'day', 'day', 'day', 'day', 'day', 'day']) AS unit, unnest([1, 1, 5, 5, 20, 20, 7, 7, 30, 30, 90, 90]) AS n),
 x AS (SELECT k.*, direction, unit, n, CASE WHEN direction = 'pre' THEN event_date - n ELSE event_date + n END AS target, CASE WHEN direction = 'pre' THEN i - n ELSE i + n END AS at FROM k, w WHERE anchor_date IS NOT NULL),
 s AS (SELECT x.*, c.date AS d, c.ac AS ao, c.bc AS bo FROM x JOIN c ON c.symbol = x.symbol AND c.i = x.at WHERE unit = 'session'),
 p AS (SELECT x.*, c.date AS d, c.ac AS ao, c.bc AS bo, c.i AS ci FROM (SELECT * FROM x WHERE unit = 'day' AND direction = 'pre') x ASOF JOIN c ON c.symbol = x.symbol AND x.target >= c.date),
 q AS (SELECT x.*, c.date AS d, c.ac AS ao, c.bc AS bo, c.i AS ci FROM (SELECT * FROM x WHERE unit = 'day' AND direction = 'post') x ASOF JOIN c ON c.symbol = x.symbol AND x.target <= c.date),
 u AS (SELECT symbol, event_date, anchor_date, unit, direction, n, d, ac, bc, ao, bo FROM s UNION ALL SELECT symbol, event_date, anchor_date, unit, direction, n, d, ac, bc, ao, bo FROM p WHERE ci < i UNION ALL SELECT symbol, event_date, anchor_date, unit, direction, n, d, ac, bc, ao, bo FROM q WHERE ci > i)
 SELECT symbol, event_date, anchor_date, unit || '_' || direction || '_' || n AS window_label, d AS other_date, CASE WHEN direction = 'pre' THEN round((CAST(ac AS DOUBLE) / ao - 1) * 100, 4) - round((CAST(bc AS DOUBLE) / bo - 1) * 100, 4) ELSE round((CAST(ao AS DOUBLE) / ac - 1) * 100, 4) - round((CAST(bo AS DOUBLE) / bc - 1) * 100, 4) END AS adjusted_pct FROM u"""


@query("dm7_reaction_windows", sql(_REACTION, "filings", "series"))
def dm7_windows(spark, sf):
    """Every window of a reaction: 1, 5 and 20 common sessions and 7, 30 and 90 calendar days before and after."""
    from ..operators import temporal

    s = B.series(spark, sf)
    bench = s.filter("symbol = '5-LOW'").select("date", C("cents").alias("bc"))
    order = F.row_number().over(Window.partitionBy("symbol").orderBy("date"))
    common = s.filter("symbol <> '5-LOW'").join(bench, "date").select("symbol", "date", C("cents").alias("ac"), "bc").withColumn("i", order)
    e = B.filings(spark, sf).filter("status = 'P' and filing_type <> '5-LOW'").select(C("filing_type").alias("symbol"), C("filed_date").alias("event_date")).distinct()
    anchor = temporal.asof_join(e, common, "symbol", "event_date", "date", ["ac", "bc", "i"], forward=True).filter("asof_date is not null")
    anchor = anchor.withColumnsRenamed({"asof_date": "anchor_date", "asof_ac": "ac", "asof_bc": "bc", "asof_i": "i"})
    parts = []
    steps = F.explode(F.array(*[F.struct(F.lit("session").alias("unit"), F.lit(d).alias("direction"), F.lit(n).alias("n"), F.lit(sign * n).alias("step")) for n in SESSIONS for d, sign in (("pre", -1), ("post", 1))]))
    rows = anchor.withColumn("w", steps).select("*", "w.*").withColumn("at", C("i") + C("step"))
    others = common.select("symbol", C("i").alias("at"), C("date").alias("d"), C("ac").alias("ao"), C("bc").alias("bo"))
    keep = ["symbol", "event_date", "anchor_date", "unit", "direction", "n", "d", "ac", "bc", "ao", "bo"]
    parts.append(rows.join(others, ["symbol", "at"]).select(*keep))
    for direction, sign in (("pre", -1), ("post", 1)):
        days = F.explode(F.array(*[F.lit(n) for n in DAYS]))
        rows = anchor.withColumn("n", days).withColumn("target", F.date_add("event_date", C("n") * sign))
        rows = temporal.asof_join(rows, common, "symbol", "target", "date", ["ac", "bc", "i"], forward=sign > 0)
        rows = rows.filter("asof_i < i" if sign < 0 else "asof_i > i").withColumnsRenamed({"asof_date": "d", "asof_ac": "ao", "asof_bc": "bo"})
        parts.append(rows.withColumn("unit", F.lit("day")).withColumn("direction", F.lit(direction)).select(*keep))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pct = lambda end, start: F.round((C(end).cast("double") / C(start) - 1) * 100, 4)
    adjusted = F.when(C("direction") == "pre", pct("ac", "ao") - pct("bc", "bo")).otherwise(pct("ao", "ac") - pct("bo", "bc"))
    return u.select("symbol", "event_date", "anchor_date", F.concat_ws("_", "unit", "direction", "n").alias("window_label"), C("d").alias("other_date"), adjusted.alias("adjusted_pct"))


@query("dm8_reaction_skips", sql(", r AS (SELECT t.filing_id, t.line, CASE WHEN t.action = 'EXCHANGE' THEN 'unsupported_action' WHEN t.ticker IN ('P3', 'P7') THEN 'unresolved_reference' WHEN t.trade_date > DATE '1998-06-01' THEN 'event_after_available_history' WHEN t.lag_days < 0 THEN 'negative_lag' ELSE 'covered' END AS reason FROM trades t) SELECT reason, count(*) AS n FROM r GROUP BY 1", "trades"))
def dm8(spark, sf):
    """Why rows get no reaction: the first reason that holds, counted; covered rows stay."""
    reason = F.when(C("action") == "EXCHANGE", "unsupported_action").when(C("ticker").isin("P3", "P7"), "unresolved_reference").when(C("trade_date") > "1998-06-01", "event_after_available_history").when(C("lag_days") < 0, "negative_lag").otherwise("covered")
    return B.trades(spark, sf).select(reason.alias("reason")).groupBy("reason").agg(ONE().alias("n"))


# -- cross-filing duplicates and amendments

# Words of asset names that do not tell assets apart.
STOP = "class co com common company corp corporation fund inc ltd new ordinary plc shares stock the trust".split()


def asset_tokens(x: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    return F.array_except(words, F.lit(STOP))


@query("dm27_cross_filing_duplicates", sql(""", r AS (SELECT filing_id, line, person_id, date_trunc('month', trade_date)::DATE AS day, action, value_cents // 3000000 AS band, CASE WHEN line % 2 = 0 THEN 'periodic' ELSE 'annual' END AS kind, 'The ' || ticker || ' Bond ' || (value_cents % 2) || ' Inc' AS name, [lower(ticker), 'bond', CAST(value_cents % 2 AS VARCHAR)] AS tok FROM trades),
 j AS (SELECT a.filing_id, a.line, p.filing_id || ':' || p.line AS other, len(list_intersect(a.tok, p.tok)) / len(list_distinct(list_concat(a.tok, p.tok))) AS score FROM r a JOIN r p ON a.person_id = p.person_id AND a.day = p.day AND a.action = p.action AND a.band = p.band WHERE a.kind = 'annual' AND p.kind = 'periodic'),
 b AS (SELECT filing_id, line, max(score) AS score, arg_max(other, (score, other)) AS other FROM j GROUP BY 1, 2)
 SELECT r.filing_id, r.line, coalesce(b.score >= 0.85, FALSE) AS duplicate, CASE WHEN b.score >= 0.85 THEN other END AS duplicate_of, NOT coalesce(b.score >= 0.85, FALSE) AS timeline_inclusion FROM r LEFT JOIN b USING (filing_id, line)""", "trades"))
def dm27(spark, sf):
    """Annual rows that repeat a periodic one: equal in five fields, asset words at a Jaccard of 0.85 or more."""
    t = B.trades(spark, sf)
    name = F.concat(F.lit("The "), "ticker", F.lit(" Bond "), C("value_cents") % 2, F.lit(" Inc"))
    r = t.select("filing_id", "line", "person_id", F.trunc("trade_date", "month").alias("day"), "action", F.floor(C("value_cents") / 3000000).alias("band"), F.when(C("line") % 2 == 0, "periodic").otherwise("annual").alias("kind"), asset_tokens(name).alias("tok"))
    key = ["person_id", "day", "action", "band"]
    other = r.filter("kind = 'periodic'").select(*key, F.concat_ws(":", "filing_id", "line").alias("other"), C("tok").alias("other_tok"))
    pairs = r.filter("kind = 'annual'").join(other, key).withColumn("score", T.jaccard(C("tok"), C("other_tok")))
    best = pairs.filter("score >= 0.85").groupBy("filing_id", "line").agg(F.max_by("other", F.struct("score", "other")).alias("duplicate_of"))
    hit = C("duplicate_of").isNotNull()
    return r.select("filing_id", "line").join(best, ["filing_id", "line"], "left").select("filing_id", "line", hit.alias("duplicate"), "duplicate_of", (~hit).alias("timeline_inclusion"))


@query("dm25_house_amendments", sql(""", s AS (SELECT filing_id, list_distinct(list(ticker || action)) AS sig FROM trades GROUP BY 1),
 d AS (SELECT f.filing_id, filed_date, CASE WHEN f.filing_id % 4 = 1 THEN f.filing_id - 1 WHEN f.filing_id % 4 = 2 THEN -f.filing_id END AS ref, coalesce(sig, []) AS sig FROM filings f LEFT JOIN s USING (filing_id))
 SELECT d.filing_id, CASE WHEN d.ref IS NULL THEN 'no_explicit_amendment_reference' WHEN p.filing_id IS NULL THEN 'explicit_reference_unresolved' ELSE 'explicit_reference_resolved' END AS status, CAST(date_diff('day', p.filed_date, d.filed_date) AS INTEGER) AS day_gap, d.filed_date >= p.filed_date AS chronological,
 CASE WHEN p.filing_id IS NOT NULL AND len(list_distinct(list_concat(d.sig, p.sig))) > 0 THEN round(len(list_intersect(d.sig, p.sig)) / len(list_distinct(list_concat(d.sig, p.sig))), 4) END AS jaccard FROM d LEFT JOIN d p ON d.ref = p.filing_id""", "filings", "trades"))
def dm25(spark, sf):
    """Amendments by explicit reference: resolved or not, the gap in days and the overlap of transaction signatures."""
    s = B.trades(spark, sf).groupBy("filing_id").agg(F.collect_set(F.concat("ticker", "action")).alias("sig"))
    ref = F.when(C("filing_id") % 4 == 1, C("filing_id") - 1).when(C("filing_id") % 4 == 2, -C("filing_id"))
    d = B.filings(spark, sf).join(s, "filing_id", "left").select("filing_id", "filed_date", ref.alias("ref"), F.coalesce("sig", F.array().cast("array<string>")).alias("sig"))
    p = d.select(C("filing_id").alias("p_id"), C("filed_date").alias("p_date"), C("sig").alias("p_sig"))
    j = d.join(p, C("ref") == C("p_id"), "left")
    status = F.when(C("ref").isNull(), "no_explicit_amendment_reference").when(C("p_id").isNull(), "explicit_reference_unresolved").otherwise("explicit_reference_resolved")
    return j.select("filing_id", status.alias("status"), F.datediff("filed_date", "p_date").alias("day_gap"), (C("filed_date") >= C("p_date")).alias("chronological"), F.round(T.jaccard(C("sig"), C("p_sig")), 4).alias("jaccard"))


# -- recognition quality: a page is a filing, its words are its trades

_PAGES = """p AS (SELECT filing_id, person_id, count(*) AS words, avg(confidence_pct) AS mean, median(confidence_pct) AS med, count(*) FILTER (confidence_pct < 60) AS low, count(*) FILTER (confidence_pct >= 60) / count(*) AS readable, count(DISTINCT line % 3) AS blocks, count(DISTINCT line) AS lines, sum(length(ticker) * 12) AS chars, count(DISTINCT action) AS cues FROM trades GROUP BY 1, 2),
 q AS (SELECT *, round(least(45, mean * 0.45) + least(20, chars / 80.0) + least(20, cues * 4.0) + least(15, blocks * 2.0 + lines / 8.0) + 1e-9, 2) AS score, round(0.3 * least(1, words / 80.0) + 0.3 * least(1, lines / 18.0) + 0.2 * least(1, blocks / 6.0) + 0.2 * least(1, chars / 800.0) + 1e-9, 4) AS layout FROM p),
 z AS (SELECT *, CASE WHEN chars < 40 THEN 'ocr_failed_or_blank_review_required' WHEN score >= 78 AND readable >= 0.8 THEN 'high_quality_ocr_review_required' WHEN score >= 55 AND readable >= 0.55 THEN 'usable_ocr_review_required' ELSE 'low_quality_ocr_review_required' END AS status FROM q)"""


def page_quality(spark, sf):
    c = C("confidence_pct")
    # Sizes of sets, as several distinct counts would copy every row for each of them.
    kinds = lambda x: F.size(F.collect_set(x)).cast("long")
    p = B.trades(spark, sf).groupBy("filing_id", "person_id").agg(
        ONE().alias("words"), F.avg(c).alias("mean"), F.median(c).alias("med"), count_if(c < 60).alias("low"), (count_if(c >= 60) / ONE()).alias("readable"),
        kinds(C("line") % 3).alias("blocks"), kinds(C("line")).alias("lines"), F.sum(F.length("ticker") * 12).alias("chars"), kinds(C("action")).alias("cues"),
    )
    least = lambda most, x: F.least(F.lit(float(most)), x)
    score = least(45, C("mean") * 0.45) + least(20, C("chars") / 80.0) + least(20, C("cues") * 4.0) + least(15, C("blocks") * 2.0 + C("lines") / 8.0)
    layout = 0.3 * least(1, C("words") / 80.0) + 0.3 * least(1, C("lines") / 18.0) + 0.2 * least(1, C("blocks") / 6.0) + 0.2 * least(1, C("chars") / 800.0)
    p = p.withColumn("score", F.round(score + 1e-9, 2)).withColumn("layout", F.round(layout + 1e-9, 4))
    status = (
        F.when(C("chars") < 40, "ocr_failed_or_blank_review_required")
        .when((C("score") >= 78) & (C("readable") >= 0.8), "high_quality_ocr_review_required")
        .when((C("score") >= 55) & (C("readable") >= 0.55), "usable_ocr_review_required")
        .otherwise("low_quality_ocr_review_required")
    )
    return p.withColumn("status", status)


@query("dm31_page_quality", sql(f", {_PAGES} SELECT filing_id, words, med, CAST(low AS BIGINT) AS low, layout, score, status FROM z", "trades"))
def dm31(spark, sf):
    """Recognition quality of a page: capped points for confidence, density, cues and layout, and a status ladder."""
    return page_quality(spark, sf).select("filing_id", "words", "med", "low", "layout", "score", "status")


@query("dm32_document_quality", sql(f", {_PAGES} SELECT person_id, count(*) AS pages, CAST(count(*) FILTER (status LIKE 'high%' OR status LIKE 'usable%') AS BIGINT) AS readable_pages, CAST(sum(words) AS BIGINT) AS words, min(score) AS min_score, CASE WHEN count(*) FILTER (status LIKE 'high%' OR status LIKE 'usable%') = count(*) THEN 'ocr_complete_review_required' WHEN count(*) FILTER (status LIKE 'high%' OR status LIKE 'usable%') > 0 THEN 'ocr_partial_review_required' ELSE 'ocr_low_quality_review_required' END AS processing_status FROM z GROUP BY 1", "trades"))
def dm32(spark, sf):
    """Pages rolled up to their document."""
    good = count_if(C("status").startswith("high") | C("status").startswith("usable"))
    d = page_quality(spark, sf).groupBy("person_id").agg(ONE().alias("pages"), good.alias("readable_pages"), F.sum("words").alias("words"), F.min("score").alias("min_score"))
    status = F.when(C("readable_pages") == C("pages"), "ocr_complete_review_required").when(C("readable_pages") > 0, "ocr_partial_review_required").otherwise("ocr_low_quality_review_required")
    return d.withColumn("processing_status", status)


# -- promotion

# The gate's criteria; the first eleven are the source's, the last five a reviewer's.
CRITERIA = [
    ("official_source_tier", "line % 7 <> 0"), ("official_source_url", "filing_id % 11 <> 0"), ("source_hash_matches_document", "filing_id % 13 <> 0"), ("identity_matched", "person_id % 5 <> 0"),
    ("parser_preview_status", "lag_days > -100"), ("required_fields_present", "ticker IS NOT NULL"), ("source_locator_present", "line > 0"), ("minimum_parser_confidence", "confidence_pct >= 52"),
    ("minimum_required_field_confidence", "confidence_pct >= 46"), ("no_quality_flags", "lag_days < 365"), ("not_duplicate_candidate", "value_cents % 17 <> 0"),
    ("explicit_public_production_decision", "filing_id % 2 = 0"), ("reviewer_identified", "filing_id % 3 <> 2"), ("review_timestamp_present", "line % 5 <> 4"), ("review_hash_matches_source", "filing_id % 13 <> 0"), ("review_document_matches_source", "person_id % 7 <> 1"),
]
_FAILED = "list_sort(list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in CRITERIA) + "], lambda x: x IS NOT NULL))"
_SOURCE = " AND ".join(f"({c})" for _, c in CRITERIA[:11])


def promotion(spark, sf):
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.expr(c), n) for n, c in CRITERIA])))
    source = F.expr(_SOURCE)
    return B.trades(spark, sf).withColumn("failed", failed).withColumn("source_pass", source)


@query("dm33_promotion_criteria", sql(f"SELECT filing_id, line, array_to_string({_FAILED}, '|') AS failed_criteria, {_SOURCE} AS source_pass, len({_FAILED}) = 0 AS eligible FROM trades", "trades"))
def dm33_criteria(spark, sf):
    """Eleven source and five reviewer criteria of a parser row; all must hold."""
    return promotion(spark, sf).select("filing_id", "line", F.array_join("failed", "|").alias("failed_criteria"), "source_pass", (F.size("failed") == 0).alias("eligible"))


@query("dm33_failed_histogram", sql(f"SELECT unnest({_FAILED}) AS criterion, count(*) AS n FROM trades GROUP BY 1", "trades"))
def dm33_histogram(spark, sf):
    return promotion(spark, sf).select(F.explode("failed").alias("criterion")).groupBy("criterion").agg(ONE().alias("n"))


@query("dm33_review_queue", sql(f"SELECT filing_id, line FROM trades WHERE {_SOURCE} AND len({_FAILED}) > 0 ORDER BY confidence_pct DESC, reported_date DESC, filing_id, line LIMIT 100", "trades"))
def dm33_queue(spark, sf):
    """The hundred best candidates that only lack a reviewer's part."""
    q = promotion(spark, sf).filter(C("source_pass") & (F.size("failed") > 0))
    return q.orderBy(C("confidence_pct").desc(), C("reported_date").desc(), "filing_id", "line").limit(100).select("filing_id", "line")


@query("dm34_artifact_blockers", sql(", a AS (SELECT f.filing_id, count(t.line) AS n, min(confidence_pct) AS low, any_value(f.status) AS status FROM filings f LEFT JOIN trades t USING (filing_id) GROUP BY 1) SELECT filing_id, array_to_string(list_sort(list_filter([CASE WHEN filing_id % 6 = 0 THEN 'raw_document_provenance_incomplete' END, CASE WHEN n = 0 THEN 'preview_has_no_transactions' END, CASE WHEN low < 46 THEN 'transaction_confidence_below_threshold' END, CASE WHEN status <> 'F' THEN 'explicit_public_production_decision_missing' END, CASE WHEN n % 5 = 3 THEN 'review_transaction_count_mismatch' END], lambda x: x IS NOT NULL)), '|') AS blockers FROM a", "filings", "trades"))
def dm34(spark, sf):
    """What keeps a document's artifact from promotion, sorted."""
    t = B.trades(spark, sf).groupBy("filing_id").agg(ONE().alias("n"), F.min("confidence_pct").alias("low"))
    a = B.filings(spark, sf).join(t, "filing_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rules = [("raw_document_provenance_incomplete", C("filing_id") % 6 == 0), ("preview_has_no_transactions", C("n") == 0), ("transaction_confidence_below_threshold", C("low") < 46), ("explicit_public_production_decision_missing", C("status") != "F"), ("review_transaction_count_mismatch", C("n") % 5 == 3)]
    return a.select("filing_id", F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))), "|").alias("blockers"))


@query("dm35_state_machine", "WITH s AS (SELECT user_id AS record, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'rollback' ELSE 'review' END AS op FROM events), l AS (SELECT *, lag(op) OVER (PARTITION BY record ORDER BY seq) AS prev FROM (SELECT * FROM s WHERE op <> 'review')), k AS (SELECT record, count(*) AS changes, CAST(count(*) FILTER (op = 'rollback' AND coalesce(prev, 'rollback') = 'rollback') AS BIGINT) AS rejected, arg_max(op, seq) AS last FROM l GROUP BY 1) SELECT record, changes, rejected, CASE last WHEN 'promote' THEN 'reviewed_public_production' ELSE 'rolled_back' END AS status FROM k")
def dm35(spark, sf):
    """Status of each record after its log: a promotion makes it public, a rollback undoes it; one without is rejected."""
    op = F.when(C("event_type") == "purchase", "promote").when(C("event_type") == "error", "rollback").otherwise("review")
    s = B.table(spark, sf, "events").select(C("user_id").alias("record"), C("event_id").alias("seq"), op.alias("op")).filter("op <> 'review'")
    prev = F.lag("op").over(Window.partitionBy("record").orderBy("seq"))
    k = s.withColumn("prev", prev).groupBy("record").agg(ONE().alias("changes"), count_if((C("op") == "rollback") & (F.coalesce("prev", F.lit("rollback")) == "rollback")).alias("rejected"), F.max_by("op", "seq").alias("last"))
    return k.select("record", "changes", "rejected", F.when(C("last") == "promote", "reviewed_public_production").otherwise("rolled_back").alias("status"))
