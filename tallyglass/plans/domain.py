"""Composite disclosure operators: scorecards, reactions, clusters in context, reconciliation and release checks."""

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


@query("dm1_scorecard", sql(""", last AS (SELECT max(trade_date) AS d FROM trades),
 s AS (SELECT person_id, median(lag_days) AS med_all, median(lag_days) FILTER (trade_date >= d - 730) AS med_recent, count(*) FILTER (trade_date >= d - 730) AS n_recent, bool_or(lag_days < 0) AS neg, bool_or(confidence_pct < 50) AS low FROM trades, last GROUP BY 1),
 f AS (SELECT DISTINCT person_id FROM filings),
 x AS (SELECT p.person_id, p.branch, f.person_id IS NULL AS none, CASE WHEN n_recent >= 10 THEN med_recent ELSE med_all END AS med, coalesce(neg, FALSE) AS neg, coalesce(low, FALSE) AS low, CASE branch WHEN 'Legislative' THEN 45 ELSE 60 END AS elevated, CASE branch WHEN 'Legislative' THEN 90 ELSE 120 END AS high FROM people p LEFT JOIN s USING (person_id) LEFT JOIN f ON p.person_id = f.person_id),
 y AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN none THEN 30 ELSE 0 END - CASE WHEN med > high THEN 25 WHEN med > elevated THEN 15 ELSE 0 END - CASE WHEN neg THEN 10 ELSE 0 END - CASE WHEN low THEN 10 ELSE 0 END)) AS score FROM x)
 SELECT person_id, branch, med AS median_lag, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM y""", "people", "filings", "trades"))
def scorecard(spark, sf):
    """Start at 100, deduct for missing filings, late disclosure, negative lags and low confidence, and grade."""
    t = B.trades(spark, sf)
    recent = C("trade_date") >= F.date_sub(C("d"), 730)
    s = t.crossJoin(F.broadcast(t.agg(F.max("trade_date").alias("d")))).groupBy("person_id").agg(
        F.median("lag_days").alias("all"), F.median(F.when(recent, C("lag_days"))).alias("late"), count_if(recent).alias("n"), F.bool_or(C("lag_days") < 0).alias("neg"), F.bool_or(C("confidence_pct") < 50).alias("low")
    )
    f = B.filings(spark, sf).select("person_id").distinct().withColumn("filed", F.lit(True))
    x = B.people(spark, sf).join(s, "person_id", "left").join(f, "person_id", "left").withColumn("median_lag", F.when(C("n") >= 10, C("late")).otherwise(C("all")))
    law = C("branch") == "Legislative"
    late = F.when(C("median_lag") > F.when(law, 90).otherwise(120), 25).when(C("median_lag") > F.when(law, 45).otherwise(60), 15).otherwise(0)
    less = F.when(C("filed").isNull(), 30).otherwise(0) + late + F.when(C("neg"), 10).otherwise(0) + F.when(C("low"), 10).otherwise(0)
    x = x.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - less)))
    grade = F.when(C("score") >= 90, "A").when(C("score") >= 80, "B").when(C("score") >= 70, "C").when(C("score") >= 60, "D").otherwise("F")
    return x.select("person_id", "branch", "median_lag", "score", grade.alias("grade"))


@query("dm5_benchmark_move", sql(""", e AS (SELECT filing_id, filed_date AS d FROM filings WHERE status = 'P'), b AS (SELECT date, cents FROM series WHERE symbol = '1-URGENT'),
 s AS (SELECT e.filing_id, e.d, b.date AS sd, b.cents AS sv FROM e ASOF LEFT JOIN b ON e.d <= b.date), x AS (SELECT s.*, b.date AS ed, b.cents AS ev FROM s ASOF LEFT JOIN b ON s.sd + 30 >= b.date)
 SELECT filing_id, sd AS start_date, CASE WHEN ed > sd THEN ed END AS end_date, CASE WHEN ed > sd AND sv <> 0 THEN round((CAST(ev AS DOUBLE) / sv - 1) * 100, 4) END AS move_pct FROM x""", "filings", "series"))
def benchmark_move(spark, sf, horizon: int = 30):
    """The start snaps forward to a priced day, the end backward from start + horizon; null unless end is later."""
    e = B.filings(spark, sf).filter("status = 'P'").select("filing_id", C("filed_date").alias("d"), F.lit("1-URGENT").alias("symbol"))
    s = B.series(spark, sf).filter("symbol = '1-URGENT'")
    a = temporal.asof_join(e, s, "symbol", "d", "date", ["cents"], forward=True).withColumnsRenamed({"asof_date": "sd", "asof_cents": "sv"}).withColumn("until", F.date_add("sd", horizon))
    b = temporal.asof_join(a, s, "symbol", "until", "date", ["cents"])
    ok = C("asof_date") > C("sd")
    move = F.round((C("asof_cents").cast("double") / C("sv") - 1) * 100, 4)
    return b.select("filing_id", C("sd").alias("start_date"), F.when(ok, C("asof_date")).alias("end_date"), F.when(ok & (C("sv") != 0), move).alias("move_pct"))


@query("dm7_market_reaction", sql(""", c AS (SELECT a.symbol, a.date, a.cents AS ac, b.cents AS bc FROM series a JOIN series b USING (date) WHERE b.symbol = '5-LOW' AND a.symbol <> '5-LOW'),
 m AS (SELECT symbol, date, ac, bc, lag(ac, 5) OVER w AS a0, lag(bc, 5) OVER w AS b0, lead(ac, 5) OVER w AS a1, lead(bc, 5) OVER w AS b1 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 e AS (SELECT DISTINCT filing_type AS symbol, filed_date AS event_date FROM filings WHERE status = 'P' AND filing_type <> '5-LOW'),
 j AS (SELECT e.symbol, e.event_date, m.* EXCLUDE (symbol) FROM e ASOF LEFT JOIN m ON e.symbol = m.symbol AND e.event_date <= m.date)
 SELECT symbol, event_date, date AS anchor_date, round((CAST(ac AS DOUBLE) / a0 - 1) * 100 - (CAST(bc AS DOUBLE) / b0 - 1) * 100, 6) AS pre_adjusted, round((CAST(a1 AS DOUBLE) / ac - 1) * 100 - (CAST(b1 AS DOUBLE) / bc - 1) * 100, 6) AS post_adjusted,
 CASE WHEN date IS NULL OR (a0 IS NULL AND a1 IS NULL) THEN 'unavailable' WHEN a0 IS NULL OR a1 IS NULL THEN 'partial' ELSE 'covered' END AS status FROM j""", "filings", "series"))
def market_reaction(spark, sf, sessions: int = 5):
    """Benchmark-adjusted returns in session windows around the first common priced day on or after an event."""
    s = B.series(spark, sf)
    bench = s.filter("symbol = '5-LOW'").select("date", C("cents").alias("bc"))
    w = Window.partitionBy("symbol").orderBy("date")
    near = s.filter("symbol <> '5-LOW'").join(bench, "date").select(
        "symbol", "date", C("cents").alias("ac"), "bc", F.lag("cents", sessions).over(w).alias("a0"), F.lag("bc", sessions).over(w).alias("b0"), F.lead("cents", sessions).over(w).alias("a1"), F.lead("bc", sessions).over(w).alias("b1")
    )
    e = B.filings(spark, sf).filter("status = 'P' and filing_type <> '5-LOW'").select(C("filing_type").alias("symbol"), C("filed_date").alias("event_date")).distinct()
    j = temporal.asof_join(e, near, "symbol", "event_date", "date", ["ac", "bc", "a0", "b0", "a1", "b1"], forward=True)
    pct = lambda b, a: (C(f"asof_{b}").cast("double") / C(f"asof_{a}") - 1) * 100
    status = F.when(C("asof_date").isNull() | (C("asof_a0").isNull() & C("asof_a1").isNull()), "unavailable").when(C("asof_a0").isNull() | C("asof_a1").isNull(), "partial").otherwise("covered")
    return j.select("symbol", "event_date", C("asof_date").alias("anchor_date"), F.round(pct("ac", "a0") - pct("bc", "b0"), 6).alias("pre_adjusted"), F.round(pct("a1", "ac") - pct("b1", "bc"), 6).alias("post_adjusted"), status.alias("status"))


@query("dm11_history_overlaps", sql(", h AS (SELECT person_id, filing_id, filed_date AS valid_from, filed_date + CAST(filing_id % 200 AS INTEGER) AS valid_to FROM filings) SELECT person_id, filing_id, valid_from FROM (SELECT *, max(valid_to) OVER (PARTITION BY person_id ORDER BY valid_from, filing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h) WHERE reach >= valid_from", "filings"))
def history_overlaps(spark, sf):
    h = B.filings(spark, sf).select("person_id", "filing_id", C("filed_date").alias("valid_from"), F.date_add("filed_date", (C("filing_id") % 200).cast("int")).alias("valid_to"))
    w = Window.partitionBy("person_id").orderBy("valid_from", "filing_id").rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("reach", F.max("valid_to").over(w)).filter("reach >= valid_from").select("person_id", "filing_id", "valid_from")


@query("dm18_cluster_context", sql(""", d AS (SELECT person_id, trade_date, CASE WHEN trade_date - lag(trade_date) OVER (PARTITION BY person_id ORDER BY trade_date) > 14 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT person_id, trade_date FROM trades)),
 c AS (SELECT person_id, trade_date, sum(s) OVER (PARTITION BY person_id ORDER BY trade_date) AS cluster FROM d), g AS (SELECT person_id, cluster, min(trade_date) AS a, max(trade_date) AS b FROM c GROUP BY 1, 2),
 x AS (SELECT g.person_id, g.a AS cluster_start, f.filing_id, CASE WHEN f.filed_date < a THEN 'before' WHEN f.filed_date > b THEN 'after' ELSE 'during' END AS bucket, CASE WHEN f.filed_date < a THEN a - f.filed_date WHEN f.filed_date > b THEN f.filed_date - b ELSE 0 END AS dist FROM g JOIN filings f ON f.person_id = g.person_id AND f.filed_date BETWEEN a - 45 AND b + 45)
 SELECT person_id, cluster_start, bucket, filing_id, CAST(dist AS INTEGER) AS distance FROM x QUALIFY row_number() OVER (PARTITION BY person_id, cluster_start, bucket ORDER BY dist, filing_id) <= 2""", "filings", "trades"))
def cluster_context(spark, sf):
    """The two nearest filings before, during and after each trade cluster."""
    g = windows.gap_periods(B.trades(spark, sf), "person_id", "trade_date", 14)
    f = B.filings(spark, sf).select("person_id", "filing_id", "filed_date")
    x = temporal.span_join(g, f, "person_id", "cluster_start", "cluster_end", "filed_date", 45)
    early, late = F.datediff("cluster_start", "filed_date"), F.datediff("filed_date", "cluster_end")
    x = x.withColumn("bucket", F.when(early > 0, "before").when(late > 0, "after").otherwise("during")).withColumn("distance", F.greatest(early, late, F.lit(0)))
    return windows.top_per_group(x, ["person_id", "cluster_start", "bucket"], ["distance", "filing_id"], 2).select("person_id", "cluster_start", "bucket", "filing_id", "distance")


@query("dm24_duplicate_flags", sql("SELECT filing_id, line, ticker, n > 1 AS duplicate_candidate FROM (SELECT filing_id, line, ticker, count(*) OVER (PARTITION BY person_id, trade_date, action, ticker, value_cents) AS n FROM trades)", "trades"))
def duplicate_flags(spark, sf):
    """Annotate, never drop. Signature counts are aggregated first and joined, so that a hot signature can be split."""
    t, key = B.trades(spark, sf), ["person_id", "trade_date", "action", "ticker", "value_cents"]
    return t.join(t.groupBy(*key).agg(ONE().alias("n")), key).select("filing_id", "line", "ticker", (C("n") > 1).alias("duplicate_candidate"))


@query("dm26_amendment_links", sql(""", a AS (SELECT b.filing_id AS filing_id, a.filing_id AS prior_id, CAST(round(20 * (1 - (b.filed_date - a.filed_date) / 46.0) + CASE WHEN a.filed_date = b.filed_date THEN 25 ELSE 0 END + CASE WHEN a.status = b.status THEN 60 ELSE 0 END, 4) AS DOUBLE) AS score
 FROM filings a JOIN filings b ON a.person_id = b.person_id AND a.filing_type = b.filing_type AND a.filing_id <> b.filing_id AND b.filed_date - a.filed_date BETWEEN 0 AND 45 WHERE b.status <> 'F'),
 r AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY filing_id ORDER BY score DESC, prior_id))
 SELECT filing_id, score, CASE WHEN score < 80 THEN 'unmatched' WHEN next IS NOT NULL AND score - next < 15 THEN 'ambiguous' ELSE 'linked' END AS status, CASE WHEN score >= 80 AND (next IS NULL OR score - next >= 15) THEN prior_id END AS prior_id FROM r WHERE k = 1""", "filings"))
def amendment_links(spark, sf):
    """Score earlier filings of the same kind within 45 days; link only a good and clearly best one."""
    f = B.filings(spark, sf)
    prior = f.select("person_id", "filing_type", C("filing_id").alias("prior_id"), C("filed_date").alias("prior_date"), C("status").alias("prior_status"))
    both = f.filter("status <> 'F'").withColumn("who", F.struct("person_id", "filing_type")).drop("person_id", "filing_type")
    pairs = temporal.band_join(both, prior.withColumn("who", F.struct("person_id", "filing_type")).drop("person_id", "filing_type"), "who", "filed_date", "prior_date", 45)
    gap = F.datediff("filed_date", "prior_date")
    score = F.round(20 * (1 - gap / F.lit(46.0)) + F.when(gap == 0, 25).otherwise(0) + F.when(C("prior_status") == C("status"), 60).otherwise(0), 4)
    pairs = pairs.filter((gap >= 0) & (C("filing_id") != C("prior_id"))).withColumn("score", score)
    w = Window.partitionBy("filing_id").orderBy(C("score").desc(), "prior_id")
    best = pairs.withColumn("next", F.lead("score").over(w)).withColumn("k", F.row_number().over(w)).filter("k = 1")
    status = F.when(C("score") < 80, "unmatched").when(C("score") - C("next") < 15, "ambiguous").otherwise("linked")
    return best.select("filing_id", "score", status.alias("status"), F.when(status == "linked", C("prior_id")).alias("prior_id"))


@query("dm28_row_acceptance", sql("SELECT filing_id, line, lag_days, CASE WHEN lag_days < 0 THEN 'withheld' ELSE 'accepted' END AS decision, array_to_string(list_filter([CASE WHEN lag_days > 365 THEN 'lag_over_365' END, CASE WHEN lag_days > 45 THEN 'late' END, CASE WHEN confidence_pct < 50 THEN 'low_confidence' END], lambda x: x IS NOT NULL), '|') AS flags FROM trades", "trades"))
def row_acceptance(spark, sf):
    flags = F.array_compact(F.array(F.when(C("lag_days") > 365, "lag_over_365"), F.when(C("lag_days") > 45, "late"), F.when(C("confidence_pct") < 50, "low_confidence")))
    return B.trades(spark, sf).select("filing_id", "line", "lag_days", F.when(C("lag_days") < 0, "withheld").otherwise("accepted").alias("decision"), F.array_join(flags, "|").alias("flags"))


@query("dm42_topic_rules", "WITH r(topic, pattern) AS (VALUES ('commerce', 'buy|purchase'), ('trouble', 'err'), ('traffic', 'click|view')) SELECT event_id, string_agg(topic, '|' ORDER BY topic) AS topics FROM events JOIN r ON regexp_matches(event_type, pattern) GROUP BY 1")
def topic_rules(spark, sf):
    # The rule table of this example.
    rules = {"commerce": "buy|purchase", "traffic": "click|view", "trouble": "err"}
    hits = F.array_compact(F.array(*[F.when(C("event_type").rlike(p), t) for t, p in sorted(rules.items())]))
    return B.table(spark, sf, "events").select("event_id", F.array_join(hits, "|").alias("topics")).filter("topics <> ''")


@query("er6_entity_ids", sql("SELECT person_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS entity_id FROM (SELECT person_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('person:' || full_name)) AS h FROM people)", "people"))
def entity_ids(spark, sf):
    """Stable version 5 ids of people in the URL namespace."""
    return B.people(spark, sf).select("person_id", T.uuid5_like("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.lit("person:"), C("full_name"))).alias("entity_id"))


@query("u4_line_transactions", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (regexp_matches(line, '\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{4}-\d{2}-\d{2}\b')) AS BIGINT) AS n_dated FROM l GROUP BY 1""")
def line_transactions(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    dated = F.filter(lines, lambda x: x.rlike(r"\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"))
    return B.table(spark, sf, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(dated).cast("long").alias("n_dated"))


@query("v3_series_violations", sql(", s AS (SELECT person_id AS symbol, filed_date AS date, max(cents) AS cents FROM filings GROUP BY 1, 2), n AS (SELECT symbol, date, cents, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM s) SELECT symbol, date, date - prev AS gap_days FROM n WHERE cents <= 0 OR date - prev > 180", "filings"))
def series_violations(spark, sf):
    """Values that aren't positive and gaps of over 180 days, in a series for each person."""
    own = B.filings(spark, sf).groupBy(C("person_id").alias("symbol"), C("filed_date").alias("date")).agg(F.max("cents").alias("cents"))
    n = own.withColumn("gap_days", F.datediff("date", F.lag("date").over(Window.partitionBy("symbol").orderBy("date"))).cast("long"))
    return n.filter("cents <= 0 or gap_days > 180").select("symbol", "date", "gap_days")


@query("v10_check_constraints", sql("SELECT filing_id, line, CASE WHEN reported_date < trade_date THEN 'reported_before_trade' ELSE 'confidence_out_of_range' END AS violation FROM trades WHERE reported_date < trade_date OR confidence_pct NOT BETWEEN 0 AND 100", "trades"))
def check_constraints(spark, sf):
    bad = F.when(C("reported_date") < C("trade_date"), "reported_before_trade").when(~C("confidence_pct").between(0, 100), "confidence_out_of_range")
    return B.trades(spark, sf).select("filing_id", "line", bad.alias("violation")).filter("violation is not null")
