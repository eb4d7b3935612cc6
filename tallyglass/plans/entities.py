"""The organization reference over the bound tables, with SQL written apart.

Parts whose key is equal modulo TICKERS share a ticker and thus an issuer; line items disclose its label in several
spellings. Some tickers aren't registered, some have two issuers, some are disclosed under other names or too seldom, some
companies hold their neighbour's ticker, and every tenth name carries no number, so that several issuers share it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}
TICKERS, LEAST = 300, 3


def _text(col):
    return col.cast("string")


def issuers(spark, sf):
    """(k, base, other): a ticker's number, its issuer's plain name, and another name that sources use."""
    part = B.table(spark, sf, "part").withColumn("k", C("p_partkey") % TICKERS)
    rows = part.groupBy("k").agg(F.min_by("p_name", "p_partkey").alias("low"), F.max_by("p_name", "p_partkey").alias("high"))
    return rows.select("k", F.concat("low", _suffix()).alias("base"), C("high").alias("other"))


def _suffix():
    return F.when(C("k") % 10 == 0, "").otherwise(F.concat(F.lit(" "), _text(C("k"))))


def _official():
    return F.concat(F.upper("base"), F.when(C("k") % 2 == 0, " CORP").otherwise(" CORP /DE/"))


def registered(spark, sf):
    rows = issuers(spark, sf).filter("k % 11 <> 3")
    first = rows.select("k", F.concat(F.lit("T"), _text(C("k"))).alias("ticker"), F.concat(F.lit("C"), _text(C("k"))).alias("cik"), _official().alias("company_name"), F.lit("NYSE").alias("exchange"))
    twice = first.filter("k % 6 = 0").withColumn("exchange", F.lit("CBOE"))
    second = rows.filter("k % 13 = 5").select("k", F.concat(F.lit("T"), _text(C("k"))).alias("ticker"), F.concat(F.lit("C"), _text(C("k")), F.lit("X")).alias("cik"), F.concat(F.upper("other"), F.lit(" TRUST")).alias("company_name"), F.lit("NYSE").alias("exchange"))
    return first.unionByName(twice).unionByName(second).drop("k")


def disclosures(spark, sf):
    rows = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), C("l_partkey") == C("p_partkey")).withColumn("k", C("p_partkey") % TICKERS)
    ticker = F.concat(F.when(C("l_linenumber") % 5 == 0, " t").otherwise("T"), _text(C("k")))
    base = F.concat("p_name", _suffix())
    label = (
        F.when(F.round(C("l_discount") * 100) == 9, F.concat(base, F.lit(" Preferred Series B")))
        .when((C("k") % 7 == 2) & (C("l_quantity") > 2), F.concat(F.lit("Foreign "), base))
        .when(C("l_linenumber") % 4 == 0, F.concat(base, F.lit(" Inc. ("), F.trim(F.upper(ticker)), F.lit(") [ST]")))
        .when(C("l_linenumber") % 4 == 1, F.concat(F.lit("The "), base, F.lit(" Corporation")))
        .when(C("l_linenumber") % 4 == 2, F.concat(F.upper(base), F.lit(" Common Stock Filing Status: New")))
        .otherwise(F.concat(base, F.lit(" - Class A Shares")))
    )
    return rows.select(
        F.concat_ws(":", _text(C("l_orderkey")), _text(C("l_linenumber"))).alias("id"), F.when(F.round(C("l_tax") * 100) != 8, ticker).alias("ticker"), label.alias("label"),
        F.when(C("l_orderkey") % 2 == 0, "house").otherwise("senate").alias("source_dataset"), C("p_type").alias("asset_class"),
    )


def evidence(spark, sf):
    return E.alias_evidence(disclosures(spark, sf), registered(spark, sf), LEAST)


def _flat(rows):
    return rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else c for c, t in rows.dtypes])


QUERIES["dm51_alias_evidence"] = lambda spark, sf: _flat(evidence(spark, sf)[0])
QUERIES["dm51_alias_gaps"] = lambda spark, sf: _flat(evidence(spark, sf)[1])


def issuer_cores(spark, sf):
    """The core of each disclosed label, and whether it is its ticker's official one."""
    names = disclosures(spark, sf).select(E.symbol(C("ticker")).alias("ticker"), "label").filter("ticker is not null").distinct()
    rows = names.join(registered(spark, sf).select("ticker", "cik", "company_name").distinct(), "ticker")
    official, seen = E.issuer_core(C("company_name")), E.issuer_core(C("label"), C("ticker"))
    return rows.select("ticker", "label", "cik", official.alias("official_core"), seen.alias("observed_core"), ((official == seen) & (official != "")).alias("matches"))


QUERIES["st13_issuer_core"] = issuer_cores


def sources(spark, sf, records):
    """The five sources that make organizations, strongest first; records: the supported aliases."""
    base = issuers(spark, sf)
    none, number = F.lit(None).cast("string"), _text(C("k"))
    ticker = F.concat(F.lit("T"), number)
    empty = F.array().cast("array<string>")
    companies = base.filter("k % 11 <> 3 and k % 3 <> 0").select(
        F.concat(F.lit("sec-company:C"), number).alias("record_id"), _official().alias("name"), F.concat(F.lit("C"), number).alias("cik"), none.alias("source_entity_id"),
        F.when(C("k") % 17 == 0, F.array(ticker, F.concat(F.lit("T"), _text((C("k") + 1) % TICKERS)))).otherwise(F.array(ticker)).alias("symbols"),
    )
    supported = records.select(C("id").alias("record_id"), C("official_name").alias("name"), "cik", none.alias("source_entity_id"), F.array("ticker").alias("symbols")).distinct()
    labels = records.select(C("id").alias("record_id"), "alias", F.lit("disclosure_asset_label").alias("alias_type"), F.lit(1.0).alias("confidence"), "occurrence_count")
    market = base.filter("k % 4 <> 1").select(F.concat(F.lit("ticker-reference:"), ticker).alias("record_id"), F.concat("other", F.lit(" Trust")).alias("name"), none.alias("cik"), none.alias("source_entity_id"), F.array(ticker).alias("symbols"))
    brands = B.table(spark, sf, "part").select("p_brand").distinct()
    brand = F.regexp_replace("p_brand", "[^0-9]", "")
    companies_map = brands.select(F.lower("p_brand").alias("record_id"), F.concat("p_brand", F.lit(" Inc")).alias("name"), none.alias("cik"), F.concat(F.lit("ent-"), brand).alias("source_entity_id"), F.array(F.concat(F.lit("T"), brand), F.concat(F.lit("X"), brand)).alias("symbols"))
    contexts = brands.select(F.lower("p_brand").alias("record_id"), C("p_brand").alias("alias"), F.lit("context_alias").alias("alias_type"), F.lit(0.8).alias("confidence"), F.lit(0).cast("long").alias("occurrence_count"))
    assets = base.filter("k % 9 <> 4").select(F.concat(F.lit("asset-"), number).alias("record_id"), C("base").alias("name"), none.alias("cik"), none.alias("source_entity_id"), F.when(C("k") % 2 == 1, F.array(ticker)).otherwise(empty).alias("symbols"))
    return [
        E.Source("sec_filing_events", 80, companies), E.Source("sec_issuer_aliases", 85, supported, labels), E.Source("market_prices", 90, market),
        E.Source("company_entity_reference", 95, companies_map, contexts, known_symbols=True), E.Source("asset_resolution", 70, assets),
    ]


def reference(spark, sf):
    """(reference, issues and aliases with the disclosure labels linked)."""
    # The disclosures are read once: their labels' counts serve the evidence and the links.
    labels = E.staged(E.counted_labels(disclosures(spark, sf).drop("id")))
    records, _ = E.alias_evidence(labels, registered(spark, sf), LEAST)
    records = E.cut(records)
    made = E.build(sources(spark, sf, records))
    linked, issues = E.link_labels(labels, made, records)
    unresolved = issuers(spark, sf).filter("k % 9 = 4").select(F.concat(F.lit("T"), _text(C("k"))).alias("ticker"), E.fold(C("base")).alias("normalized_alias"), F.concat(F.lit("asset-"), _text(C("k"))).alias("record_id"))
    unresolved = unresolved.join(records.select("ticker", "normalized_alias"), ["ticker", "normalized_alias"], "left_anti")
    open_ = unresolved.select(F.lit("unresolved_asset_resolution").alias("issue_type"), F.lit("asset_resolution").alias("source"), "record_id", C("normalized_alias").alias("label"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"), F.lit(0).cast("long").alias("occurrence_count"))
    spelled = made.aliases.select("entity", "alias", "alias_type", "confidence", "occurrence_count", F.explode("sources").alias("source"))
    first = made.aliases.select("entity", "alias", "alias_type", "confidence", "occurrence_count", F.get("sources", F.lit(0)).alias("source"))
    more = spelled.join(first.select("entity", "alias", "alias_type", "source"), ["entity", "alias", "alias_type", "source"], "left_anti").withColumn("occurrence_count", F.lit(0).cast("long"))
    return made, E.folded_aliases(first.unionByName(more.select(*first.columns)).unionByName(linked)), made.issues.unionByName(issues).unionByName(open_)


QUERIES["dm50_organizations"] = lambda spark, sf: _flat(reference(spark, sf)[0].organizations())
QUERIES["dm50_aliases"] = lambda spark, sf: _flat(reference(spark, sf)[1])
QUERIES["dm50_issues"] = lambda spark, sf: reference(spark, sf)[2]
QUERIES["dm50_members"] = lambda spark, sf: reference(spark, sf)[0].members

_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_LESS = lambda x, words: "array_to_string(list_filter(string_split(" + _NORM(x) + ", ' '), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in words) + "], w)), ' ')"


def _core(x, ticker=None):
    if ticker:
        x = f"regexp_replace({x}, '(?i)\\(\\s*\\Q' || {ticker} || '\\E\\s*\\)', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)\\[\\s*(ST|OT)\\s*\\]', ' ', 'g'), '(?is)\\b(filing\\s+status|subholding\\s+of|holding\\s+of|description|comments|location)\\b.*$', '')"
    return _LESS(x, [*E.CORPORATE, *E.LABELS])


_BASE = f"""iss AS (SELECT p_partkey % {TICKERS} AS k, arg_min(p_name, p_partkey) || CASE WHEN any_value(p_partkey) % {TICKERS} % 10 = 0 THEN '' ELSE ' ' || (any_value(p_partkey) % {TICKERS}) END AS base, arg_max(p_name, p_partkey) AS other FROM part GROUP BY 1),
 off AS (SELECT *, 'T' || k AS ticker, upper(base) || CASE WHEN k % 2 = 0 THEN ' CORP' ELSE ' CORP /DE/' END AS official FROM iss),
 reg AS (SELECT ticker, 'C' || k AS cik, official AS company_name, unnest(CASE WHEN k % 6 = 0 THEN ['NYSE', 'CBOE'] ELSE ['NYSE'] END) AS exchange FROM off WHERE k % 11 <> 3 UNION ALL SELECT ticker, 'C' || k || 'X', upper(other) || ' TRUST', 'NYSE' FROM off WHERE k % 11 <> 3 AND k % 13 = 5),
 dis AS (SELECT *, 'T' || k AS ticker, p_name || CASE WHEN k % 10 = 0 THEN '' ELSE ' ' || k END AS b FROM (SELECT *, p_partkey % {TICKERS} AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE round(l_tax * 100) <> 8),
 lab AS (SELECT ticker, CASE WHEN round(l_discount * 100) = 9 THEN b || ' Preferred Series B' WHEN k % 7 = 2 AND l_quantity > 2 THEN 'Foreign ' || b WHEN l_linenumber % 4 = 0 THEN b || ' Inc. (' || ticker || ') [ST]' WHEN l_linenumber % 4 = 1 THEN 'The ' || b || ' Corporation'
 WHEN l_linenumber % 4 = 2 THEN upper(b) || ' Common Stock Filing Status: New' ELSE b || ' - Class A Shares' END AS label, CASE WHEN l_orderkey % 2 = 0 THEN 'house' ELSE 'senate' END AS ds, p_type FROM dis),
 seen AS (SELECT ticker, {_NORM('label')} AS norm, arg_min(label, {{'l': lower(label), 'v': label}}) AS alias, count(*) AS n, string_agg(DISTINCT ds, '|' ORDER BY ds) AS dss, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS classes FROM lab GROUP BY 1, 2),
 who AS (SELECT ticker, count(DISTINCT (cik, company_name)) AS n_issuers, min(cik) AS cik, min(company_name) AS official_name, string_agg(DISTINCT exchange, '|' ORDER BY exchange) AS exchanges FROM reg GROUP BY 1),
 met AS (SELECT seen.*, coalesce(n_issuers, 0) AS ni, exchanges, CASE WHEN n_issuers = 1 THEN who.cik END AS cik, CASE WHEN n_issuers = 1 THEN official_name END AS official_name, coalesce(n_issuers = 1 AND {_core('official_name')} = {_core('alias', 'seen.ticker')} AND {_core('official_name')} <> '', false) AS ok FROM seen LEFT JOIN who USING (ticker)),
 tic AS (SELECT ticker, sum(n) AS total, coalesce(sum(n) FILTER (ok), 0) AS acc, coalesce(sum(n) FILTER (NOT ok), 0) AS rej, max(ni) AS ni, max(cik) AS cik, max(official_name) AS official_name, coalesce(string_agg(alias, '|' ORDER BY alias) FILTER (ok), '') AS good, coalesce(string_agg(alias, '|' ORDER BY alias) FILTER (NOT ok), '') AS bad, string_agg(alias, '|' ORDER BY alias) AS every, count(*) FILTER (ok) AS na, count(*) FILTER (NOT ok) AS nr FROM met GROUP BY 1 HAVING sum(n) >= {LEAST}),
 evi AS (SELECT 'sec-issuer-alias:' || met.cik || ':' || ticker AS id, ticker, met.cik, met.official_name, exchanges, alias, norm AS normalized_alias, n AS occurrence_count, CAST(acc AS BIGINT) AS issuer_occurrences, dss AS source_datasets, classes AS asset_classes FROM met JOIN tic USING (ticker) WHERE ok AND acc >= {LEAST})"""
ORACLES["dm51_alias_evidence"] = f"WITH {_BASE} SELECT * FROM evi"
ORACLES["dm51_alias_gaps"] = f"""WITH {_BASE}, g AS (SELECT 'ticker_not_in_sec_reference' AS gap_type, total AS c, every AS o, * FROM tic WHERE ni = 0 UNION ALL SELECT 'ambiguous_sec_ticker', total, every, * FROM tic WHERE ni > 1
 UNION ALL SELECT 'supported_alias_below_frequency_threshold', acc, good, * FROM tic WHERE ni = 1 AND na > 0 AND acc < {LEAST} UNION ALL SELECT 'issuer_name_mismatch', rej, bad, * FROM tic WHERE ni = 1 AND (nr > 0 OR na = 0))
 SELECT ticker, gap_type, cik, official_name, CAST(ni AS INTEGER) AS n_issuers, CAST(c AS BIGINT) AS occurrence_count, o AS observed_aliases FROM g"""
ORACLES["st13_issuer_core"] = f"WITH {_BASE} SELECT ticker, label, cik, {_core('company_name')} AS official_core, {_core('label', 'ticker')} AS observed_core, {_core('company_name')} = {_core('label', 'ticker')} AS matches FROM (SELECT DISTINCT ticker, label FROM lab) JOIN (SELECT DISTINCT ticker, cik, company_name FROM reg) USING (ticker)"


def _stages() -> str:
    """Each source as records, their candidates among the organizations so far, and the keys after it."""
    records = [
        "SELECT 'sec-company:C' || k AS rid, official AS name, 'C' || k AS cik, CAST(NULL AS VARCHAR) AS src, CASE WHEN k % 17 = 0 THEN [ticker, 'T' || ((k + 1) % " + str(TICKERS) + ")] ELSE [ticker] END AS syms FROM off WHERE k % 11 <> 3 AND k % 3 <> 0",
        "SELECT DISTINCT id AS rid, official_name AS name, cik, CAST(NULL AS VARCHAR) AS src, [ticker] AS syms FROM evi",
        "SELECT 'ticker-reference:' || ticker AS rid, other || ' Trust' AS name, CAST(NULL AS VARCHAR) AS cik, CAST(NULL AS VARCHAR) AS src, [ticker] AS syms FROM off WHERE k % 4 <> 1",
        "SELECT DISTINCT lower(p_brand) AS rid, p_brand || ' Inc' AS name, CAST(NULL AS VARCHAR) AS cik, 'ent-' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS src, ['T' || regexp_replace(p_brand, '[^0-9]', '', 'g'), 'X' || regexp_replace(p_brand, '[^0-9]', '', 'g')] AS syms FROM part",
        "SELECT 'asset-' || k AS rid, base AS name, CAST(NULL AS VARCHAR) AS cik, CAST(NULL AS VARCHAR) AS src, CASE WHEN k % 2 = 1 THEN [ticker] ELSE CAST([] AS VARCHAR[]) END AS syms FROM off WHERE k % 9 <> 4",
    ]
    out = ["keys0 AS (SELECT CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS scheme, CAST(NULL AS VARCHAR) AS value WHERE false)"]
    for k, body in enumerate(records):
        kept = f" WHERE scheme <> 'symbol' OR value IN (SELECT value FROM keys{k} WHERE scheme = 'symbol')" if k == 3 else ""
        out += [
            f"rec{k} AS ({body})",
            f"""rk{k} AS (SELECT rid, 0 AS tier, 'cik' AS scheme, cik AS value FROM rec{k} WHERE cik IS NOT NULL UNION ALL SELECT rid, 0, 'source', src FROM rec{k} WHERE src IS NOT NULL UNION ALL SELECT rid, 0, 'symbol', unnest(syms) FROM rec{k}
 UNION ALL SELECT rid, 1, 'name', {_NORM('name')} FROM rec{k} UNION ALL SELECT rid, 2, 'core', {_LESS('name', E.CORPORATE)} FROM rec{k} WHERE {_LESS('name', E.CORPORATE)} <> '')""",
            f"cand{k} AS (SELECT rid, tier, entity FROM rk{k} JOIN keys{k} USING (scheme, value))",
            f"pick{k} AS (SELECT rid, min(entity) AS low, max(entity) AS high FROM cand{k} c WHERE tier = (SELECT min(tier) FROM cand{k} d WHERE d.rid = c.rid) GROUP BY 1)",
            f"ent{k} AS MATERIALIZED (SELECT rec{k}.*, low, high, CASE WHEN low = high THEN low ELSE '{k}|' || CASE WHEN cik IS NOT NULL THEN 'cik:' || cik WHEN src IS NOT NULL THEN 'source:' || src ELSE 'record:' || rid END END AS entity FROM rec{k} LEFT JOIN pick{k} USING (rid))",
            f"keys{k + 1} AS MATERIALIZED (SELECT * FROM keys{k} UNION SELECT entity, scheme, value FROM rk{k} JOIN ent{k} USING (rid){kept})",
        ]
    names = [("sec_filing_events", 80), ("sec_issuer_aliases", 85), ("market_prices", 90), ("company_entity_reference", 95), ("asset_resolution", 70)]
    out.append("named AS (" + " UNION ALL ".join(f"SELECT rid, entity, name, low, high, '{n}' AS source, {p} AS priority FROM ent{k}" for k, (n, p) in enumerate(names)) + ")")
    out.append(f"""lnk AS (SELECT g.*, low, high, CASE WHEN ticker IN (SELECT ticker FROM evi) THEN CASE WHEN (ticker, norm) IN (SELECT (ticker, normalized_alias) FROM evi) THEN 'supported' ELSE 'unsupported_sec_alias_label' END WHEN low IS NULL THEN 'unresolved_disclosed_ticker' WHEN low <> high THEN 'ambiguous_disclosed_ticker' ELSE 'linked' END AS kind
 FROM (SELECT {_NORM('label')} AS norm, ticker, ds, arg_min(label, {{'l': lower(label), 'v': label}}) AS label, count(*) AS n FROM lab GROUP BY 1, 2, 3) g LEFT JOIN (SELECT value AS ticker, min(entity) AS low, max(entity) AS high FROM keys5 WHERE scheme = 'symbol' GROUP BY 1) USING (ticker))""")
    return _BASE + ",\n " + ",\n ".join(out)


_ALL = _stages()
_UUID = lambda key: f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] FROM (SELECT sha1(unhex('{E.NAMESPACE}') || encode({key})) AS h))"
ORACLES["dm50_members"] = f"WITH {_ALL} SELECT rid AS record_id, entity, source FROM named"
ORACLES["dm50_organizations"] = f"""WITH {_ALL}, held AS (SELECT entity, min(value) FILTER (scheme = 'cik') AS cik, min(value) FILTER (scheme = 'source') AS src, min(value) FILTER (scheme = 'symbol') AS symbol, count(*) FILTER (scheme = 'symbol') AS n_symbols, count(*) FILTER (scheme = 'name') AS n_names FROM keys5 GROUP BY 1),
 nm AS (SELECT entity, arg_min(name, {{'a': -priority, 'b': len(name), 'c': lower(name), 'd': name}}) AS canonical_name, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM named GROUP BY 1),
 st AS (SELECT *, CASE WHEN cik IS NOT NULL THEN 'cik:' || cik WHEN src IS NOT NULL THEN 'source:' || src WHEN symbol IS NOT NULL THEN 'symbol:' || symbol ELSE 'name:' || {_NORM('canonical_name')} END AS stable_key FROM held JOIN nm USING (entity))
 SELECT entity, {_UUID("'organization:' || stable_key")} AS organization_id, stable_key, canonical_name, cik, symbol, n_symbols, n_names, sources FROM st"""
ORACLES["dm50_issues"] = f"""WITH {_ALL} SELECT 'ambiguous_entity_match' AS issue_type, source, rid AS record_id, {_NORM('name')} AS label, low, high, CAST(NULL AS BIGINT) AS occurrence_count FROM named WHERE low <> high
 UNION ALL SELECT kind, 'disclosure_labels', ticker || ':' || ds, norm, low, high, n FROM lnk WHERE kind NOT IN ('linked', 'supported')
 UNION ALL SELECT 'unresolved_asset_resolution', 'asset_resolution', 'asset-' || k, {_NORM('base')}, NULL, NULL, 0 FROM off WHERE k % 9 = 4 AND (ticker, {_NORM('base')}) NOT IN (SELECT (ticker, normalized_alias) FROM evi)"""
ORACLES["dm50_aliases"] = f"""WITH {_ALL}, al AS (SELECT entity, name AS alias, 'legal_or_issuer_name' AS alias_type, 1.0 AS confidence, 0 AS n, source FROM named UNION ALL SELECT entity, alias, 'disclosure_asset_label', 1.0, occurrence_count, 'sec_issuer_aliases' FROM evi JOIN ent1 ON id = rid
 UNION ALL SELECT entity, p_brand, 'context_alias', 0.8, 0, 'company_entity_reference' FROM ent3 JOIN (SELECT DISTINCT p_brand FROM part) ON rid = lower(p_brand) UNION ALL SELECT low, label, 'disclosure_asset_label', 1.0, n, 'disclosure_labels' FROM lnk WHERE kind = 'linked')
 SELECT entity, {_NORM('alias')} AS normalized_alias, alias_type, arg_min(alias, {{'l': lower(alias), 'v': alias}}) AS alias, CAST(max(confidence) AS DOUBLE) AS confidence, CAST(sum(n) AS BIGINT) AS occurrence_count, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM al GROUP BY 1, 2, 3"""
