"""Aliases in whole documents, mappings that the first label wins, and merged events with their scopes, with SQL.

Aliases are the beginnings of conversation turns, so there are thousands of them; events come from documents and pages,
whose ids and addresses overlap.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}


def aliases(spark, sf):
    """(pattern_id, position, pattern, ticker): the first eight letters of each turn, once each; order by length, then letters."""
    words = B.table(spark, sf, "conversations").select(F.substring(F.regexp_replace("text", "[^A-Za-z ]", ""), 1, 8).alias("pattern")).filter(F.length("pattern") >= 5).distinct()
    key = F.lower("pattern")
    number = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    return words.select(C("pattern").alias("pattern_id"), (F.length("pattern") * 100_000_000 + number).alias("position"), "pattern", F.concat(F.lit("T"), (number % 300).cast("string")).alias("ticker"), key.alias("p"))


def in_documents(spark, sf):
    """How many aliases each document holds, and which comes first."""
    known = M.ranked(aliases(spark, sf), "pattern_id")
    found = M.find(B.table(spark, sf, "documents"), known.select(C("rank").alias("pattern_id"), "position", "pattern"), "doc_id", "text")
    # Place and rank in one number, which a hash aggregate can hold: a place and a rank are below 2^31.
    rows = found.groupBy(C("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_aliases"), F.min(F.shiftleft("at", 31) + C("pattern_id")).alias("f"), F.max("position").alias("last"))
    rows = rows.withColumn("rank", F.pmod("f", F.lit(1 << 31)))
    return rows.join(F.broadcast(known.select("rank", C("pattern_id").alias("first_alias"))), "rank").select("doc_id", "n_aliases", "first_alias", (F.shiftright("f", 31) + 1).alias("first_at"), "last")


QUERIES["j20_aliases_in_documents"] = in_documents
QUERIES["j20_first_mapping"] = lambda spark, sf: M.first_match(B.table(spark, sf, "documents"), aliases(spark, sf), "doc_id", "text").select(C("id").alias("doc_id"), C("pattern_id").alias("alias"))


def alias_pages(spark, sf):
    """In how many documents each alias occurs: those that occur nowhere too."""
    known = aliases(spark, sf)
    n = M.find(B.table(spark, sf, "documents"), known, "doc_id", "text").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "pattern_id", "left").select(C("pattern_id").alias("alias"), F.coalesce("n", F.lit(0)).alias("n_documents"))


QUERIES["j20_alias_documents"] = alias_pages


def events(spark, sf):
    """(position, id, url, label): documents before pages; ids and addresses overlap within and between them."""
    docs = B.table(spark, sf, "documents").select(
        (C("doc_id") * 2).alias("position"), F.when(C("doc_id") % 11 != 0, F.concat(F.lit("e"), (C("doc_id") * 13 % 701).cast("string"))).alias("id"), F.when(C("doc_id") % 7 != 0, F.concat(F.lit("u"), (C("doc_id") * 5 % 613).cast("string"))).alias("url"), F.coalesce("text", F.lit("")).alias("label"),
    )
    pages = B.table(spark, sf, "pages").select((C("page_id") * 2 + 1_000_000_000).alias("position"), F.concat(F.lit("e"), (C("page_id") * 17 % 900).cast("string")).alias("id"), F.concat(F.lit("u"), (C("page_id") * 3 % 800).cast("string")).alias("url"), C("url").alias("label"))
    return docs.unionByName(pages)


QUERIES["dm45_kept_events"] = lambda spark, sf: M.keep_first(events(spark, sf), "position", ["id", "url"]).select("position", "id", "url")


def scopes(spark, sf):
    """Kept events with their ticker scope: that of the first mapping and of every alias that the label holds."""
    kept = M.keep_first(events(spark, sf), "position", ["id", "url"])
    known = aliases(spark, sf)
    found = M.find(kept, known, "position", "label").withColumnRenamed("position", "rank").join(known.select("pattern_id", "ticker"), "pattern_id")
    scope = found.groupBy(C("id").alias("position")).agg(F.min_by("pattern_id", F.struct("rank", "pattern_id")).alias("mapping"), F.array_join(F.array_sort(F.collect_set("ticker")), "|").alias("ticker_scope"), F.count(F.lit(1)).alias("n_entities"))
    return kept.select("position", "id").join(scope, "position", "left").select("position", "id", "mapping", F.coalesce("ticker_scope", F.lit("")).alias("ticker_scope"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


QUERIES["dm45_event_scopes"] = scopes


def event_quotas(spark, sf):
    """Of the kept events three for each ending of their id, by position."""
    kept = M.keep_first(events(spark, sf), "position", ["id", "url"]).withColumn("kind", F.coalesce(F.right("id", F.lit(1)), F.lit("none")))
    return M.quota(kept, ["kind"], [C("position")], 3).select("kind", "selection_rank", "position", "id")


QUERIES["dm44_event_quotas"] = event_quotas


def ticker_hints(spark, sf):
    """The ticker of the first entry of a table of beginnings that an asset's name holds."""
    parts = B.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    words = B.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(F.substring("w", 2, 3).alias("pattern")).distinct()
    table = words.select(C("pattern").alias("pattern_id"), F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long").alias("position"), "pattern")
    return parts.join(M.first_match(parts, table, "p_partkey", "text").withColumnRenamed("id", "p_partkey"), "p_partkey", "left").select("p_partkey", F.upper("pattern_id").alias("ticker"))


QUERIES["st12_ticker_hints"] = ticker_hints

_ALIASES = """al AS (SELECT a, len(a) * 100000000 + n AS position, lower(a) AS p, 'T' || (n % 300) AS ticker FROM (SELECT a, CAST('0x' || md5(a)[1:6] AS BIGINT) AS n FROM (SELECT DISTINCT regexp_replace(text, '[^A-Za-z ]', '', 'g')[1:8] AS a FROM conversations) WHERE len(a) >= 5))"""
_FOUND = f"{_ALIASES}, f AS (SELECT doc_id, a, position, strpos(t, p) AS spot FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN al ON contains(t, p))"
ORACLES["j20_aliases_in_documents"] = f"WITH {_FOUND} SELECT doc_id, count(*) AS n_aliases, arg_min(a, {{'s': spot, 'a': a}}) AS first_alias, min(spot) AS first_at, max(position) AS last FROM f GROUP BY 1"
ORACLES["j20_first_mapping"] = f"WITH {_FOUND} SELECT doc_id, arg_min(a, {{'p': position, 'a': a}}) AS alias FROM f GROUP BY 1"
ORACLES["j20_alias_documents"] = f"WITH {_FOUND} SELECT a AS alias, (SELECT count(*) FROM f WHERE f.a = al.a) AS n_documents FROM al"
_EVENTS = f"""{_ALIASES}, ev AS (SELECT doc_id * 2 AS position, CASE WHEN doc_id % 11 <> 0 THEN 'e' || (doc_id * 13 % 701) END AS id, CASE WHEN doc_id % 7 <> 0 THEN 'u' || (doc_id * 5 % 613) END AS url, coalesce(text, '') AS label FROM documents
 UNION ALL SELECT page_id * 2 + 1000000000, 'e' || (page_id * 17 % 900), 'u' || (page_id * 3 % 800), url FROM pages), o AS (SELECT *, row_number() OVER (ORDER BY position) AS i FROM ev),
 seq AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS urls, false AS kept UNION ALL SELECT o.i, CASE WHEN ok AND id IS NOT NULL THEN list_append(ids, id) ELSE ids END, CASE WHEN ok AND url IS NOT NULL THEN list_append(urls, url) ELSE urls END, ok
 FROM (SELECT o.i, o.id, o.url, ids, urls, NOT coalesce(list_contains(ids, o.id), false) AND NOT coalesce(list_contains(urls, o.url), false) AS ok FROM seq JOIN o ON o.i = seq.i + 1) o),
 kept AS (SELECT o.* FROM o JOIN seq ON o.i = seq.i WHERE kept)"""
ORACLES["dm45_kept_events"] = f"WITH RECURSIVE {_EVENTS} SELECT position, id, url FROM kept"
ORACLES["dm45_event_scopes"] = f"""WITH RECURSIVE {_EVENTS} SELECT k.position, any_value(k.id) AS id, arg_min(a, {{'p': al.position, 'a': a}}) AS mapping, coalesce(string_agg(DISTINCT ticker, '|' ORDER BY ticker), '') AS ticker_scope, count(a) AS n_entities FROM (SELECT *, lower(label) AS l FROM kept) k LEFT JOIN al ON contains(l, p) GROUP BY 1"""
ORACLES["dm44_event_quotas"] = f"WITH RECURSIVE {_EVENTS} SELECT kind, CAST(r AS INTEGER) AS selection_rank, position, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY position) AS r FROM (SELECT *, coalesce(right(id, 1), 'none') AS kind FROM kept)) WHERE r <= 3"
ORACLES["st12_ticker_hints"] = """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' '))[2:4] AS p FROM part), t AS (SELECT p, {'n': md5(p)[1:6], 'p': p} AS i FROM w) SELECT p_partkey, upper(arg_min(t.p, i)) AS ticker FROM part LEFT JOIN t ON t.p <> '' AND contains(lower(p_name || ' ' || p_type), lower(t.p)) GROUP BY 1"""
