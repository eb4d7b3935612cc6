"""Verified imports and releases over the bound tables, with planted damage of each kind."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import releases as R
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}
HOSTS = ["records.example"]


def entries(spark, sf):
    """Each web page as an entry of an import manifest; one in some primes is damaged in one way or another."""
    k = C("page_id")
    body = F.encode("html", "utf-8")
    name = F.concat(F.lit("https://records.example/"), F.when(k % 41 == 3, k - 1).otherwise(k).cast("string"))
    url = F.when(k % 37 == 2, F.regexp_replace(name, "https:", "http:")).when(k % 43 == 1, F.regexp_replace(name, "//", "//user@")).when(k % 31 != 4, name)
    path = F.when(k % 29 == 5, F.concat(F.lit("a/../../"), k.cast("string"))).when(k % 29 == 6, F.concat(F.lit("/etc/"), k.cast("string"))).when(k % 3 == 0, F.concat(F.lit("pages/"), k.cast("string"), F.lit("..html")))
    return B.table(spark, sf, "pages").select(
        k.alias("entry"), url.alias("source_url"), path.alias("path"), body.alias("body"), F.when(k % 23 == 7, F.sha2("html", 224)).when(k % 2 == 0, F.upper(F.sha2("html", 256))).otherwise(F.sha2("html", 256)).alias("response_sha256"),
        (F.octet_length("html") + F.when(k % 19 == 8, 1).otherwise(0)).cast("long").alias("byte_count"),
    )


def faults(spark, sf):
    return R.verified(entries(spark, sf), HOSTS).filter(F.size("faults") > 0).select("entry", F.array_join("faults", "|").alias("faults"))


QUERIES["sc19_import_faults"] = faults


def import_totals(spark, sf):
    """The totals of the import against those that its manifest would claim: the table's own."""
    claim = B.table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html").cast("long")).alias("b")).first()
    return R.reconciled(R.verified(entries(spark, sf), HOSTS), {"entry_count": claim.n, "total_bytes": claim.b})


QUERIES["sc19_import_totals"] = import_totals


def _years(spark, sf):
    return B.filings(spark, sf).withColumn("year", F.year("filed_date")).select("filing_id", "person_id", "filed_date", "filing_type", "cents", "year")


def partition_faults(spark, sf):
    """Partitions by year against the manifest of the same rows, after some years were damaged."""
    rows = _years(spark, sf)
    manifest = R.partition_manifest(rows, ["year"], "filing_id").filter("year <> 1997")
    damaged = rows.filter("not (year = 1995 and filing_id % 10 = 0) and year <> 1993")
    damaged = damaged.withColumn("cents", C("cents") + F.when((C("year") == 1996) & (C("filing_id") % 10 == 1), 1).otherwise(0))
    damaged = damaged.withColumn("filing_id", F.when((C("year") == 1998) & (C("filing_id") % 10 == 2), C("filing_id") + 1).otherwise(C("filing_id")))
    return R.verify_partitions(R.partition_manifest(damaged, ["year"], "filing_id"), manifest, ["year"])


QUERIES["sc4_partition_faults"] = partition_faults


def released(spark, sf):
    """Filings by year after a release and a refresh of some documents, read back: years with what they hold."""
    root = f"{shared_folder(spark)}/tallyglass/release-{uuid.uuid4().hex}"
    rows = _years(spark, sf)
    R.publish(rows, root, "year")
    later = rows.filter(C("filing_id") % 50 == 7).withColumn("year", C("year") + F.when(C("filing_id") % 100 == 7, 1).otherwise(0)).withColumn("cents", C("cents") * 2)
    R.refresh(root, later, "year", "filing_id")
    return R.read(spark, root, "year").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.countDistinct("filing_id").alias("documents"))


QUERIES["sk5_release_refresh"] = released


def digests(spark, sf):
    """The digest of each year, and whether that of the same rows in another order, layout and column order is equal."""
    rows = _years(spark, sf)
    mixed = rows.select(*reversed(rows.columns)).repartition(7, "person_id")
    a = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), R.multiset_digest(rows, ("year",)).alias("a"))
    b = mixed.groupBy("year").agg(R.multiset_digest(mixed, ("year",)).alias("b"))
    twice = rows.unionByName(rows.filter("filing_id % 1000 = 1"))
    c = twice.groupBy("year").agg(R.multiset_digest(twice, ("year",)).alias("c"))
    return a.join(b, "year").join(c, "year").select("year", "n", (C("a") == C("b")).alias("same_rows"), (C("a") != C("c")).alias("repeat_found"))


QUERIES["v8_content_digest"] = digests

ORACLES["sc19_import_faults"] = """WITH e AS (SELECT page_id AS k, html, CASE WHEN page_id % 31 = 4 AND page_id % 37 <> 2 AND page_id % 43 <> 1 THEN NULL ELSE CASE WHEN page_id % 37 = 2 THEN 'http:' WHEN page_id % 43 = 1 THEN 'user@' ELSE '' END || CASE WHEN page_id % 41 = 3 THEN page_id - 1 ELSE page_id END END AS u FROM pages),
 f AS (SELECT k, list_sort(list_filter([CASE WHEN u IS NULL OR html IS NULL THEN 'incomplete_entry' END, CASE WHEN u IS NOT NULL AND (k % 37 = 2 OR k % 43 = 1) THEN 'address_not_allowed' END, CASE WHEN k % 29 IN (5, 6) THEN 'path_outside' END, CASE WHEN k % 23 = 7 AND html IS NOT NULL THEN 'hash_mismatch' END,
 CASE WHEN k % 19 = 8 AND html IS NOT NULL THEN 'size_mismatch' END, CASE WHEN u IS NOT NULL AND count(*) OVER (PARTITION BY u) > 1 THEN 'duplicate_address' END], lambda x: x IS NOT NULL)) AS faults FROM e)
 SELECT k AS entry, array_to_string(faults, '|') AS faults FROM f WHERE len(faults) > 0"""
ORACLES["sc19_import_totals"] = f"""WITH g AS (SELECT * FROM ({ORACLES["sc19_import_faults"]})) SELECT (SELECT count(*) FROM pages) AS entries, (SELECT count(*) FROM pages) - count(*) AS sound, (SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) FROM pages) AS bytes,
 {", ".join(f"count(*) FILTER (contains(faults, '{k}')) AS {k}" for k in ("incomplete_entry", "address_not_allowed", "path_outside", "hash_mismatch", "size_mismatch", "duplicate_address"))}, true AS totals_agree FROM g"""
ORACLES["sc4_partition_faults"] = """SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CASE year(o_orderdate) WHEN 1997 THEN 'unlisted' WHEN 1995 THEN 'row_count' WHEN 1993 THEN 'missing' WHEN 1996 THEN 'content' ELSE 'ids' END AS fault FROM orders WHERE year(o_orderdate) IN (1993, 1995, 1996, 1997, 1998)"""
ORACLES["sk5_release_refresh"] = """SELECT y AS year, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, count(DISTINCT o_orderkey) AS documents FROM (SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 100 = 7 THEN 1 ELSE 0 END AS INTEGER) AS y,
 CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 50 = 7 THEN 2 ELSE 1 END AS c FROM orders) GROUP BY 1"""
ORACLES["v8_content_digest"] = "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, true AS same_rows, count(*) FILTER (o_orderkey % 1000 = 1) > 0 AS repeat_found FROM orders GROUP BY 1"
