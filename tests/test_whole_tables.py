"""Queries over whole tables, where an older query of the same item reads a subset of ids."""

from pyspark.sql import functions as F

import __spark_entry__ as e
from tallyglass.plans import bindings as B

SF = "/root/testdata/sf0.001"


def test_timeline_has_everyone(spark):
    got = e.queries()["dm3_timeline_all"](spark, SF).groupBy("person_id").agg(F.sum("n").alias("n"))
    want = B.trades(spark, SF).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("person_id >= 40").count()


def test_latest_active_reads_every_officer(spark):
    starts = sorted((r.filed_date, r.filing_id) for r in B.filings(spark, SF).collect())
    dates = {r.date for r in B.civic_events(spark, SF).select("date").collect()}
    want = {d: max(x for x in starts if 0 <= (d - x[0]).days < 90)[1] for d in dates if any(0 <= (d - x[0]).days < 90 for x in starts)}
    got = {r.date: r.officer for r in e.queries()["j22_latest_active_all"](spark, SF).collect()}
    assert got == want and any(o % 40 != 3 for o in got.values())
