"""Steps that hold or repeat less than they did, seen in their plans, and edge rows of the operators that do it."""

import datetime as dt

from tallyglass import registry
from tallyglass.operators import entities as E
from tallyglass.operators import windows as W
from tallyglass.plans import parsers as P

from .test_single_pass import SF, plan


def test_labels_are_folded_once_a_spelling(spark):
    """what the evidence reads is staged, and rows are counted before they are folded."""
    assert "l_orderkey" not in plan(registry.QUERIES["dm51_alias_evidence"](spark, SF))
    assert "l_orderkey" not in plan(registry.QUERIES["dm50_aliases"](spark, SF))
    rows = [(k, t, n, "house", "c") for k, (t, n) in enumerate([("T1", "Big Co"), ("T1", "Big Co"), (" t1", "BIG co "), ("T1", ""), (None, "Big Co"), ("T2", None)])]
    frame = spark.createDataFrame(rows, "id long, ticker string, label string, source_dataset string, asset_class string")
    for given in (frame, E.counted_labels(frame)):
        (got,) = E.observed_labels(given).collect()
        assert (got.ticker, got.normalized_alias, got.alias, got.occurrence_count, got.first_transaction_id) == ("T1", "big co", "BIG co", 3, 0)
    assert E.observed_labels(frame.drop("id")).first().occurrence_count == 3


def test_positional_rows_join_and_sort_no_words(spark):
    """one aggregate by filing; no window and no join of words."""
    made = plan(registry.QUERIES["u6_positional_table"](spark, SF), executed=True)
    assert "Window" not in made and made.count("SortMergeJoin") + made.count("BroadcastHashJoin") + made.count("ShuffledHashJoin") == 1
    page = [(100, 10, "1"), (101, 300, "BUY"), (90, 60, "head"), (103, 61, "Corp"), (101, 60, "AA"), (120, 10, "2"), (119, 400, "$5"), (125, 60, "BB")]
    frame = spark.createDataFrame([(7, page), (8, [(1, 60, "x")]), (9, [])], "filing_id long, words array<struct<top: int, x0: int, text: string>>")
    assert sorted(map(tuple, P.positional_rows(frame).collect())) == [(7, 1, "AA Corp", "BUY", "$5"), (7, 2, "BB", "", "")]


def test_periods_of_clusters_need_no_aggregate(spark):
    """equal to the clusters' least and largest dates, with repeated and null dates."""
    assert "Aggregate" not in plan(W.gap_periods(spark.read.parquet(f"{SF}/orders.parquet"), "o_custkey", "o_orderdate", 14))
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [(1, day(n)) for n in (0, 0, 14, 28, 43, 43, 43, 90)] + [(2, None), (2, day(3)), (3, None), (4, day(1)), (4, day(40)), (4, day(40))]
    frame = spark.createDataFrame(rows, "k int, d date")
    got = sorted(map(tuple, W.gap_periods(frame, "k", "d", 14).collect()))
    assert got == [(1, day(0), day(28)), (1, day(43), day(43)), (1, day(90), day(90)), (2, day(3), day(3)), (4, day(1), day(1)), (4, day(40), day(40))]


def test_distinct_counts_copy_no_rows(spark):
    """F25."""
    assert "Expand" not in plan(registry.QUERIES["dm31_page_quality"](spark, SF))


def test_lines_are_counted_before_they_meet_orders(spark, tmp_path):
    """lines are counted before a join, and keys that repeat in lines, in orders or in both count as the join's rows."""
    made = plan(registry.QUERIES["a17_duplicate_keys"](spark, SF))
    assert made.index("Join") < made.index("Aggregate")
    lines, orders = spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/orders.parquet")
    keys = [r[0] for r in orders.orderBy("o_orderkey").limit(3).collect()]
    lines = lines.filter(lines.l_orderkey.isin(keys)).dropDuplicates(["l_orderkey", "l_linenumber"])
    first = lines.filter(lines.l_orderkey.isin(keys[:2])).dropDuplicates(["l_orderkey"])
    lines.unionByName(first).unionByName(first.withColumn("l_orderkey", first.l_orderkey * 0 - 1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    some = orders.filter(orders.o_orderkey.isin(keys))
    some.unionByName(some.filter(some.o_orderkey.isin(keys[1:]))).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, registry.QUERIES["a17_duplicate_keys"](spark, str(tmp_path)).collect()))
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("bounded_l")
    spark.read.parquet(f"{tmp_path}/orders.parquet").createOrReplaceTempView("bounded_o")
    want = spark.sql("SELECT l_orderkey, CAST(l_linenumber AS BIGINT), count(*) AS n FROM bounded_l JOIN bounded_o ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) > 1")
    assert got == sorted(map(tuple, want.collect())) and {n for *_, n in got} >= {2, 4}
