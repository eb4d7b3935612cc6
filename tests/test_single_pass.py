"""Queries that read a large table, or an expensive column, once: seen in their plans."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyglass import registry
from tallyglass.operators import context as X
from tallyglass.operators import temporal as T
from tallyglass.operators import windows as W

SF = "/root/testdata/sf0.001"


def plan(frame, executed=False):
    made = frame._jdf.queryExecution()
    return (made.executedPlan() if executed else made.optimizedPlan()).toString()


def test_text_is_read_once(spark):
    assert plan(registry.QUERIES["u3_table_detection"](spark, SF)).count(r"\r\n|\r|\n") == 1
    assert plan(registry.QUERIES["u5_executive_form_rows"](spark, SF)).count(r"pur\s*cha\s*se") == 1


def test_prices_come_from_days(spark):
    assert "l_orderkey" not in plan(registry.QUERIES["dm63_price_series"](spark, SF))
    assert "l_orderkey" not in plan(registry.QUERIES["dm63_extreme_moves"](spark, SF))


def test_matches_are_not_dealt_anew(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("j20_aliases_in_documents", "j20_first_mapping"):
            made = plan(registry.QUERIES[name](spark, SF), executed=True)
            assert "SortMergeJoin" not in made and "SortAggregate" not in made
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_context_reads_trades_once(spark):
    for name in ("dm18_trade_context_candidates", "dm20_trade_context_rows", "dm60_career_timeline"):
        assert "l_orderkey" not in plan(registry.QUERIES[name](spark, SF))


def test_rounds_of_a_ledger_read_a_staged_log(spark):
    assert "get_json_object" not in plan(registry.QUERIES["dm64_bulk_decisions"](spark, SF))


def test_context_meets_trades_once(spark):
    """trades aren't joined with their days, nor met again for their movement."""
    assert plan(registry.QUERIES["dm18_trade_context_candidates"](spark, SF)).count("Join ") <= 4
    made = plan(X.clustered(spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_custkey AS person_id", "o_orderkey AS trade_id", "cast(o_orderdate AS date) AS date", "o_totalprice AS movement")), executed=True)
    assert made.count("Exchange") == 1 and "Join" not in made


def test_clusters_of_rows_are_those_of_days(spark):
    """repeated and null dates, null persons, ids that repeat."""
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.randint(1, 30), rng.choice([None, day(rng.randint(0, 400))]), rng.choice([None, rng.random()])) for _ in range(200)] + [(9, 1, day(3), None)]
    frame = spark.createDataFrame(rows, "person_id int, trade_id int, date date, movement double")
    got = X.clustered(frame)
    want = W.gap_clusters(frame, "person_id", "date", 14)
    cols = ["person_id", "trade_id", "date", "movement", "cluster"]
    flat = lambda f: sorted(map(str, f.select(*cols).collect()))
    assert flat(got) == flat(want)
    by = {k: (a, b, m) for *k, a, b, m in want.groupBy("person_id", "cluster").agg(F.min("date"), F.max("date"), F.coalesce(F.max("movement"), F.lit(0.0))).collect() for k in [tuple(k)]}
    of = {(p, t): max((m for q, u, d, m in rows if (q, u) == (p, t) and d and m is not None), default=None) for p, t, *_ in rows}
    assert all((r.a, r.b, r.m) == by[r.person_id, r.cluster] and r.id_movement == of[r.person_id, r.trade_id] for r in got.collect())


def test_bands_equal_all_pairs(spark):
    """a row meets two buckets at most; days before 1970, null dates, a band of no days."""
    day = lambda n: dt.date(1970, 1, 1) + dt.timedelta(n)
    rng = random.Random(6)
    left = [(k, rng.choice([None, 1, 2]), rng.choice([None, day(rng.randint(-300, 300))])) for k in range(120)]
    right = [(k, rng.choice([None, 1, 2]), rng.choice([None, day(rng.randint(-300, 300))])) for k in range(120)]
    a, b = spark.createDataFrame(left, "i int, key int, d date"), spark.createDataFrame(right, "j int, key int, e date")
    for n in (0, 1, 14, 45):
        made = T.band_join(a, b, "key", "d", "e", n)
        want = sorted((i, j) for i, k, d in left for j, m, e in right if k and k == m and d and e and abs((d - e).days) <= n)
        assert sorted((r.i, r.j) for r in made.collect()) == want
        assert "array(-1, 0, 1)" not in plan(made) and "[-1,0,1]" not in plan(made)
