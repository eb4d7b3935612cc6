"""Review and promotion logs over the bound tables, with SQL written apart.

Events stand for decisions on the user's candidate: the type gives the decision, and a number in the properties gives what
its reviewer saw: nothing, the last decision before (as if it had been accepted) or the one before that, and for some the
status as well. Line items stand for operations on filings, in an order of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..streaming import ledger as L
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}
OPS = {"click": "accept", "view": "narrow", "purchase": "reject", "error": "supersede", "signup": "comment"}


def _op():
    out = F.when(F.lit(False), None)
    for k, v in OPS.items():
        out = out.when(C("event_type") == k, v)
    return out


def decisions(spark, sf):
    rows = B.civic_events(spark, sf).select(C("user_id").alias("record"), (C("event_id") + 1).alias("seq"), _op().alias("op"), "k")
    w = Window.partitionBy("record").orderBy("seq")
    implied = F.when(F.lag("op").over(w).isin(*L.STATUS), F.lag("op").over(w))
    status = F.when(implied == "accept", "accepted").when(implied == "narrow", "narrowed").when(implied == "reject", "rejected").when(implied == "supersede", "superseded")
    seen = F.when(C("k") % 4 == 0, None).when(C("k") % 7 == 1, F.coalesce(F.lag("seq", 2).over(w), F.lit(0))).otherwise(F.coalesce(F.lag("seq").over(w), F.lit(0)))
    return rows.select(
        "record", "seq", "op", F.when(C("k") % 5 == 2, status).alias("expected_status"), seen.alias("expected_revision"), F.lit(None).cast("long").alias("batch_id"),
        F.when(C("k") % 23 == 5, "session_ended").alias("session_error"), "k",
    )


QUERIES["dm64_decisions"] = lambda spark, sf: L.replay(decisions(spark, sf)).select("record", "seq", "op", "accepted", "reason", "status", "revision")
QUERIES["dm64_review_state"] = lambda spark, sf: L.state(L.replay(decisions(spark, sf)))


def reasons(spark, sf):
    return L.replay(decisions(spark, sf)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record").alias("candidates"))


QUERIES["dm64_outcomes"] = reasons


def bulk(spark, sf):
    """Decisions of a minute with the same operation are one bulk decision, for four in five of them."""
    log = decisions(spark, sf).withColumn("batch_id", F.when(C("k") % 5 != 0, F.floor(C("seq") / 6) * 8 + F.pmod(F.hash("op"), F.lit(8))))
    return L.replay(log).select("record", "seq", "op", "batch_id", "accepted", "reason", "status", "revision")


QUERIES["dm64_bulk_decisions"] = bulk


def streamed(spark, sf):
    """The same log as a stream of files: outcomes appended to a table, read back."""
    # What a reviewer saw is part of the log; here it is derived from the bound table before it streams.
    folder = f"{shared_folder(spark)}/tallyglass/reviews-{uuid.uuid4().hex}"
    log, seen = f"{folder}/log", decisions(spark, sf)
    seen.drop("k").write.parquet(log)
    rows = L.stream(spark.readStream.schema(seen.drop("k").schema).parquet(log))
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return L.state(spark.read.schema(rows.schema).parquet(f"{folder}/out"))


QUERIES["stream_review_log"] = streamed


def operations(spark, sf):
    """Operations on filings: the line's flag tells which; a supersession names the filing of a near part."""
    rows = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey")).join(B.table(spark, sf, "customer"), C("o_custkey") == C("c_custkey"))
    filing = C("l_orderkey") % 2000
    op = F.when(C("l_linenumber") <= 3, "promote").when(C("l_returnflag") == "A", "rollback").otherwise("supersede")
    other = F.when(C("l_partkey") % 19 == 0, filing).otherwise((filing + C("l_suppkey") % 5 + 1) % 2000)
    order = Window.partitionBy("filing_id").orderBy("day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.select(filing.alias("filing_id"), op.alias("op"), F.when(op == "supersede", other).alias("replacement_id"), F.when((C("l_discount") * 100).cast("int") == 9, "hash_mismatch|no_reviewer").alias("blockers"), C("c_mktsegment").alias("full_name"), C("o_orderpriority").alias("branch"),
                       C("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # The log's number: days first, then filings, then the operations of a filing's day.
    seq = F.datediff("day", F.lit("1990-01-01").cast("date")).cast("long") * 10_000_000 + C("filing_id") * 5000 + F.row_number().over(order)
    return rows.select("filing_id", seq.alias("seq"), "op", "replacement_id", "blockers", "full_name", "branch")


QUERIES["dm35_operations"] = lambda spark, sf: L.promotions(operations(spark, sf))
QUERIES["dm35_filings"] = lambda spark, sf: L.filings(L.promotions(operations(spark, sf)))


def people(spark, sf):
    log = operations(spark, sf)
    return L.persons(L.promotions(log), log)


QUERIES["dm35_persons"] = people

_LOG = f"""d0 AS (SELECT user_id AS record, event_id + 1 AS seq, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPS.items())} END AS op, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
 d AS (SELECT *, row_number() OVER w AS i, CASE WHEN k % 5 = 2 THEN CASE lag(op) OVER w WHEN 'accept' THEN 'accepted' WHEN 'narrow' THEN 'narrowed' WHEN 'reject' THEN 'rejected' WHEN 'supersede' THEN 'superseded' END END AS want,
 CASE WHEN k % 4 = 0 THEN NULL WHEN k % 7 = 1 THEN coalesce(lag(seq, 2) OVER w, 0) ELSE coalesce(lag(seq) OVER w, 0) END AS seen FROM d0 WINDOW w AS (PARTITION BY record ORDER BY seq)),
 run AS (SELECT record, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS reason, 'candidate' AS status, CAST(0 AS BIGINT) AS revision FROM (SELECT DISTINCT record FROM d0)
 UNION ALL SELECT d.record, d.i, d.seq, d.op, r, CASE WHEN r IS NULL THEN CASE d.op WHEN 'accept' THEN 'accepted' WHEN 'narrow' THEN 'narrowed' WHEN 'reject' THEN 'rejected' ELSE 'superseded' END ELSE status END, CASE WHEN r IS NULL THEN d.seq ELSE revision END
 FROM (SELECT run.record, run.status, run.revision, d.i, d.seq, d.op, CASE WHEN d.op = 'comment' THEN 'unknown_decision' WHEN want <> run.status THEN 'status_changed' WHEN seen <> run.revision THEN 'stale_revision' WHEN k % 23 = 5 THEN 'session_ended' END AS r FROM run JOIN d ON d.record = run.record AND d.i = run.i + 1) d),
 o AS (SELECT * FROM run WHERE i > 0)"""
ORACLES["dm64_decisions"] = f"WITH RECURSIVE {_LOG} SELECT record, seq, op, reason IS NULL AS accepted, reason, status, revision FROM o"
ORACLES["dm64_review_state"] = f"WITH RECURSIVE {_LOG} SELECT record, arg_max(status, seq) AS status, max(revision) AS revision, count(*) FILTER (reason IS NULL) AS n_accepted, count(*) FILTER (reason IN ('stale_revision', 'status_changed')) AS n_stale, count(*) FILTER (reason IS NOT NULL) AS n_rejected FROM o GROUP BY 1"
ORACLES["stream_review_log"] = ORACLES["dm64_review_state"]
ORACLES["dm64_outcomes"] = f"WITH RECURSIVE {_LOG} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n, count(DISTINCT record) AS candidates FROM o GROUP BY 1"
_OPS = """p0 AS (SELECT l_orderkey % 2000 AS filing_id, CASE WHEN l_linenumber <= 3 THEN 'promote' WHEN l_returnflag = 'A' THEN 'rollback' ELSE 'supersede' END AS op, CASE WHEN l_partkey % 19 = 0 THEN l_orderkey % 2000 ELSE (l_orderkey % 2000 + l_suppkey % 5 + 1) % 2000 END AS other,
 CAST(trunc(l_discount * 100) AS INTEGER) = 9 AS blocked, c_mktsegment AS full_name, o_orderpriority AS branch, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
 p AS (SELECT *, date_diff('day', DATE '1990-01-01', day) * 10000000 + filing_id * 5000 + row_number() OVER (PARTITION BY filing_id ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM p0),
 ch AS (SELECT filing_id AS f, seq AS s, op = 'promote' AS there FROM p WHERE op = 'rollback' OR op = 'promote' AND NOT blocked),
 q AS (SELECT p.*, coalesce(a.there, false) AS before FROM p ASOF LEFT JOIN ch a ON p.filing_id = a.f AND p.seq > a.s),
 r AS (SELECT q.*, coalesce(b.there, false) AS target FROM q ASOF LEFT JOIN ch b ON q.other = b.f AND q.seq > b.s),
 out_ AS (SELECT filing_id, CAST(seq AS BIGINT) AS seq, op, CASE WHEN op = 'supersede' THEN other END AS replacement_id, full_name, branch, CASE WHEN op = 'promote' AND blocked THEN 'promotion_criteria_failed' WHEN op = 'promote' AND before THEN 'already_promoted' WHEN op <> 'promote' AND NOT before THEN 'filing_not_found'
 WHEN op = 'supersede' AND other = filing_id THEN 'supersedes_itself' WHEN op = 'supersede' AND NOT target THEN 'replacement_not_found' END AS error FROM r)"""
ORACLES["dm35_operations"] = f"WITH {_OPS} SELECT filing_id, seq, op, replacement_id, error IS NULL AS accepted, error FROM out_"
ORACLES["dm35_persons"] = f"WITH {_OPS} SELECT full_name, branch, min(seq) AS person_seq, count(DISTINCT filing_id) AS n_filings FROM out_ WHERE error IS NULL AND op = 'promote' GROUP BY 1, 2"
ORACLES["dm35_filings"] = f"""WITH RECURSIVE {_OPS}, f0 AS (SELECT filing_id, arg_max(op, seq) FILTER (op <> 'supersede') AS last, max(seq) FILTER (op <> 'supersede') AS t, arg_max(replacement_id, seq) FILTER (op = 'supersede') AS rep, max(seq) FILTER (op = 'supersede') AS l, count(*) FILTER (op = 'promote') AS n_promotions, count(*) FILTER (op = 'rollback') AS n_rollbacks FROM out_ WHERE error IS NULL GROUP BY 1),
 f AS (SELECT filing_id, CASE WHEN last = 'promote' AND l > t THEN rep END AS superseded_by, last, n_promotions, n_rollbacks FROM f0),
 walk AS (SELECT filing_id, filing_id AS cur, 0 AS n FROM f UNION ALL SELECT walk.filing_id, f.superseded_by, n + 1 FROM walk JOIN f ON f.filing_id = walk.cur WHERE f.superseded_by IS NOT NULL AND n < 2100),
 h AS (SELECT filing_id, arg_max(cur, n) AS cur, max(n) AS n FROM walk GROUP BY 1)
 SELECT f.filing_id, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN last = 'promote' THEN 'promoted' ELSE 'rolled_back' END AS status, superseded_by, CASE WHEN h.n < 2100 THEN h.cur END AS head, n_promotions, n_rollbacks FROM f JOIN h USING (filing_id)"""
