"""Review decisions and promotions from append-only logs: nothing is updated in place, state is what a replay gives.

A decision names what its reviewer saw: the candidate's status and its revision, which is the number of the last decision
that was accepted. It counts only if both still hold (optimistic concurrency); otherwise it is logged as rejected and
changes nothing. The rule (`decide`) is one function with two drivers: `replay` over a finished log and `stream`, a
stateful operator over a growing one, whose state per candidate is a status and two numbers. A candidate's decisions pass
through as a sequence in order of `seq` and are never gathered.

Bulk decisions are all or none. Whether one is valid depends on earlier ones only, so the verdicts are found as a fixpoint:
the log is replayed with the verdicts of the round before until none changes, in at most as many rounds as bulk decisions
hang on each other.

Promotions, rollbacks and supersessions of filings need no sequence: after a promotion a filing exists, after a rollback it
doesn't, so each state is that of the last operation before it, by windows and an as-of join; heads of supersession chains
are found by doubling.

Logs have unique seq; a null record or operation is rejected as unknown; an empty log gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import cut, staged

# The status that a decision gives.
STATUS = {"accept": "accepted", "narrow": "narrowed", "reject": "rejected", "supersede": "superseded"}
OPEN = "candidate"
#: What a decision log holds; batch_id names a bulk decision, session_error what is wrong with the reviewer's session.
DECISION = ["record", "seq", "op", "expected_status", "expected_revision", "batch_id", "session_error"]
OUTCOME = "record long, seq long, op string, batch_id long, own_reason string, reason string, accepted boolean, status string, revision long"


def decide(status: str, revision: int, op: str | None, seq: int, expected_status: str | None, expected_revision: int | None, session_error: str | None) -> str | None:
    """Why a decision doesn't count, or None if it does."""
    if op not in STATUS:
        return "unknown_decision"
    if expected_status is not None and expected_status != status:
        return "status_changed"
    if expected_revision is not None and expected_revision != revision:
        return "stale_revision"
    if session_error is not None:
        return session_error
    return "out_of_order" if seq <= revision else None


def with_session_errors(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds session_error: of a decision that names a session which isn't there, is another reviewer's or has ended."""
    held = sessions.select(F.col("session_id"), F.col("reviewer").alias("_owner"), F.col("ended_seq").alias("_ended"), F.lit(True).alias("_there"))
    rows = log.join(held, "session_id", "left")
    error = (
        F.when(F.col("session_id").isNull(), None)
        .when(F.col("_there").isNull(), "session_not_found")
        .when(~F.col("_owner").eqNullSafe(F.col("reviewer")), "session_of_another_reviewer")
        .when(F.col("_ended") <= F.col("seq"), "session_ended")
    )
    return rows.withColumn("session_error", error).drop("_owner", "_ended", "_there")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of decisions that come record by record, in order."""
    record, status, revision = None, OPEN, 0
    for batch in batches:
        out = []
        for r, seq, op, want, at, bulk, session, refused in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != record:
                record, status, revision = r, OPEN, 0
            own = "unknown_candidate" if r is None else decide(status, revision, op, seq, want, at, session)
            why = own or ("bulk_changed" if refused else None)
            if why is None:
                status, revision = STATUS[op], seq
            out.append((r, seq, op, bulk, own, why, why is None, status, revision))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], [x.split()[0] for x in OUTCOME.split(", ")])


def _replay(log: DataFrame, refused: Column) -> DataFrame:
    rows = log.select("record", "seq", "op", "expected_status", "expected_revision", "batch_id", "session_error", refused.alias("refused"))
    return rows.repartition("record").sortWithinPartitions("record", "seq").mapInArrow(_fold, OUTCOME)


def replay(log: DataFrame) -> DataFrame:
    """OUTCOME of each decision; bulk decisions (of equal batch_id) count all or not at all."""
    bulk = log.filter("batch_id is not null").select("batch_id").limit(1).count()
    if not bulk:
        return _replay(log, F.lit(False))
    # Each round reads the log again, so it is staged, without what leads to it.
    log = staged(log.select(*DECISION))
    refused, n = None, -1
    while True:
        rows = log.withColumn("_no", F.lit(False)) if refused is None else log.join(refused.withColumn("_no", F.lit(True)), "batch_id", "left")
        out = _replay(rows, F.coalesce("_no", F.lit(False)))
        found = cut(out.filter("batch_id is not null and own_reason is not null").select("batch_id").distinct())
        same = refused is not None and found.count() == n and found.join(refused, "batch_id", "left_anti").limit(1).count() == 0
        if same or (refused is None and found.count() == 0):
            return out
        refused, n = found, found.count()


def state(outcomes: DataFrame) -> DataFrame:
    """(record, status, revision, n_accepted, n_stale, n_rejected) of each candidate that the log names."""
    last = F.max_by(F.struct("status", "revision"), "seq").alias("s")
    rows = outcomes.filter("record is not null").groupBy("record").agg(last, F.count_if("accepted").alias("n_accepted"), F.count_if(F.col("reason").isin("stale_revision", "status_changed")).alias("n_stale"), F.count_if(~F.col("accepted")).alias("n_rejected"))
    return rows.select("record", "s.status", "s.revision", "n_accepted", "n_stale", "n_rejected")


class Reviews(StatefulProcessor):
    """Keeps each candidate's status and revision; a trigger's decisions are applied by seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("review", "status string, revision long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, revision = self.held.get() if self.held.exists() else (OPEN, 0)
        some = pd.concat(list(rows)).sort_values("seq")
        out = []
        none = lambda v: None if pd.isna(v) else v
        for seq, op, want, at, session in zip(some["seq"], some["op"], some["expected_status"], some["expected_revision"], some["session_error"], strict=True):
            at = none(at)
            why = decide(status, revision, none(op), int(seq), none(want), None if at is None else int(at), none(session))
            if why is None:
                status, revision = STATUS[op], int(seq)
            out.append((key[0], int(seq), none(op), why, why is None, status, revision))
        self.held.update((status, revision))
        yield pd.DataFrame(out, columns=["record", "seq", "op", "reason", "accepted", "status", "revision"])

    def close(self) -> None:
        pass


def stream(log: DataFrame) -> DataFrame:
    """Outcomes of a stream of single decisions, appended as they come.

    The operator needs the RocksDB state store, which is set in the session here and must still be set when the query starts.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.filter("record is not null").select("record", "seq", "op", "expected_status", "expected_revision", "session_error")
    return rows.groupBy("record").transformWithStateInPandas(Reviews(), "record long, seq long, op string, reason string, accepted boolean, status string, revision long", "Append", "None")


# -- promotions


def existence(log: DataFrame) -> DataFrame:
    """log plus `before` (does the filing exist when the operation comes) and `error` of promotions and rollbacks.

    log has filing_id, seq, op (promote, rollback, supersede), replacement_id, blockers (null or empty: none).
    """
    blocked = F.coalesce(F.col("blockers") != "", F.lit(False))
    toggles = F.when((F.col("op") == "promote") & ~blocked, True).when(F.col("op") == "rollback", False)
    earlier = Window.partitionBy("filing_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(toggles, ignorenulls=True).over(earlier), F.lit(False))
    rows = log.withColumn("before", before)
    error = (
        F.when((F.col("op") == "promote") & blocked, "promotion_criteria_failed")
        .when((F.col("op") == "promote") & F.col("before"), "already_promoted")
        .when(F.col("op").isin("rollback", "supersede") & ~F.col("before"), "filing_not_found")
        .when((F.col("op") == "supersede") & F.col("filing_id").eqNullSafe(F.col("replacement_id")), "supersedes_itself")
        .when(~F.coalesce(F.col("op").isin("promote", "rollback", "supersede"), F.lit(False)), "unknown_operation")
    )
    return rows.withColumn("error", error)


def promotions(log: DataFrame) -> DataFrame:
    """(filing_id, seq, op, replacement_id, accepted, error) of each operation.

    Whether a replacement exists is its last change before the supersession: both are sorted together by (filing, seq).
    """
    rows = existence(log)
    blocked = F.coalesce(F.col("blockers") != "", F.lit(False))
    changes = rows.filter(((F.col("op") == "promote") & ~blocked) | (F.col("op") == "rollback")).select(F.col("filing_id").alias("f"), "seq", (F.col("op") == "promote").alias("there"), F.lit(None).cast("long").alias("asks"))
    asks = rows.filter("op = 'supersede' and error is null").select(F.col("replacement_id").alias("f"), "seq", F.lit(None).cast("boolean").alias("there"), F.col("filing_id").alias("asks"))
    seen = F.last("there", ignorenulls=True).over(Window.partitionBy("f").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    lost = changes.unionByName(asks).withColumn("seen", F.coalesce(seen, F.lit(False))).filter("asks is not null and not seen").select("seq", F.lit(True).alias("lost"))
    out = rows.join(lost, "seq", "left").withColumn("error", F.coalesce("error", F.when(F.col("lost"), "replacement_not_found")))
    return out.select("filing_id", "seq", "op", "replacement_id", F.col("error").isNull().alias("accepted"), "error")


def filings(outcomes: DataFrame) -> DataFrame:
    """(filing_id, status, superseded_by, head, n_promotions, n_rollbacks): each filing that was ever promoted.

    A rollback takes a filing's supersession with it. `head` is the filing at the end of its chain, itself if it isn't
    superseded, null if the chain leads back to itself; a filing that was rolled back ends the chains that lead to it.
    """
    good = outcomes.filter("accepted")
    toggled = F.max(F.when(F.col("op").isin("promote", "rollback"), F.struct("seq", "op")))
    linked = F.max(F.when(F.col("op") == "supersede", F.struct("seq", "replacement_id")))
    rows = good.groupBy("filing_id").agg(toggled.alias("t"), linked.alias("l"), F.count_if(F.col("op") == "promote").alias("n_promotions"), F.count_if(F.col("op") == "rollback").alias("n_rollbacks"))
    live = F.col("t.op") == "promote"
    rows = rows.select("filing_id", F.when(live, "promoted").otherwise("rolled_back").alias("status"), F.when(live & (F.col("l.seq") > F.col("t.seq")), F.col("l.replacement_id")).alias("superseded_by"), "n_promotions", "n_rollbacks")
    rows = cut(rows.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status"))))
    return rows.join(heads(rows), "filing_id")


def heads(rows: DataFrame) -> DataFrame:
    """(filing_id, head) of (filing_id, superseded_by): pointers doubled until every one has come to an end or is in a circle."""
    at = cut(rows.select("filing_id", F.coalesce("superseded_by", "filing_id").alias("head"), F.col("superseded_by").isNull().alias("done")))
    n, open_ = at.count(), at.filter("not done").count()
    steps = 1
    while open_ and steps < 2 * n:
        to = at.select(F.col("filing_id").alias("head"), F.col("head").alias("_next"), F.col("done").alias("_done"))
        at = cut(at.join(to, "head", "left").select("filing_id", F.coalesce("_next", "head").alias("head"), F.coalesce("_done", F.lit(True)).alias("done")))
        open_, steps = at.filter("not done").count(), 2 * steps
    return at.select("filing_id", F.when(F.col("done"), F.col("head")).alias("head"))


def persons(outcomes: DataFrame, log: DataFrame) -> DataFrame:
    """(full_name, branch, person_seq, n_filings): people by name and branch, made by the first promotion that named them."""
    named = outcomes.filter("accepted and op = 'promote'").join(log.select("seq", "full_name", "branch"), "seq")
    return named.groupBy("full_name", "branch").agg(F.min("seq").alias("person_seq"), F.countDistinct("filing_id").alias("n_filings"))
