"""Review and promotion logs against plain sequential versions; the stream in many small files against the replay."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyglass.streaming import ledger as L

LOG = "record long, seq long, op string, expected_status string, expected_revision long, batch_id long, session_error string"


def random_log(n, records, seed, bulk=0.0):
    rng, log, latest = random.Random(seed), [], {}
    bulks = {}
    for seq in range(1, n + 1):
        r = rng.randrange(records) if rng.random() > 0.3 else 0
        batch = None
        if rng.random() < bulk:
            batch = seq // 6
            if (batch, r) in bulks:
                batch = None
            bulks[batch, r] = True
        op = rng.choice([*L.STATUS, *L.STATUS, "note", None])
        log.append((r, seq, op, rng.choice([None, None, "accepted", "candidate"]), rng.choice([None, latest.get(r, 0), latest.get(r, 0), 0]), batch, rng.choice([None] * 9 + ["session_ended"])))
        if rng.random() < 0.6:
            latest[r] = seq
    return log


def sequential(log):
    """One pass in order of seq; a bulk decision is judged by what its targets see, each at its own place."""
    verdict = {}
    while True:
        held, out, bad = {}, {}, {}
        for r, seq, op, want, at, batch, session in sorted(log, key=lambda x: x[1]):
            status, revision = held.get(r, ("candidate", 0))
            own = L.decide(status, revision, op, seq, want, at, session)
            if batch is not None and own:
                bad[batch] = True
            if own is None and not verdict.get(batch):
                held[r] = (status, revision) = (L.STATUS[op], seq)
                out[seq] = (True, None, status, revision)
            else:
                out[seq] = (False, own or "bulk_changed", status, revision)
        if bad == verdict:
            return out
        verdict = bad


def outcomes(frame):
    return {r.seq: (r.accepted, r.reason, r.status, r.revision) for r in frame.collect()}


def test_replay_equals_a_sequential_pass(spark):
    log = random_log(600, 12, 1)
    got = L.replay(spark.createDataFrame(log, LOG).repartition(5))
    assert outcomes(got) == sequential(log)
    reasons = Counter(x[1] for x in outcomes(got).values())
    assert {"stale_revision", "status_changed", "unknown_decision", "session_ended", None} <= set(reasons)
    assert L.replay(spark.createDataFrame([], LOG)).collect() == []


def test_bulk_decisions_count_all_or_none(spark):
    log = random_log(400, 40, 2, bulk=0.5)
    got = outcomes(L.replay(spark.createDataFrame(log, LOG)))
    assert got == sequential(log)
    by = {}
    for r in log:
        if r[5] is not None:
            by.setdefault(r[5], set()).add(got[r[1]][0])
    assert all(len(v) == 1 for v in by.values()) and {True, False} == {x for v in by.values() for x in v}


def test_a_refused_bulk_decision_makes_a_later_one_valid(spark):
    log = [(1, 1, "accept", None, 0, None, None), (1, 2, "reject", None, 0, 7, None), (2, 3, "reject", None, 0, 7, None), (2, 4, "narrow", None, 0, 8, None), (3, 5, "narrow", None, 0, 8, None), (3, 6, "accept", None, 5, 9, None), (2, 7, "accept", None, 3, 10, None)]
    got = outcomes(L.replay(spark.createDataFrame(log, LOG)))
    assert [got[s][0] for s in range(1, 8)] == [True, False, False, True, True, True, False]
    assert got[3][1] == "bulk_changed" and got[2][1] == "stale_revision" == got[7][1]


def test_the_stream_in_small_files_gives_the_replays_state(spark, tmp_path):
    log = random_log(300, 9, 3)
    for k in range(0, 300, 75):
        spark.createDataFrame(log[k : k + 75], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    rows = L.stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")))
    q = rows.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 4
    got = spark.read.parquet(str(tmp_path / "out"))
    want = L.replay(spark.createDataFrame(log, LOG))
    assert outcomes(got) == outcomes(want)
    assert sorted(map(tuple, L.state(got).collect())) == sorted(map(tuple, L.state(want).collect()))


def test_sessions(spark):
    log = spark.createDataFrame([(1, "s", "ann"), (2, None, "ann"), (3, "t", "ann"), (4, "u", "ann"), (9, "s", "ann")], "seq long, session_id string, reviewer string")
    held = spark.createDataFrame([("s", "ann", 5), ("u", "bob", None)], "session_id string, reviewer string, ended_seq long")
    assert {r.seq: r.session_error for r in L.with_session_errors(log, held).collect()} == {1: None, 2: None, 3: "session_not_found", 4: "session_of_another_reviewer", 9: "session_ended"}


def test_promotions_equal_a_sequential_pass(spark):
    rng = random.Random(4)
    log = []
    for seq in range(1, 500):
        op = rng.choice(["promote", "promote", "rollback", "supersede", "supersede", "burn"])
        log.append((rng.randrange(15), seq, op, rng.randrange(16) if op == "supersede" else None, rng.choice([None, "", "hash"]), rng.choice("ab"), "x"))
    there, by, want, people = set(), {}, {}, {}
    for f, seq, op, to, blockers, name, branch in log:
        if op == "promote":
            error = "promotion_criteria_failed" if blockers else "already_promoted" if f in there else None
            if not error:
                there.add(f)
                people.setdefault((name, branch), seq)
        elif op == "rollback":
            error = None if f in there else "filing_not_found"
            there.discard(f)
            by.pop(f, None)
        elif op == "supersede":
            error = "filing_not_found" if f not in there else "supersedes_itself" if f == to else None if to in there else "replacement_not_found"
            if not error:
                by[f] = to
        else:
            error = "unknown_operation"
        want[seq] = error
    frame = spark.createDataFrame(log, "filing_id long, seq long, op string, replacement_id long, blockers string, full_name string, branch string")
    out = L.promotions(frame)
    assert {r.seq: r.error for r in out.collect()} == want
    got = {r.filing_id: r for r in L.filings(out).collect()}
    assert {f for f, r in got.items() if r.status != "rolled_back"} == there
    assert {f: r.superseded_by for f, r in got.items() if r.superseded_by is not None} == by
    for f, r in got.items():
        at, seen = f, set()
        while at in by and at not in seen:
            seen.add(at)
            at = by[at]
        assert r.head == (None if at in seen else at)
    assert {(r.full_name, r.branch): r.person_seq for r in L.persons(out, frame).collect()} == people


def test_heads_of_chains_and_circles(spark):
    rows = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(40, None), (50, 51), (51, 52), (52, 50), (60, 50), (70, 99)], "filing_id long, superseded_by long")
    got = {r.filing_id: r.head for r in L.heads(rows).collect()}
    assert got == {**dict.fromkeys(range(41), 40), 50: None, 51: None, 52: None, 60: None, 70: 99}
    assert L.heads(rows.filter(F.lit(False))).collect() == []
