"""Streams in many small files equal their batch counterparts; the closing mark comes last and shows nowhere."""

import random
from datetime import datetime, timedelta

from tallyglass.streaming import sessions as S

EVENTS = "event_id long, user_id long, event_type string, ts timestamp"


def stream(spark, folder, rows, files=5):
    rows = sorted(rows, key=lambda r: r[3])
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def some_events(n, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(k, rng.randrange(4), rng.choice(["click", "purchase", "view"]), start + timedelta(minutes=rng.randrange(60 * 24 * 4))) for k in range(n)]


def test_sessions_across_triggers(spark, tmp_path):
    rows = some_events(120, 1)
    want = []
    for u in range(4):
        times = sorted(r[3] for r in rows if r[1] == u)
        for t in times:
            if want and want[-1][0] == u and t - want[-1][2] < timedelta(hours=1):
                want[-1] = (u, want[-1][1], t, want[-1][3] + 1)
            elif want and want[-1][0] == u and t - want[-1][2] == timedelta(hours=1):
                want[-1] = (u, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((u, t, t, 1))
    got = S.drained(spark, lambda e: S.sessions(e), stream(spark, str(tmp_path / "e"), rows), "s")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_interval_join_and_history_across_triggers(spark, tmp_path):
    rows = some_events(120, 2)
    want = sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] == "click" and b[2] == "purchase" and timedelta(0) <= b[3] - a[3] <= timedelta(hours=3))
    build = lambda e: S.follow_ups(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"))
    got = S.drained(spark, build, stream(spark, str(tmp_path / "e"), rows), "f")
    assert sorted(map(tuple, got.collect())) == want and want
    twice = rows + [(1000 + k, u, kind, t) for k, u, kind, t in rows[::3]]
    got = S.drained(spark, lambda e: S.run_history(e, ["user_id", "event_type", "ts"]), stream(spark, str(tmp_path / "r"), twice), "r")
    assert sorted(map(tuple, got.collect())) == sorted({(u, kind, t) for _, u, kind, t in rows})
