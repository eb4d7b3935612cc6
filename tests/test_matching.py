"""Pattern search and keeping the first against plain loops."""

import random

from tallyglass.operators import matching as M


def test_all_first_and_longest(spark):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice("abAB ß") for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(900, None), (901, ""), (900, "ab")]
    words = sorted({"".join(rng.choice("abß ") for _ in range(rng.randint(1, 4))) for _ in range(40)}) + ["AB", ""]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "id long, text string, pattern string").repartition(3)
    patterns = spark.createDataFrame([(k, (k * 37) % 101, w) for k, w in enumerate(words)] + [(99, 5, None)], "pattern_id long, position long, pattern string")
    count = lambda t, w: sum(t.startswith(w, i) for i in range(len(t)))
    want = sorted((i, k, (k * 37) % 101, count(t.lower(), w.lower()), t.lower().find(w.lower())) for i, t in texts if t for k, w in enumerate(words) if w and w.lower() in t.lower())
    for most in (8, M.SHARD_BYTES):
        assert sorted(map(tuple, M.find(docs, patterns, "id", "text", most=most).collect())) == want
    first = {}
    for i, k, p, _, _ in want:
        first[i] = min(first.get(i, (999, 0)), (p, k))
    assert {r.id: r.pattern_id for r in M.first_match(docs, patterns, "id", "text").collect()} == {i: k for i, (_, k) in first.items()}
    pats = spark.createDataFrame([(1, 1, "new"), (2, 2, "new york"), (3, 3, "york"), (4, 4, "ew")], "pattern_id long, position long, pattern string")
    got = M.find(spark.createDataFrame([(1, "New York, new york and a new yorker york")], "id long, text string"), pats, "id", "text", longest=True)
    assert sorted((r.pattern_id, r.n, r["at"]) for r in got.collect()) == [(2, 3, 0), (3, 1, 36)]
    assert M.find(docs.filter("false"), patterns, "id", "text").collect() == [] == M.find(docs, patterns.filter("false"), "id", "text").collect()


def test_keep_first_as_a_loop_does(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(40)]), rng.choice([None, *range(40)])) for k in range(150)] + [(200 + k, 1000 + k // 2, 2000 + (k + 1) // 2) for k in range(12)]
    frame = spark.createDataFrame(rows, "at long, a long, b long").repartition(4)
    want, seen = [], (set(), set())
    for at, *keys in rows:
        if not any(v in s for v, s in zip(keys, seen, strict=True)):
            want.append(at)
            for v, s in zip(keys, seen, strict=True):
                if v is not None:
                    s.add(v)
    assert sorted(r["at"] for r in M.keep_first(frame, "at", ["a", "b"]).collect()) == want
    assert M.keep_first(frame.filter("false"), "at", ["a", "b"]).collect() == []
