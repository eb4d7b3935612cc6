"""Field precedence and provider chains on small records; span joins against all pairs."""

import random
from datetime import date, timedelta

from tallyglass.operators import precedence as P
from tallyglass.operators import temporal


def test_fields_by_trust_with_conflicts(spark):
    a = spark.createDataFrame([("k", None, "x"), ("k", "b", None), ("k", "a", None), (None, "z", "z"), ("m", "", None)], "id string, f string, g string")
    b = spark.createDataFrame([("k", "c", "x"), ("n", "d", None)], "id string, f string, g string").drop("g")
    got = {r.id: tuple(r)[1:] for r in P.merged_fields([("A", a), ("B", b)], "id", ["f", "g"]).collect()}
    assert got == {"k": ("a", "A", True, "x", "A", False, ["A", "B"]), "m": (None, None, False, None, None, False, ["A"]), "n": ("d", "B", False, None, None, False, ["B"])}


def test_chain_takes_the_first_provider_with_points(spark):
    points = lambda rows: spark.createDataFrame(rows, "symbol string, date date, value long")
    d = date(2020, 1, 1)
    asked = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("A",)], "symbol string")
    one, two = points([("A", d, 5), ("B", d, 0), ("B", d, None), ("X", d, 9)]), points([("A", d, 7), ("B", d, 100), ("B", d + timedelta(3), 135), ("B", d + timedelta(1), 100), ("C", None, 4)])
    coverage, series = P.provider_chain(asked, [("one", "covered", one), ("two", "cached", two)])
    assert {r.symbol: (r.status, r.provider, r.point_count, r.passed_over) for r in coverage.collect()} == {
        "A": ("covered", "one", 1, []), "B": ("cached", "two", 3, ["one"]), "C": ("error", None, 0, ["one", "two"]), "D": ("error", None, 0, ["one", "two"]),
    }
    assert sorted((r.symbol, r.value, r.provider) for r in series.collect()) == [("A", 5, "one"), ("B", 100, "two"), ("B", 100, "two"), ("B", 135, "two")]
    assert [tuple(r) for r in P.extreme_moves(series).collect()] == [("B", d + timedelta(3), d + timedelta(1), 3500)]


def test_span_join_equals_all_pairs(spark):
    rng, base = random.Random(3), date(2000, 1, 1)
    day = lambda: base + timedelta(rng.randrange(900))
    spans = [(k, rng.randrange(3), (s := day()), None if rng.random() < 0.2 else s + timedelta(rng.randrange(-5, 400))) for k in range(60)] + [(99, 0, None, None)]
    facts = [(k, rng.randrange(4), day()) for k in range(150)] + [(500, 0, None)]
    left, right = spark.createDataFrame(spans, "s long, key long, a date, b date"), spark.createDataFrame(facts, "f long, key long, d date")
    for n in (0, 45):
        want = sorted((s, f) for s, k, a, b in spans for f, j, d in facts if k == j and a and d and d >= a - timedelta(n) and (b is None or d <= b + timedelta(n)))
        assert sorted((r.s, r.f) for r in temporal.span_join(left, right, "key", "a", "b", "d", n).collect()) == want
