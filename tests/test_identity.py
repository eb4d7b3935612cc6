"""Matches by calendars: every filer against every role by hand, and how many rows a calendar has."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyglass.operators import identity
from tallyglass.plans import identity as P

DAY = date(1995, 1, 1)


def roles(spark, n=60):
    rows = [(k, k % 7, f"supplier#{k % 9:09d}" if k % 5 else f"other#{k % 9:09d}", k % 2, k % 3, DAY + timedelta(k * 37 % 400), DAY + timedelta(k * 37 % 400 + 150) if k % 4 else None) for k in range(n)]
    return rows, spark.createDataFrame(rows, "role_id long, official_id long, name string, state int, district long, a date, b date")


def test_member_match_is_what_all_pairs_give(spark):
    held, frame = roles(spark)
    people = [(k, DAY + timedelta(k * 13 % 900) if k % 17 else None, k % 3, k % 4, [None, "supplier", "other"][k % 3], f"{k % 11:09d}" if k % 6 else None) for k in range(150)]
    got = {r.filing_id: tuple(r)[1:] for r in P.member_match(spark.createDataFrame(people, "filing_id long, filed date, state int, row_district long, first string, last string"), frame).collect()}
    want, grace = {}, timedelta(P.GRACE_DAYS)
    for k, filed, state, district, first, last in people:
        best = {}
        for _, who, name, where, dist, a, b in held:
            if filed and state == where and filed >= a and (b is None or filed <= b + grace):
                score = 4 * (last in name.split("#")) + 3 * (first in name.split("#")) + 2 * (dist == district) + 2 + (b is None or filed <= b)
                best[who] = max(best.get(who, 0), score)
        top = max(best.values(), default=0)
        who = [w for w, s in best.items() if s == top]
        status = "unmatched" if top < 8 else "ambiguous" if len(who) > 1 else "matched"
        want[k] = (status, top, who[0] if status == "matched" else None, len(best))
    assert got == want and {w[0] for w in want.values()} == {"unmatched", "ambiguous", "matched"}


def test_roll_call_match_is_what_all_pairs_give(spark):
    held, frame = roles(spark, 40)
    people = [(k, k % 3, DAY + timedelta(k * 29 % 700 - 60), ["supplier", "s", "sam", "other"][k % 4], ["1", "000000003", "3", "x"][k // 4 % 4]) for k in range(96)]
    got = {r.person_id: tuple(r)[1:] for r in P.roll_call_match(spark.createDataFrame(people, "person_id long, state int, day date, first string, last string"), frame).collect()}
    want = {}
    for k, state, day, first, last in people:
        pool = [h for h in held if h[3] == state]
        pool = [h for h in pool if h[5] <= day and (h[6] is None or day <= h[6])] or pool
        best = {}
        for role, _, name, *_ in pool:
            if name.endswith(last):
                best[role] = 100 if name == f"{first}#{last}" else 90 if name.startswith(first) else 70 if name[0] == first[0] else 50
        top = max(best.values(), default=0)
        who = [w for w, s in best.items() if s == top]
        status = "unmatched" if not top else "ambiguous" if len(who) > 1 else "matched"
        want[k] = (status, top, who[0] if status == "matched" else None, len(best))
    assert got == want and {w[0] for w in want.values()} == {"unmatched", "ambiguous", "matched"}
    assert {w[1] for w in want.values()} == {0, 50, 70, 90, 100}


def test_a_calendar_has_two_rows_a_span_at_most(spark):
    _, frame = roles(spark, 500)
    days = identity.calendar(frame.withColumn("until", F.coalesce("b", "a")), "state", "a", "until", "role_id")
    assert days.count() <= 1000
    assert {r.n for r in days.groupBy("state").agg(F.min_by("n", -F.datediff("date", F.lit(DAY))).alias("n")).collect()} == {0}
