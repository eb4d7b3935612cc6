"""Role resolution, the actor registry and priorities on small records with planted conflicts."""

from datetime import date

from pyspark.sql import functions as F

from tallyglass.operators import involvement as I

ROLE = "external_role_id string, external_person_id string, full_name string, source_url string, bioguide_id string, party string, state string, service_start date, service_end date, congress int, chamber string"


def roles(spark):
    d = date
    return spark.createDataFrame(
        [
            ("r1", "p1", "Ann Lee", "u1", "B1", "D", "TX", d(2001, 1, 3), d(2003, 1, 3), 107, "Senate"),
            ("r0", "p1", "Ann Lee", "u0", "B1", "D", "TX", d(1999, 1, 3), d(2001, 1, 3), 107, "Senate"),
            ("r2", "p2", "Sen. Bob Lee Jr.", "u2", None, "R", "TX", d(2001, 1, 3), None, 107, "Senate"),
            ("r3", "p3", "Carla Éstes", "u3", "B3", "R", "CA", d(2001, 1, 3), None, 107, "Senate"),
            ("r4", "p4", "Dan Estes", "u4", "B4", "R", "CA", d(2001, 1, 3), d(2002, 1, 1), 107, "Senate"),
        ],
        ROLE,
    )


def test_role_on_prefers_those_in_office_then_the_smaller_id(spark):
    rows = spark.createDataFrame([(1, "B1", date(2002, 1, 1)), (2, "B1", date(2001, 1, 3)), (3, "B1", date(2010, 1, 1)), (4, "B1", None), (5, "B9", date(2002, 1, 1)), (6, None, date(2002, 1, 1))], "k int, bioguide_id string, at date")
    rows = rows.withColumns({"congress": F.lit(107), "chamber": F.lit("Senate")})
    got = {r.k: r.role and r.role.external_role_id for r in I.role_on(rows, roles(spark), "at", ["bioguide_id", "congress", "chamber"]).collect()}
    assert got == {1: "r1", 2: "r1", 3: "r0", 4: "r0", 5: None, 6: None}


def test_role_by_name_scores_and_refuses_ties(spark):
    cases = [
        (1, "Ann", "Lee", "TX", "r1"), (2, "B.", "Lee", "TX", "r2"), (3, "Zed", "Lee", "TX", None), (4, "Carla", "Estes", "CA", "r3"), (5, "Dan", "Estes", "CA", "r3"),
        (6, "", "Lee", "TX", None), (7, "Ann", None, "TX", None), (8, "Ann", "Lee", "WA", None), (9, "An", "ee", "TX", "r1"), (10, "Ann", "e", "TX", "r1"),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "k int, first string, last string, state string").withColumns({"congress": F.lit(107), "chamber": F.lit("Senate"), "at": F.lit(date(2002, 6, 1))})
    got = {r.k: r.role and r.role.external_role_id for r in I.role_by_name(rows, roles(spark), "at", ["congress", "chamber", "state"], "first", "last").collect()}
    assert got == {c[0]: c[4] for c in cases}


def test_roles_that_share_a_name_and_span_are_one_row_for_it(spark):
    d = date(2001, 1, 3)
    many = spark.createDataFrame([(f"r{k:03d}", f"p{k}", f"{'Ann' if k % 2 else 'Bob'} Lee", "u", None, "D", "TX", d, None if k < 200 else date(2002, 1, 1), 107, "Senate") for k in range(400)] + [("one", "p", "Al Lee", "u", None, "D", "TX", date(2002, 1, 1), None, 107, "Senate")], ROLE)
    keys = ["congress", "chamber", "state"]
    asked = spark.createDataFrame([(107, "Senate", "TX", "ann", "lee"), (107, "Senate", "TX", "al", "lee")], "congress int, chamber string, state string, _first string, _last string")
    spans = I._best_by_span(asked, many.withColumn("_name", I.plain_name(F.col("full_name"))), keys).collect()
    assert len(spans) == 6 and {r.top.n for r in spans if r._first == "ann"} == {100, 1}
    rows = asked.select(*keys, F.col("_first").alias("first"), F.col("_last").alias("last")).crossJoin(spark.createDataFrame([(date(2001, 6, 1),), (date(2002, 6, 1),)], "at date"))
    got = {(r.first, r.at.year): r.role and r.role.external_role_id for r in I.role_by_name(rows, many, "at", keys, "first", "last").collect()}
    assert got == {("ann", 2001): None, ("ann", 2002): None, ("al", 2001): None, ("al", 2002): "one"}


def test_actors_keep_both_sides_of_a_conflict(spark):
    shape = "actor_id string, official_actor_id string, external_person_id string, external_role_id string, bioguide_id string, resolution_status string, role_source_url string, full_name string, official_record_name string, party string, state string"
    rows = [("a", "c:1", "p1", "r", "B", "m", "u1", "Ann Lee", n, p, "TX") for n, p in (("A. Lee", "D"), ("Ann Lee", "D"))] + [("a", "c:1", "p2", "r", "B", "m", "u1", "Ann Lee", "Lee", "I", None), ("b", "x", None, None, None, "u", None, None, None, None, None)]
    seen = spark.createDataFrame(rows, shape)
    got = {r.actor_id: r for r in I.actors(seen).collect()}
    assert (got["a"].external_person_id, got["a"].conflicting_fields, got["a"].parties, got["a"].official_record_names) == ("p1", ["external_person_id"], ["D", "I"], ["A. Lee", "Ann Lee", "Lee"])
    assert (got["b"].external_person_id, got["b"].conflicting_fields, got["b"].full_names) == (None, [], [])
    assert sorted(map(tuple, I.actor_conflicts(seen).collect())) == [("a", "external_person_id", "p1", 2, True), ("a", "external_person_id", "p2", 1, False)]
    assert I.actors(seen.filter("false")).collect() == [] == I.actor_conflicts(seen.filter("false")).collect()


def test_priorities(spark):
    rows = spark.createDataFrame(
        [(1, "sponsor", ["a", "b", "a"], I.MATCHED, None), (2, "sponsor", ["a", "b"], None, None), (3, "recorded_vote", [], I.MATCHED, " Absent"), (4, "recorded_vote", None, "no", "Yea"), (5, "odd", ["a"], None, None), (6, "agency_jurisdiction_context", [], None, None)],
        "k int, relationship_type string, source_ids array<string>, resolution_status string, vote_cast string",
    )
    got = {r.k: (r.review_priority_score, r.review_priority_band, len(r.review_priority_reasons), r.evidence_source_count) for r in I.with_priority(rows).collect()}
    assert got == {1: (98, "high", 3, 2), 2: (100, "high", 4, 2), 3: (60, "medium", 4, 0), 4: (75, "medium", 4, 0), 5: (20, "low", 1, 1), 6: (15, "low", 2, 0)}


def test_context_edges_and_votes(spark):
    ev = spark.createDataFrame([("e1", "court_decision", date(2001, 5, 1), ["Tax ", "trade", "none", "treasury"], "Court  of X!", "No. 1", ["s"]), ("e2", "court_decision", None, None, "Court", None, ["s"]), ("e3", "executive_order", None, [], None, None, []), ("e4", "executive_order", date(2001, 1, 20), [], None, None, [])], "event_id string, event_type string, date date, jurisdiction_scope array<string>, court string, docket_number string, source_ids array<string>")
    assert sorted(r.institution_id for r in I.agency_edges(ev).collect()) == ["agency:department-of-commerce", "agency:department-of-the-treasury"]
    assert [r.id for r in I.court_edges(ev).collect()] == ["e1:court-docket-institutional-link:court-of-x"]
    heads = spark.createDataFrame([("r1", "p1", "One", date(1997, 1, 20), date(2001, 1, 20)), ("r2", "p2", "Two", date(2001, 1, 20), None)], "external_role_id string, external_person_id string, full_name string, service_start date, service_end date")
    assert [(r.event_id, r.institution_id) for r in I.presidential_edges(ev, heads).collect()] == [("e4", "p2")]
    assert I.presidential_edges(ev, heads.filter("false")).collect() == []
    votes = spark.createDataFrame([("House", 1, 1, 1, u, "t", "x", "2001", e, "2001") for u, e in (("u1", "e1"), (None, "e2"), ("u2", "e1"))] + [("House", 1, 1, 2, None, None, None, None, "e1", None)], "chamber string, congress int, session int, roll_number int, url string, action_text string, action_type string, action_date string, event_id string, recorded_at string")
    got = {r.roll_number: (r.url, r.url_conflict, r.event_ids, r.action_texts) for r in I.collapse_votes(votes).collect()}
    assert got == {1: ("u1", True, ["e1", "e2"], ["t"]), 2: (None, False, ["e1"], [])}


def test_endings_of_names_are_sent_to_nobody(spark):
    """rows that an explode makes look few to the planner; only those as long as a name asked for are made."""
    names = spark.range(3).select(F.lit(107).alias("congress"), F.lit("Senate").alias("chamber"), F.lit("TX").alias("state"), F.concat(F.lit("ann lee"), F.col("id").cast("string")).alias("full_name"), *[F.lit(None).cast(t).alias(c) for c, t in (("external_role_id", "string"), ("external_person_id", "string"), ("source_url", "string"), ("bioguide_id", "string"), ("party", "string"), ("service_start", "date"), ("service_end", "date"))])
    plain = names.withColumn("_name", I.plain_name(F.col("full_name")))
    keys = ["congress", "chamber", "state"]
    asked = spark.range(2).select(*[F.lit(v).alias(c) for c, v in zip(keys, (107, "Senate", "TX"), strict=True)], F.lit("ann").alias("_first"), F.concat(F.lit("lee"), F.col("id").cast("string")).alias("_last"))
    spans = I._best_by_span(asked, plain, keys)
    made = spans._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in made and "BroadcastHashJoin" not in made
    assert sorted((r._last, r.top.score, r.top.n) for r in spans.collect()) == [("lee0", 100, 1), ("lee1", 100, 1)]


def test_index_and_coverage_read_observations_once(spark):
    """F1, F2."""
    from tallyglass import registry

    for name in ("dm46_coverage", "j23_person_event_index"):
        made = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in made and made.count("explode(array(") <= 1


def test_kept_value_is_that_of_actors(spark):
    rows = [("a", v) for v in ("p2", "p1", "p2", "p1", None)] + [("b", None), ("b", None), ("b", "p9"), ("c", None), ("c", "p3"), ("d", "p4")]
    seen = spark.createDataFrame(rows, "actor_id string, external_person_id string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("official_actor_id", "external_role_id", "bioguide_id", "resolution_status", "role_source_url", "full_name", "official_record_name", "party", "state")])
    want = {r.actor_id: r.external_person_id for r in I.actors(seen).collect()}
    assert {r.actor_id: r.external_person_id for r in I.kept_value(seen, "external_person_id").collect()} == want == {"a": "p1", "b": None, "c": "p3", "d": "p4"}
