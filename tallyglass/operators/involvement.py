"""A graph of official involvement in events: typed edges, an actor registry with its conflicts, review priorities.

Records of sponsors, cosponsors and votes name a person in their own way. Each is resolved to the role that the person held
on the day (`role_on` by a member id, `role_by_name` by state and name), and becomes an edge to an actor. Presidents,
agencies and courts give edges that are context only. Edges of all kinds have the columns EDGE and are put together by
`edges`; observations of actors are folded to one row per actor by `actors`, and what they disagree about is kept by
`actor_conflicts`, a row for each value, instead of stopping.

Role lists are gathered per member and congress, or per congress, state and name ending: a person's few terms. All else is
joins and partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

# Agencies that a jurisdiction term routes to.
CROSSWALK = {
    "agriculture": ["department-of-agriculture"],
    "appropriations": ["office-of-management-and-budget"],
    "armed services": ["department-of-defense"],
    "banking": ["department-of-the-treasury"],
    "budget": ["office-of-management-and-budget"],
    "commerce": ["department-of-commerce"],
    "communications": ["department-of-commerce", "federal-communications-commission"],
    "cybersecurity": ["department-of-homeland-security"],
    "defense": ["department-of-defense"],
    "energy": ["department-of-energy"],
    "environment": ["environmental-protection-agency"],
    "epa": ["environmental-protection-agency"],
    "financial markets": ["department-of-the-treasury", "securities-and-exchange-commission"],
    "food": ["department-of-agriculture", "department-of-health-and-human-services"],
    "health": ["department-of-health-and-human-services"],
    "hhs": ["department-of-health-and-human-services"],
    "infrastructure": ["department-of-transportation"],
    "interior": ["department-of-the-interior"],
    "manufacturing": ["department-of-commerce"],
    "medicaid": ["department-of-health-and-human-services"],
    "medicare": ["department-of-health-and-human-services"],
    "national security": ["department-of-defense", "department-of-homeland-security"],
    "securities": ["securities-and-exchange-commission"],
    "supply chain": ["department-of-commerce"],
    "tax": ["department-of-the-treasury"],
    "technology": ["department-of-commerce"],
    "trade": ["department-of-commerce"],
    "transportation": ["department-of-transportation"],
    "treasury": ["department-of-the-treasury"],
}
# Base scores of the review priority, words that names are compared without, answers that are no position.
BASE_SCORES = {
    "sponsor": 95, "cosponsor": 85, "recorded_vote": 80, "presidential_executive_order_context": 55,
    "presidential_enactment_context": 50, "court_docket_institutional_link": 40, "agency_jurisdiction_context": 25,
}
DIRECT = ["sponsor", "cosponsor", "recorded_vote"]
TITLES = ["rep", "representative", "sen", "senator", "jr", "sr", "ii", "iii", "iv"]
NO_POSITION = ["not voting", "absent"]
MATCHED, UNMATCHED = "matched_public_official_role", "official_actor_unmatched_to_role_dataset"

ROLE = ["external_role_id", "external_person_id", "full_name", "source_url"]
EDGE = ["id", "event_id", "relationship_type", "relationship_class", "relationship_date", "actor_id", "institution_id", "roll_call_id", "vote_cast", "withdrawn_date", "source_ids", "resolution_status"]
COMPARED = ["official_actor_id", "external_person_id", "external_role_id", "bioguide_id", "resolution_status", "role_source_url"]


def active(start: Column, end: Column, at: Column) -> Column:
    """In office from its first day to before its last; open ends and unknown days count as in office."""
    return F.coalesce((start.isNull() | (start <= at)) & (end.isNull() | (at < end)), F.lit(True))


def plain_name(name: Column) -> Column:
    """Folded words of a name without titles and generation suffixes."""
    return F.array_join(F.filter(F.split(fold(F.coalesce(name, F.lit(""))), " "), lambda t: ~t.isin(TITLES)), " ")


def record_id(*parts: Column) -> Column:
    """The parts that aren't null, joined by colons and made safe."""
    joined = F.concat_ws(":", *[F.lower(F.trim(p.cast("string"))) for p in parts])
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9:._-]+", "-"), "^-+|-+$", "")


def _held(roles: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct("external_role_id", "external_person_id", "full_name", "source_url", "bioguide_id", "party", "state", "service_start", "service_end")
    return roles.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_held"))


def _in_office(at: str) -> Column:
    """The roles held on the day, or all of them where none is."""
    now = F.filter("_held", lambda r: active(r.service_start, r.service_end, F.col(at)))
    return F.when(F.size(now) > 0, now).otherwise(F.col("_held"))


def role_on(rows: DataFrame, roles: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """rows plus `role`: of the roles with equal keys those in office on the day, else any; of these the smallest id."""
    return rows.join(_held(roles, keys), keys, "left").withColumn("role", F.get(_in_office(at), F.lit(0))).drop("_held")


def _best_by_span(asked: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """For each name asked for (_first, _last) and span of office: `top`, the best score, how many roles have it, one of them.

    A role has a row for each ending that is as long as some name asked for. Their number isn't known when the query is planned,
    so they are shuffled and sent to nobody whole.
    """
    length = F.length("_name")
    fits = F.filter("_lengths", lambda n: (n >= F.least(length, F.lit(1))) & (n <= length))
    endings = F.transform(fits, lambda n: F.substring(F.col("_name"), length - n + 1, n))
    lengths = asked.agg(F.collect_set(F.length("_last")).alias("_lengths"))
    ended = plain.join(F.broadcast(lengths)).withColumn("_last", F.explode(endings)).drop("_lengths")
    met = asked.join(ended.hint("merge"), [*keys, "_last"])
    score = (
        F.when(F.col("_name") == F.concat_ws(" ", "_first", "_last"), 100)
        .when(F.startswith("_name", "_first"), 90)
        .when(F.substring("_name", 1, 1) == F.substring("_first", 1, 1), 70)
        .otherwise(50)
    )
    entry = F.struct(*[c for c in ("external_role_id", "external_person_id", "full_name", "source_url", "bioguide_id", "party", "state", "service_start", "service_end")])
    by_score = met.groupBy(*keys, "_first", "_last", "service_start", "service_end", score.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("role"))
    return by_score.groupBy(*keys, "_first", "_last", "service_start", "service_end").agg(F.max(F.struct("score", "n", "role")).alias("top"))


def role_by_name(rows: DataFrame, roles: DataFrame, at: str, keys: list[str], first: str, last: str) -> DataFrame:
    """rows plus `role`: the single best name among the roles in office with equal keys, or null.

    An equal name scores 100, equal beginning and ending 90, equal ending and initial 70, equal ending 50. Each name that is
    asked for meets the roles that end with it, once; what is kept of them is, for each span of office, the best score, how
    many roles have it and one of these. So a row sees the few spans of a name, however many roles share it. Whether anyone
    is in office is asked of the state as a whole first.
    """
    plain = roles.filter(F.col("state").isNotNull()).withColumn("_name", plain_name(F.col("full_name")))
    spans = plain.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("service_start", "service_end"))).alias("_spans"))
    known = F.coalesce((F.length(first) > 0) & (F.length(last) > 0), F.lit(False))
    rows = rows.withColumn("_first", F.when(known, plain_name(F.col(first)))).withColumn("_last", F.when(known, plain_name(F.col(last))))
    by_span = _best_by_span(rows.select(*keys, "_first", "_last").filter("_last is not null").distinct(), plain, keys)
    held = by_span.groupBy(*keys, "_first", "_last").agg(F.collect_list(F.struct("service_start", "service_end", "top")).alias("_held"))
    found = rows.join(spans, keys, "left").join(held, [*keys, "_first", "_last"], "left")
    inside = lambda s: active(s.service_start, s.service_end, F.col(at))
    pool = F.when(F.exists("_spans", inside), F.filter("_held", inside)).otherwise(F.col("_held"))
    # The running best over the spans: its score, how many have it, and one that has it.
    start = F.struct(F.lit(0).alias("score"), F.lit(0).cast("long").alias("n"), F.get(F.transform("_held", lambda s: s.top.role), F.lit(0)).alias("role"))
    better = lambda best, s: F.when(s.top.score > best.score, s.top).when(s.top.score == best.score, F.struct(best.score.alias("score"), (best.n + s.top.n).alias("n"), best.role.alias("role"))).otherwise(best)
    out = found.withColumn("_best", F.reduce(F.coalesce(pool, F.array()), start, better))
    return out.withColumn("role", F.when(F.col("_best.n") == 1, F.col("_best.role"))).drop("_first", "_last", "_spans", "_held", "_best")


def president_on(events: DataFrame, presidents: DataFrame, at: str) -> DataFrame:
    """events plus `president`: of those in office on the day the one who took office last (ties: larger id).

    Presidents are gathered to one short list: an office with one holder at a time.
    """
    entry = F.struct("service_start", "external_role_id", "external_person_id", "full_name", "service_end")
    held = presidents.agg(F.array_sort(F.collect_list(entry)).alias("_held"))
    rows = events.join(F.broadcast(held))
    now = F.filter("_held", lambda r: active(r.service_start, r.service_end, F.col(at)))
    return rows.withColumn("president", F.when(F.col(at).isNotNull(), F.element_at(F.when(F.size(now) > 0, now), -1))).drop("_held")


def observed_actor(row_bioguide: str, row_name: str, row_party: str, row_state: str, fallback: Column) -> list[Column]:
    """The actor's attributes as a record and its role state them."""
    role = F.col("role")
    bioguide = F.coalesce(F.col(row_bioguide), role.bioguide_id)
    named = F.substring(F.sha2(F.concat_ws("|", F.coalesce(row_name, F.lit("")), F.coalesce(row_state, F.lit("")), F.coalesce(row_party, F.lit(""))), 256), 1, 24)
    official = F.coalesce(F.concat(F.lit("congress:"), bioguide), fallback, F.concat(F.lit("official-record:"), named))
    matched = role.external_role_id.isNotNull()
    return [
        official.alias("official_actor_id"), F.when(matched, role.external_person_id).otherwise(F.concat(F.lit("congress:"), bioguide)).alias("external_person_id"), role.external_role_id.alias("external_role_id"),
        bioguide.alias("bioguide_id"), F.when(matched, role.full_name).otherwise(F.col(row_name)).alias("full_name"), F.col(row_name).alias("official_record_name"),
        F.coalesce(F.col(row_party), role.party).alias("party"), F.coalesce(F.col(row_state), role.state).alias("state"),
        F.when(matched, MATCHED).otherwise(UNMATCHED).alias("resolution_status"), role.source_url.alias("role_source_url"),
    ]


def actor_key(role_id: Column, official_id: Column) -> Column:
    return F.concat(F.lit("actor:"), F.substring(F.sha2(F.coalesce(role_id, official_id), 256), 1, 24))


def legislative(rows: DataFrame, kind: Column, fallback: Column | None = None, instance: Column | None = None) -> DataFrame:
    """Edges with their actor's attributes, of rows with a resolved `role`; rows of all kinds are read at once.

    rows has event_id, relationship_date, bioguide_id, name, party, state, source_ids, roll_call_id, vote_cast, withdrawn_date.
    """
    facts = observed_actor("bioguide_id", "name", "party", "state", fallback if fallback is not None else F.lit(None).cast("string"))
    kept = ["event_id", "relationship_date", "source_ids", "roll_call_id", "vote_cast", "withdrawn_date"]
    seen = rows.select(*kept, kind.alias("relationship_type"), (instance if instance is not None else F.lit(None).cast("string")).alias("_instance"), *facts)
    return seen.select(
        record_id(F.col("event_id"), F.col("relationship_type"), F.col("roll_call_id"), F.col("official_actor_id"), F.col("_instance")).alias("id"), "relationship_type",
        F.lit("direct_official_record").alias("relationship_class"), actor_key(F.col("external_role_id"), F.col("official_actor_id")).alias("actor_id"), F.lit(None).cast("string").alias("institution_id"),
        *kept, *[c for c in ["official_actor_id", "external_person_id", "external_role_id", "bioguide_id", "full_name", "official_record_name", "party", "state", "resolution_status", "role_source_url"]],
    )


def _context(rows: DataFrame, kind: Column, kind_class: str, target: Column, date: Column, institution: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        record_id(F.col("event_id"), F.regexp_replace(kind, "_", "-") if kind_class != "temporal_officeholder_context_only" else kind, target).alias("id"), "event_id", kind.alias("relationship_type"), F.lit(kind_class).alias("relationship_class"),
        date.alias("relationship_date"), none.alias("actor_id"), institution.alias("institution_id"), none.alias("roll_call_id"), none.alias("vote_cast"), F.lit(None).cast("date").alias("withdrawn_date"),
        F.col("source_ids"), none.alias("resolution_status"),
    )


def agency_edges(events: DataFrame, scope: str = "jurisdiction_scope") -> DataFrame:
    """An edge from each event to each agency that its jurisdiction terms route to."""
    crosswalk = F.create_map(*[c for k, v in CROSSWALK.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    agencies = F.flatten(F.transform(scope, lambda t: F.coalesce(F.try_element_at(crosswalk, F.lower(F.trim(t))), F.array().cast("array<string>"))))
    rows = events.select("*", F.explode(F.array_distinct(agencies)).alias("_agency"))
    return _context(rows, F.lit("agency_jurisdiction_context"), "contextual_routing_only", F.col("_agency"), F.lit(None).cast("date"), F.concat(F.lit("agency:"), F.col("_agency")))


def presidential_edges(events: DataFrame, presidents: DataFrame) -> DataFrame:
    """An edge to the president in office, of executive orders, legislation and funding."""
    rows = president_on(events.filter(F.col("event_type").isin("executive_order", "legislation", "funding")), presidents, "date").filter("president is not null")
    kind = F.when(F.col("event_type") == "executive_order", "presidential_executive_order_context").otherwise("presidential_enactment_context")
    return _context(rows, kind, "temporal_officeholder_context_only", F.col("president.external_role_id"), F.col("date"), F.col("president.external_person_id"))


def court_edges(events: DataFrame) -> DataFrame:
    """An edge to the court of each decision with a docket number."""
    rows = events.filter((F.col("event_type") == "court_decision") & (F.length("court") > 0) & (F.length("docket_number") > 0))
    court = F.regexp_replace(F.regexp_replace(F.lower("court"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return _context(rows, F.lit("court_docket_institutional_link"), "direct_institutional_record", court, F.col("date"), F.concat(F.lit("court:"), court))


def edges(*kinds: DataFrame) -> DataFrame:
    """Edges of all kinds with their review priority."""
    return with_priority(reduce(DataFrame.unionByName, [k.select(*EDGE) for k in kinds]))


def with_priority(rows: DataFrame) -> DataFrame:
    """Adds review_priority_score, _band, _reasons and evidence_source_count."""
    n = F.coalesce(F.size(F.array_distinct("source_ids")), F.lit(0))
    n = F.when(F.col("source_ids").isNull(), 0).otherwise(n)
    base = reduce(lambda c, kv: c.when(F.col("relationship_type") == kv[0], kv[1]), BASE_SCORES.items(), F.when(F.lit(False), 0)).otherwise(20)
    direct = F.col("relationship_type").isin(DIRECT)
    open_actor = direct & ~F.coalesce(F.col("resolution_status") == MATCHED, F.lit(False))
    silent = F.coalesce((F.col("relationship_type") == "recorded_vote") & F.lower(F.trim("vote_cast")).isin(NO_POSITION), F.lit(False))
    score = F.when(n >= 2, F.least(F.lit(100), base + 3)).when(n == 0, F.greatest(F.lit(0), base - 10)).otherwise(base)
    score = F.when(open_actor, F.least(F.lit(100), score + 5)).otherwise(score)
    score = F.when(silent, F.greatest(F.lit(0), score - 10)).otherwise(score).cast("int")
    reasons = F.array_compact(F.array(
        F.concat(F.lit("relationship_type:"), "relationship_type"), F.when(n >= 2, "multiple_source_snapshots").when(n == 0, "missing_source_snapshot"),
        F.when(direct, "direct_official_record"), F.when(open_actor, "actor_resolution_review_needed"), F.when(silent, "no_recorded_position"),
    ))
    band = F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")
    return rows.select("*", n.cast("int").alias("evidence_source_count"), score.alias("review_priority_score"), band.alias("review_priority_band"), reasons.alias("review_priority_reasons"))


def _versions(observations: DataFrame) -> DataFrame:
    """How many observations give an actor each value of each compared field; a null value counts as one."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in COMPARED])
    # Equal observations are counted before they become a row for each field.
    equal = observations.groupBy("actor_id", *COMPARED).agg(F.count(F.lit(1)).alias("_n"))
    rows = equal.select("actor_id", F.explode(fields).alias("v"), "_n").select("actor_id", "v.*", "_n")
    return rows.groupBy("actor_id", "field", "value").agg(F.sum("_n").alias("observations"))


def actors(observations: DataFrame) -> DataFrame:
    """One row per actor: what all observations say, as sets where they may differ, and of the compared fields the value of most.

    Ties go to the smaller value. `conflicting_fields` names the fields with more than one value.
    """
    by = Window.partitionBy("actor_id", "field")
    ranked = _versions(observations).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_rank", F.row_number().over(by.orderBy(F.desc("observations"), F.asc_nulls_last("value"))))
    picks = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in COMPARED]
    clash = F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col("field")))).alias("conflicting_fields")
    kept = ranked.filter("_rank = 1").groupBy("actor_id").agg(*picks, clash)
    sets = [F.array_sort(F.collect_set(c)).alias(a) for c, a in (("full_name", "full_names"), ("official_record_name", "official_record_names"), ("party", "parties"), ("state", "states"))]
    # Few names per actor: distinct rows first, so a hot actor's votes are folded before they meet.
    seen = observations.select("actor_id", "full_name", "official_record_name", "party", "state").distinct().groupBy("actor_id").agg(*sets)
    return kept.join(seen, "actor_id")


def kept_value(observations: DataFrame, field: str) -> DataFrame:
    """(actor_id, field): of one compared field the value that `actors` keeps, by counts of that field alone."""
    counted = observations.groupBy("actor_id", field).agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(-F.col("_n"), F.col(field).isNull(), F.col(field))
    return counted.groupBy("actor_id").agg(F.min_by(field, order).alias(field))


def actor_conflicts(observations: DataFrame) -> DataFrame:
    """(actor_id, field, value, observations, kept) for each value of a compared field that observations of an actor disagree on."""
    by = Window.partitionBy("actor_id", "field")
    ranked = _versions(observations).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_rank", F.row_number().over(by.orderBy(F.desc("observations"), F.asc_nulls_last("value"))))
    return ranked.filter("_n > 1").select("actor_id", "field", "value", "observations", (F.col("_rank") == 1).alias("kept"))


def collapse_votes(actions: DataFrame) -> DataFrame:
    """Roll calls from action rows: one row per (chamber, congress, session, roll_number) with the sets of what actions say.

    `url_conflict` tells that actions give it different addresses; the smallest is kept.
    """
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("action_text", "action_type", "action_date", "event_id")]
    rows = actions.groupBy("chamber", "congress", "session", "roll_number").agg(F.min("url").alias("url"), F.max("url").alias("_url"), F.min("recorded_at").alias("recorded_at"), *sets)
    return rows.withColumn("url_conflict", F.coalesce(F.col("url") != F.col("_url"), F.lit(False))).drop("_url")


def coverage(rows: DataFrame, sources: DataFrame, known_actors: DataFrame) -> DataFrame:
    """One row: edges, edges without a source, sources and actors that nothing knows, edges by band."""
    base = rows.agg(
        F.count(F.lit(1)).alias("relationship_count"), F.count_if(F.col("evidence_source_count") == 0).alias("missing_source_count"),
        *[F.count_if(F.col("review_priority_band") == b).alias(b) for b in ("high", "medium", "low")],
    )
    named = rows.select(F.explode("source_ids").alias("source_id")).distinct()
    lost = named.join(sources.select("source_id").distinct(), "source_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_source_count"))
    nobody = rows.select("actor_id").filter("actor_id is not null").distinct().join(known_actors.select("actor_id"), "actor_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_actor_count"))
    return base.join(F.broadcast(lost)).join(F.broadcast(nobody))


def person_index(rows: DataFrame, known_actors: DataFrame) -> DataFrame:
    """(event_id, external_person_id): the ways in which a person is involved in an event, and the best priority."""
    met = rows.filter("actor_id is not null").join(known_actors.select("actor_id", "external_person_id"), "actor_id").filter("external_person_id is not null")
    return met.groupBy("event_id", "external_person_id").agg(
        F.array_sort(F.collect_set("relationship_type")).alias("relationship_types"), F.count(F.lit(1)).alias("n_relationships"), F.max("review_priority_score").alias("best_score"), F.min("relationship_date").alias("first_date")
    )
