"""Alias evidence and staged resolution on small records whose outcome is known by hand."""

from tallyglass.operators import entities as E

REG = "ticker string, cik string, company_name string, exchange string"
ROW = "id string, ticker string, label string, source_dataset string, asset_class string"


def test_issuer_core(spark):
    rows = [("Acme Corp. (ACM) [ST] Filing Status: New", "ACM", "acme"), ("THE ACME, Inc. - Class A Common Stock", None, "acme"), ("A.B (A.B) Ltd", "A.B", "b"), ("The Company", "X", ""), (None, None, ""), ("Beta (ACM)", "B+", "beta acm")]
    frame = spark.createDataFrame([r[:2] for r in rows], "name string, ticker string")
    assert [r.c for r in frame.select(E.issuer_core(frame.name, frame.ticker).alias("c")).collect()] == [r[2] for r in rows]


def test_evidence_and_its_four_gaps(spark):
    reg = spark.createDataFrame([("ACM", "1", "ACME CORP", "N"), ("ACM", "1", "ACME CORP", "Q"), ("TWO", "2", "TWO INC", "N"), ("TWO", "3", "DUO INC", "N"), ("LOW", "4", "LOW LTD", "N"), ("BAD", "5", "BADGER", "N")], REG)
    labels = [("acm", "Acme Inc.")] * 2 + [("ACM", "ACME"), ("ACM", "Acme Preferred"), (None, "Acme"), ("ACM", "  "), ("no symbol", "Acme")]
    labels += [("TWO", "Two")] * 3 + [("LOW", "Low"), ("LOW", "High"), ("LOW", "Low Ltd")] + [("BAD", "Other")] * 3 + [("NIL", "Nil")] * 3 + [("RARE", "Rare")] * 2
    rows = spark.createDataFrame([(str(k), t, n, "d", "c") for k, (t, n) in enumerate(labels)], ROW)
    records, gaps = E.alias_evidence(rows, reg)
    assert sorted((r.ticker, r.alias, r.occurrence_count, r.issuer_occurrences, tuple(r.exchanges)) for r in records.collect()) == [("ACM", "ACME", 1, 3, ("N", "Q")), ("ACM", "Acme Inc.", 2, 3, ("N", "Q"))]
    assert sorted((r.ticker, r.gap_type, r.occurrence_count, tuple(r.observed_aliases)) for r in gaps.collect()) == [
        ("ACM", "issuer_name_mismatch", 1, ("Acme Preferred",)), ("BAD", "issuer_name_mismatch", 3, ("Other",)), ("LOW", "issuer_name_mismatch", 1, ("High",)),
        ("LOW", "supported_alias_below_frequency_threshold", 2, ("Low", "Low Ltd")), ("NIL", "ticker_not_in_sec_reference", 3, ("Nil",)), ("TWO", "ambiguous_sec_ticker", 3, ("Two",)),
    ]
    assert E.alias_evidence(rows, reg, already=["acm"])[0].collect() == []
    assert [f.collect() for f in E.alias_evidence(rows.filter("false"), reg)] == [[], []]


def test_sources_in_order_join_start_or_stay_apart(spark):
    make = lambda rows: spark.createDataFrame(rows, E.RECORD)
    first = make([("a", "Acme Corp", "1", None, ["ACM"]), ("b", "Acme Inc", "2", None, ["ACB", "not a symbol"]), ("c", "Solo", "3", None, [])])
    second = make([
        ("by symbol", "Something else", None, None, [" acm "]), ("by name", "SOLO", None, None, None), ("by core", "The Solo Company", None, None, []), ("core of two", "Acme Limited", None, None, []),
        ("two symbols", "Acme Corp", None, None, ["ACM", "ACB"]), ("own", "New", None, "s9", ["NEW"]), ("own again", "Newer", None, "s9", []), ("nameless", None, None, None, None),
    ])
    third = make([("symbol of nobody", "Late", None, "s1", ["LAT"]), ("known symbol", "Late", None, "s2", ["NEW"])])
    fourth = make([("late symbol", "Nobody", None, None, ["LAT"])])
    made = E.build([E.Source("x", 90, first), E.Source("y", 95, second), E.Source("z", 10, third, known_symbols=True), E.Source("w", 5, fourth)])
    got = {r.record_id: r.entity for r in made.members.collect()}
    assert got == {
        "a": "0|cik:1", "b": "0|cik:2", "c": "0|cik:3", "by symbol": "0|cik:1", "by name": "0|cik:3", "by core": "0|cik:3", "core of two": "1|record:core of two", "two symbols": "1|record:two symbols",
        "own": "1|source:s9", "own again": "1|source:s9", "nameless": "1|record:nameless", "symbol of nobody": "2|source:s1", "known symbol": "1|source:s9", "late symbol": "3|record:late symbol",
    }
    assert sorted((r.record_id, r.low, r.high) for r in made.issues.collect()) == [("core of two", "0|cik:1", "0|cik:2"), ("two symbols", "0|cik:1", "0|cik:2")]
    rows = {r.entity: r for r in made.organizations().collect()}
    assert (rows["0|cik:1"].canonical_name, rows["0|cik:1"].stable_key, rows["0|cik:1"].sources) == ("Something else", "cik:1", ["x", "y"])
    assert rows["1|source:s9"].canonical_name == "New" and "1|record:nameless" not in rows


def test_labels_link_by_one_ticker_only(spark):
    made = E.build([E.Source("x", 90, spark.createDataFrame([("a", "A", "1", None, ["ONE", "BOTH"]), ("b", "B", "2", None, ["BOTH", "EVI"])], E.RECORD))])
    evidence = spark.createDataFrame([("EVI", "b corp")], "ticker string, normalized_alias string")
    rows = spark.createDataFrame([(str(k), t, n, "d", "c") for k, (t, n) in enumerate([("ONE", "Aa"), ("one", "aa"), ("BOTH", "x"), ("NO", "x"), ("EVI", "B Corp."), ("EVI", "B Trust"), (None, "A")])], ROW)
    linked, issues = E.link_labels(rows, made, evidence)
    assert [(r.entity, r.alias, r.occurrence_count) for r in linked.collect()] == [("0|cik:1", "Aa", 2)]
    assert sorted((r.issue_type, r.label) for r in issues.collect()) == [("ambiguous_disclosed_ticker", "x"), ("unresolved_disclosed_ticker", "x"), ("unsupported_sec_alias_label", "b trust")]
