"""Delimited texts as a CSV reader splits them, headers that name a field twice, line ends, all labels, and the fallback."""

import csv
import random

from pyspark.sql import functions as F

from tallyglass.plans import parsers as P

TEXT = "filing_id int, text string"


def rows(spark, text, kind=P.table_transactions):
    return [(r.row_number, r.asset, r.ticker, r.action, r.date, r.amount) for r in kind(spark.createDataFrame([(1, text)], TEXT)).orderBy("row_number").collect()]


def test_fields_split_as_a_csv_reader_does(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(['"', '""', ",", "|", "\t", "a", " b", "$1", ""]) for _ in range(rng.randint(0, 9))) for _ in range(600)] + ["x" * 20_000 + ',"' + "y," * 9_000 + '"']
    for d in P.DELIMITERS:
        frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if t], TEXT)
        got = {r.filing_id: list(r.f) for r in frame.select("filing_id", P.split_fields(F.col("text"), d).alias("f")).collect()}
        assert got == {k: next(csv.reader([t], delimiter=d)) for k, t in enumerate(texts) if t}


def test_quoted_amounts_and_assets(spark):
    text = 'Owner,Asset,Ticker,Type,Date,Amount\r\nSelf,"Acme, Inc ""A""",ACM,P,1/2/2020,"$1,001 - $15,000"\r\n\r\n"SP",Beta,,s (partial),02/03/2021,$5\rx,,T,P,1/2/2020,$1'
    assert rows(spark, text) == [(1, 'Acme, Inc "A"', "ACM", "BUY", "2020-01-02", "$1,001 - $15,000"), (2, "Beta", None, "SELL", "2021-02-03", "$5")]


def test_the_later_of_two_columns_with_one_field(spark):
    text = "note\nAsset|Description|Type|Date|Amount|Amount\nshort|Long name|buy|2020-01-02|$1|$2\nonly|\n|Two|sale|1/2/20|$3|$4|more"
    assert rows(spark, text) == [(1, "Long name", None, "BUY", "2020-01-02", "$2"), (3, "Two", None, "SELL", "2020-01-02", "$4")]


def test_no_table_and_empty_texts(spark):
    assert rows(spark, "Asset|Type\nA|B") == [] == rows(spark, "") == rows(spark, None) == rows(spark, "one, two, three")
    assert rows(spark, "Widget (WID) 1/2/2020 $1,000 - $2,000 Purchase for us", P.line_transactions) == [(1, "Widget", "WID", "BUY", "2020-01-02", "1")]


def test_all_labels(spark):
    text = "Name - Jo Lee\nPosition Title: Judge\nCourt: Ninth\nReporting Period: 2019\nCalendar year: 2019\nStatus: Amended\nOffice: X\nDate of filing: 3/4/2020 late\nForm: 278"
    r = P.metadata(spark.createDataFrame([(1, text)], TEXT)).first()
    assert (r.filer_name, r.position, r.court, r.reporting_period, r.report_year, r.report_status, r.agency, r.filing_date, r.report_type, r.is_amendment) == ("Jo Lee", "Judge", "Ninth", "2019", "2019", "Amended", "X", "2020-03-04", "278", True)
