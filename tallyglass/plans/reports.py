"""Transaction reports as HTML pages of the bound tables, read back as rows; the SQL takes the rows from the tables.

Each order is a page with a table of its line items. Pages vary: other labels, no number column, an owner's cell over all
rows, a comment over two columns, a layout table around it; some dates are no dates and some assets are missing.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import html_tables as H
from . import bindings as B
from .relational import C

QUERIES, ORACLES = {}, {}


def _td(x, more=""):
    return F.concat(F.lit(f"<td{more}>"), x, F.lit("</td>"))


def pages(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), C("l_partkey") == C("p_partkey"))
    key = C("l_orderkey")
    lines = lines.withColumn("n", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    day = F.date_format("l_shipdate", "M/d/yyyy")
    date = F.when(F.round(C("l_tax") * 100) == 7, F.concat(F.lit("on "), day)).otherwise(day)
    asset = F.when(F.round(C("l_discount") * 100) == 10, F.lit(" <br> ")).otherwise(F.concat(F.lit("<b>"), F.initcap("p_name"), F.lit("</b> &amp; Co")))
    owner = F.when(key % 4 == 0, F.when(C("n") == 1, F.concat(F.lit('<td rowspan="'), C("of").cast("string"), F.lit('">Joint</td>'))).otherwise("")).otherwise(_td(F.element_at(F.array(F.lit("Self"), F.lit("Spouse")), (C("l_linenumber") % 2 + 1).cast("int"))))
    number = F.when(key % 5 == 0, "").otherwise(_td((C("n") + 10).cast("string")))
    row = F.concat(
        F.lit("<tr>"), number, _td(date), owner, _td(F.when(C("l_linenumber") % 3 == 0, "--").otherwise(F.concat(F.lit(' <a href="/q">T'), (C("l_partkey") % 300).cast("string"), F.lit("</a>")))), _td(asset), _td(C("p_type")),
        _td(F.when(C("l_returnflag") == "R", "Sale&nbsp;(Full)").otherwise("Purchase")), _td(F.concat(F.lit("$"), C("l_extendedprice").cast("long").cast("string"))), F.lit('<td colspan="2">'), F.when(C("l_linestatus") == "O", "open\n  line").otherwise("--"), F.when(key % 3 == 0, "</tr>").otherwise("</td></tr>"),
    )
    body = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("h")))), lambda r: r.h), "\n").alias("body"))
    docs = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), C("o_custkey") == C("c_custkey")).join(body, C("o_orderkey") == C("l_orderkey"), "left")
    labels = F.when(C("o_orderkey") % 3 == 0, "<th>Date</th><th>Ownership</th><th>Symbol</th><th>Security</th><th>Type of Asset</th><th>Action</th><th>VALUE</th><th>Notes<th>Other").otherwise(
        "<th>Transaction<br>Date</th><th>Owner</th><th>Ticker</th><th>Asset Name</th><th>Asset Type</th><th>Type</th><th>Amount</th><th>Comment</th>"
    )
    head = F.concat(F.lit("<tr>"), F.when(C("o_orderkey") % 5 == 0, "").otherwise("<th>#</th>"), labels, F.lit("</tr>"))
    table = F.concat(F.lit("<TABLE class='t'><thead>"), head, F.lit("</thead><tr><td> </td></tr><tbody>"), F.coalesce("body", F.lit("")), F.lit("</tbody></TABLE>"))
    layout = F.when(C("o_orderkey") % 7 == 0, F.concat(F.lit("<table><tr><td>menu<td>"), table, F.lit("</td></tr></table>"))).otherwise(table)
    filed = F.date_format("o_orderdate", "MM/dd/yyyy")
    top = F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("<h1>Periodic Report for "), filed, F.lit("</h1>"))).otherwise("<h1>Periodic Report</h1>")
    html = F.concat(F.lit("<!doctype html><body>"), top, F.lit('<h2>Site</h2><h2 class="x filedReport">'), C("c_name"), F.lit('</h2><p>Printed 1/1/2030</p><p class="muted">Filed '), filed, F.lit(" @ 9:15</p>"), layout)
    return docs.select(C("o_orderkey").alias("filing_id"), html.alias("html"))


QUERIES["sc10_report_transactions"] = lambda spark, sf: H.report_transactions(pages(spark, sf), "filing_id")
QUERIES["sc10_report_heads"] = lambda spark, sf: H.report_heads(pages(spark, sf), "filing_id")


def page_blocks(spark, sf):
    """The headings and paragraphs of the web pages, counted by tag, with their cells."""
    raw = B.table(spark, sf, "pages")
    found = H.blocks(raw).groupBy("page").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(C("tag") == "h1").alias("n_h1"), F.sum(F.length("text")).alias("n_chars"))
    grid = H.cells(raw).groupBy("page").agg(F.count(F.lit(1)).alias("n_cells"))
    return raw.select(C("page_id").alias("page")).join(found, "page", "left").join(grid, "page", "left").na.fill(0)


QUERIES["sc10_page_blocks"] = page_blocks
ORACLES["sc10_report_transactions"] = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, round(l_tax * 100) = 7 AS undated, round(l_discount * 100) = 10 AS bare FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey)
 SELECT l_orderkey AS page, CAST(CASE WHEN l_orderkey % 5 = 0 THEN n ELSE n + 10 END AS INTEGER) AS row_number, CASE WHEN NOT undated AND NOT bare THEN CAST(l_shipdate AS DATE) END AS transaction_date, CASE WHEN l_orderkey % 4 = 0 THEN 'Joint' WHEN l_linenumber % 2 = 0 THEN 'Self' ELSE 'Spouse' END AS owner,
 CASE WHEN l_linenumber % 3 <> 0 THEN 'T' || (l_partkey % 300) END AS ticker, CASE WHEN NOT bare THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' & Co' END AS asset_name, p_type AS asset_type, CASE WHEN l_returnflag = 'R' THEN 'Sale (Full)' ELSE 'Purchase' END AS transaction_type,
 '$' || CAST(trunc(l_extendedprice) AS BIGINT) AS amount, CASE WHEN l_linestatus = 'O' THEN 'open line' END AS comment, CASE WHEN bare THEN 'missing required field(s): asset name' WHEN undated THEN 'invalid transaction date' END AS reason FROM l"""
ORACLES["sc10_report_heads"] = "SELECT o_orderkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN 'Periodic Report for ' || strftime(o_orderdate, '%m/%d/%Y') ELSE 'Periodic Report' END AS title, c_name AS filer, CAST(o_orderdate AS DATE) AS filing_date FROM orders JOIN customer ON o_custkey = c_custkey"
