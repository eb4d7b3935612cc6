"""Table cells against pages whose grids are written out by hand."""

import pytest

from tallyglass.sources import html_tables as H

PAGES = {
    1: ("<table><tr><th>A<th>B<tr><td rowspan=2>x<td>1<tr><td>2</table>", [[["A", "B"], ["x", "1"], ["x", "2"]]]),
    2: ("<table><tr><td colspan='3'>wide</td><td>e</td></tr><tr><td>a<td>b<td>c<td>d</table>", [[["wide", "wide", "wide", "e"], ["a", "b", "c", "d"]]]),
    3: ("<table><tr><td>out <table><tr><td>in</td></tr></table> er</td><td>z</td></tr></table>", [[["out er", "z"]], [["in"]]]),
    4: ("<table><tr></tr><tr><td> <br></td></tr><tr><td>only&nbsp;&amp; one", [[["only & one"]]]),
    5: ("<td>no table</td><p>x", []),
    6: ("<table><td rowspan='9' colspan='0'>a<td rowspan='x'>b<tr><td>c</table><table><tr><td>d</table>", [[["a", "b"], ["a", "c"]], [["d"]]]),
    7: ("<table><tr><td rowspan=2 colspan=2>s<td>1<tr><td>2<tr><td>p<td>q<td>r</table>", [[["s", "s", "1"], ["s", "s", "2"], ["p", "q", "r"]]]),
    8: (None, []),
    9: ("", []),
}


def test_grids(spark):
    frame = spark.createDataFrame([(k, h, "clash") for k, (h, _) in PAGES.items()], "page_id int, html string, table_no string")
    got = {k: {} for k in PAGES}
    for r in H.cells(frame).collect():
        got[r.page].setdefault(r.table_no, {}).setdefault(r.row_no, {})[r.col_no] = r.text
    assert {k: [[list(dict(sorted(row.items())).values()) for _, row in sorted(t.items())] for _, t in sorted(v.items())] for k, v in got.items()} == {k: v for k, (_, v) in PAGES.items()}
    assert H.cells(frame.filter("false")).collect() == []


def test_links_and_headers(spark):
    frame = spark.createDataFrame([(1, '<table><tr><th>h</th><td><a href="/1">a</a><a href="/2">b</a></td><td><a>c</a></td></table>')], "page_id int, html string")
    assert [(r.header, r.text, r.href) for r in H.cells(frame).orderBy("col_no").collect()] == [(True, "h", None), (False, "a b", "/1"), (False, "c", None)]


def test_first_table_with_all_fields(spark):
    head = "<tr><th>Date<th>Owner<th>Asset<th>Type<th>Amount<th>Date of Transaction</tr>"
    html = f"<table><tr><th>Date<th>Owner</tr><tr><td>x<td>y</tr></table><table>{head}<tr><td>1/2/2020<td>Me<td>A<td>Buy<td>$1<td>2/3/2021</tr><tr><td><td><td>B</tr></table><table>{head}<tr><td>late</tr></table>"
    rows = H.report_transactions(spark.createDataFrame([(1, html), (2, "<table><tr><td>Date</table>")], "page_id int, html string")).orderBy("row_number").collect()
    assert [(r.page, r.row_number, str(r.transaction_date), r.asset_name, r.reason) for r in rows] == [(1, 1, "2021-02-03", "A", None), (1, 2, "None", "B", "missing required field(s): transaction date, type, amount")]


@pytest.mark.parametrize("text,want", [("1/2/2020", "2020-01-02"), ("13/2/2020", None), ("2/30/2020", None), ("01/02/20", None), ("x", None), (None, None)])
def test_portal_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(H.portal_date(H.F.col("t")).cast("string").alias("d")).first().d
    assert got == want


def test_heads(spark):
    html = '<h1>Report</h1><h2 class="filedReport b">Jo<br>Lee</h2><p class="muted">Filed 03/04/2020 and 1/1/2000</p><h1>Late 5/6/2021</h1>'
    assert [tuple(r) for r in H.report_heads(spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None)], "page_id int, html string")).orderBy("page").collect()][0][:3] == (1, "Report", "Jo Lee")
    assert str(H.report_heads(spark.createDataFrame([(1, html)], "page_id int, html string")).first().filing_date) == "2021-05-06"


def test_plain_pages_need_no_parser(monkeypatch):
    pages = ["<!doctype html><h1>A &amp; b</h1><TABLE class='t'><tr><th colspan=2>x<td><a href=\"/q?a&amp;b\">T</a> > <br>y</table><p class='b a'>end", "", "t < u<p>x", "<table><!-- <td> --><td>a<br/></table>", "<p>a<script><p></script>", "<p/>b", "<a href=/x/><table><td>&#65;<td>&am"]
    feed = H.HTMLParser.feed
    by_parser = []

    def read(parser, html):
        feed(parser, html)
        parser.close()

    for kind in (H.TableGrids, H.HeadingBlocks):
        got = [list(kind().eval(x)) for x in pages]
        with monkeypatch.context() as m:
            m.setattr(H, "_read", read)
            assert got == [list(kind().eval(x)) for x in pages]
        with monkeypatch.context() as m:
            m.setattr(H.HTMLParser, "feed", lambda self, html: by_parser.append(html))
            for x in pages[:2]:
                list(kind().eval(x))
    assert by_parser == []


def test_a_pages_tables_are_chosen_in_its_row(spark):
    """no shuffle and no sort of grids; the first table with all fields counts, whatever comes before it."""
    head = "<tr><th>Date<th>Owner<th>Asset<th>Type<th>Amount</tr>"
    html = f"<table><tr><td colspan=2><td>x</table><table><tr><th>Date</table><table>{head}<tr><td>1/2/2020<td>Me<td>A<td>Buy<td>$1</table><table>{head}<tr><td>late</table>"
    frame = H.report_transactions(spark.createDataFrame([(k, html) for k in (1, 2)] + [(3, None), (4, "<p>")], "page_id int, html string"))
    made = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in made and "Aggregate" not in made
    assert sorted((r.page, r.row_number, r.asset_name, r.reason) for r in frame.collect()) == [(1, 1, "A", None), (2, 1, "A", None)]


def test_plain_tables_are_read_as_by_the_handlers(monkeypatch):
    """random markup, by the short path for cells and by the handlers."""
    import random

    rng = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<td colspan=2>", "<td rowspan='3'>", "<td rowspan=2 colspan=3>", "<td class=x>", "x", "y &amp; z", " ", "<br>", "<a href='/1'>", "</a>", "<p>", "</TD>", "<Tr>", "&nbsp;", ">"]
    pages = ["<table>" * (k % 2) + "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for k in range(3000)]
    got = [list(H.TableGrids().eval(x)) for x in pages]
    monkeypatch.setattr(H._Tables, "plain", H._Parser.plain)
    assert got == [list(H.TableGrids().eval(x)) for x in pages] and any(got)
