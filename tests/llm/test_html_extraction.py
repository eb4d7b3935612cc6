import html
import re

import pyarrow.parquet as pq
import pytest

from tallyglass.llm import html_extraction as H

SF = "/root/testdata/sf0.01"


def article(page):
    """The template's article, read by hand: heading and paragraphs, in order."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    body = re.sub(r"</?(?:h1|p)>", "\x00", body)
    body = re.sub(r"<br>", " ", re.sub(r"</?b>", "", body))
    parts = (" ".join(html.unescape(x).split()) for x in body.split("\x00"))
    return " ".join(x for x in parts if x)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = H.op10_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_other_layouts():
    long = "A sentence of the story, with commas, that goes on for a while. " * 6
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id=menu><ul><li><a href=x>One</a><li>Two</ul></div>
    <main><h1>Head &amp; line</h1><p class='lead'>{long}<p>Short.<div class="cookie-notice"><p>{long}</div><script>if (a<b) "</p>"</script><p>Last&nbsp;one <b>bold</b>face</p></main>
    <div class="sidebar">{long}</div><section id="comments"><p>{long}</p></section><form>{long}</form><footer>{long}</footer></body>"""
    assert H.main_text(page) == " ".join(["Head & line", long.strip(), "Short.", "Last one boldface"])
    plain = f"<div><div><a href=1>Home</a></div><div><a href=2>News</a></div></div><div><p>{long}</p><p>{long}</p></div>"
    assert H.main_text(plain) == f"{long.strip()} {long.strip()}"


def test_short_items_and_one_long_block():
    prose = "A paragraph of the report, as they come; it has marks. " * 7
    rows = "<tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr>"
    body = f"<h2>Parts</h2><p>{prose}</p><ul><li>first short item</li><li>second</li></ul><table><caption>Sums</caption>{rows}</table><p>{prose}</p><figure><img src=x><figcaption>A view</figcaption></figure>"
    want = " ".join(["Parts", prose.strip(), "first short item second Sums Year Sum 1999 12", prose.strip(), "A view"])
    menu = "<div><div><a href=1>Home</a></div><div><a href=2>News</a></div></div>"
    quote = "Words of a very long block, which goes on. " * 2400
    short = "A paragraph of two hundred characters, with a few marks, as is usual in a report of this kind. " * 2
    both = " ".join([*[short.strip()] * 20, quote.strip()])
    for a, b in (("<article>", "</article>"), ("<main><div class=x>", "</div></main>"), ("<div class=post>", "</div>")):
        assert H.main_text(f"<body>{menu}{a}{body}{b}</body>") == want
        assert H.main_text(f"<body>{menu}{a}{body}<blockquote>{quote}</blockquote>{b}</body>") == f"{want} {quote.strip()}"
        assert H.main_text(f"<body>{menu}{a}{f'<p>{short}</p>' * 20}<blockquote>{quote}</blockquote>{b}</body>") == both
    apart = f"<body>{menu}<div class=a>{f'<p>{short}</p>' * 20}</div><div class=b><blockquote>{quote}</blockquote></div></body>"
    assert H.main_text(apart) == both


def test_edges(spark):
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("just text &lt;3") == "just text <3"
    assert H.main_text("<p>" * 3000 + "deep") == "deep" and H.main_text("<a b='" * 2000 + ">") is not None
    assert len(H.main_text("<p>" + "word " * 300_000)) == 1_499_999
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>t", "y")], "page_id long, url string, html string, text string")
    assert sorted(map(str, (tuple(r) for r in H.extract(rows).collect()))) == ["(1, 'u', '', 0)", "(1, 'u', '', 0)", "(None, None, 't', 1)"]
    assert H.extract(rows.limit(0)).count() == 0


def test_neutral_class_names(monkeypatch):
    """Without the word lists the ratios find the article of a layout that names nothing."""
    for name in ("FURNITURE", "FURNITURE_TAGS", "FURNITURE_ROLES"):
        monkeypatch.setattr(H, name, set())
    prose = "A paragraph of the report, as they come; it has marks, and goes on for a while. " * 4
    menu = "".join(f"<li><a href={k}>Item {k}</a></li>" for k in range(8))
    page = f"<body><div class=q1><ul>{menu}</ul></div><div class=q2>{f'<p>{prose}</p>' * 5}</div><div class=q3><a href=x>Terms</a> <a href=y>About</a></div></body>"
    assert H.main_text(page) == " ".join([prose.strip()] * 5)


def test_deep_nesting_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert H.main_text("<div>" * n + "deep") == "deep"
        assert H.main_text("<x-y>" * n + "<td>a" * 50).startswith("a")
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


ARTICLE = "<h1>A title of its own</h1>" + "".join(f"<p>Paragraph {k} of an ordinary article, with some words, marks and a little more.</p>" for k in range(6))
AROUND = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></nav>", "<footer>© 2020 · All rights are reserved by the company, and more.</footer>"


@pytest.mark.parametrize(
    "around",
    [
        '<div class="layout with-sidebar">%s</div>', '<div class="post no-comments">%s</div>', '<section class="social-science">%s</section>', '<form id="aspnetForm">%s</form>', '<div style="overflow:hidden">%s</div>',
        '<main class="sidebar"><article class="comment">%s</article></main>', '<article><section class="social-science">%s</section></article>', '<div hidden-by="x" data-hidden="1">%s</div>',
    ],
)
def test_no_article_is_lost_to_a_name(around):
    want = H.main_text(f"<article>{ARTICLE}</article>")
    assert want.count("Paragraph") == 6
    assert H.main_text(AROUND[0] + around % ARTICLE + AROUND[1]) == want


def test_hidden_elements_text_with_class_names_and_formulas():
    html = "<article><p>One two, three.</p><div hidden>Not shown here, at all.</div><div style='color:red; display : none'>Nor this one, either.</div><p class='related-work'>Related work is here, too.</p><p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds, always.</p></article>"
    assert H.main_text(html) == "One two, three. Related work is here, too. E = mc2 holds, always."


def test_the_ratios_decide(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    want = [H.main_text(h) for h in pages]
    for name in ("FURNITURE_TAGS", "FURNITURE_ROLES", "FURNITURE"):
        monkeypatch.setattr(H, name, set())
    assert sum(H.main_text(h) == w for h, w in zip(pages, want, strict=True)) >= 0.95 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(H, "KEEP_SHARE", 0)
    monkeypatch.setattr(H, "KEEP_SHARE_INSIDE", 0)
    assert sum(H.main_text(h) == w for h, w in zip(pages, want, strict=True)) < 0.5 * len(pages)
