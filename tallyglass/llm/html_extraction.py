"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between block-level tags, each with its root-to-leaf path of block tags. Per
path, text length, punctuation and the share of text in links are added up, each block up to `LONG` characters and
`MARKS` marks; the ratios to the number of blocks are smoothed with those of the path's parent, so that a heading shares
in the article around it, and fused into one score. The bounds hold for the score alone: one very long block cannot
outweigh normal paragraphs, and its text stays whole. Paths below a share of the best score (a smaller one inside article
or main elements, whose scores weigh more) are dropped, unless they lie in an article or main element that holds a selected
path, or hang as lists, tables, captions or other flow elements on the element around a selected block. A tag, role or class
that names an element as furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) is a prior only:
the scores of the paths through it count `PRIOR` times and without the weight of an article. It is no prior at all where the
element holds most of the page's text, nor on paragraphs, headings and other text elements, nor by a class that says what a
layout has or lacks (`with-sidebar`, `no-comments`). The blocks of the selected paths are the text, in page order.

Paths are numbers, found by their parent's number and their last label, so a page's cost grows with its length, however
deep its tags are nested.

Defined results: null html counts as empty and gives empty text; html without tags is one block; unclosed and stray
tags are tolerated; rows that repeat an id are extracted each; nothing is capped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, slices

RAW = "script|style|noscript|template|svg|annotation|annotation-xml|iframe|object|textarea|select|button|title|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN, QUOTED = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I), re.compile(r"\"[^\"]*\"|'[^']*'")
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = set("area base col embed frame hr input link meta param source track".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "menu", "article", "section", "div", "body"}
FURNITURE_TAGS = set("nav footer aside form dialog fieldset menu head".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FURNITURE = set(
    "ad ads adbox adslot advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")
LAYOUT = ("with", "has", "no", "without", "not", "hide", "js")
CONTENT_WEIGHT = 12.0
PRIOR, MOST_TEXT = 0.02, 0.5
KEEP_SHARE, KEEP_SHARE_INSIDE = 0.2, 0.02
LONG = 400
MARKS = 8
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody caption figcaption figure blockquote pre summary html body article main".split())
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption blockquote pre details summary".split())


def blocks(html: str):
    """The blocks that have text, in page order, the parent of each path, and the elements (tag, parent) they number.

    A block is (path, text, characters in links, furniture, box, element); box is the outermost article or main element
    around it, or 0.
    """
    stack: list[tuple[str, int, int, int]] = []
    open_tags: dict[str, int] = defaultdict(int)
    paths: dict[tuple[int, str], int] = {}
    above = [0]
    text: list[str] = []
    out = []
    elements = [("", 0)]
    named = [False]
    links = linked = 0

    def cut():
        nonlocal linked
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                top = stack[-1] if stack else ("", 0, 0, 0)
                out.append((top[1], block, min(linked, len(block)), *top[2:]))
        linked = 0

    def close(depth: int):
        for s in stack[depth:]:
            open_tags[s[0]] -= 1
        del stack[depth:]

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if m[2] else links + 1
            elif tag in ("br", "img", "wbr") or m[1] and m[1].lower() not in ("script", "style"):
                text.append(" ")
            continue
        cut()
        links = 0
        if m[2]:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in HOLDS:
                    break
        same = SAME.get(tag)
        if same and any(open_tags[t] for t in same):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same:
                    close(k)
                    break
                if stack[k][0] in HOLDS:
                    break
        if tag in VOID or m[4].endswith("/") and tag not in HOLDS:
            continue
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[4])} if m[4] else {}
        classes = (attributes.get("class", "") + " " + attributes.get("id", "")).lower()
        words = set(re.split(r"[^a-z0-9]+", classes))
        _, path, box, parent = stack[-1] if stack else ("", 0, 0, 0)
        furniture = (
            tag in FURNITURE_TAGS
            or (tag == "header" and not box)
            or attributes.get("role", "").lower() in FURNITURE_ROLES
            or (tag not in TEXT_TAGS and any(set(x) & FURNITURE and x[0] not in LAYOUT for x in (re.split(r"[^a-z0-9]+", c) for c in classes.split())))
            or attributes.get("aria-hidden") == "true"
            or (m[4] and "hidden" in m[4] and HIDDEN.search(QUOTED.sub("", m[4])) is not None)
            or NOT_SHOWN.search(attributes.get("style", "")) is not None
        )
        if not box and (tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop") == "articleBody"):
            box = len(elements)
        step = (path, tag + "".join("." + w for w in sorted(words) if w and not w.isdigit()))
        if step not in paths:
            paths[step] = len(above)
            above.append(path)
        stack.append((tag, paths[step], box, len(elements)))
        open_tags[tag] += 1
        elements.append((tag, parent))
        named.append(bool(furniture))
    if at < len(html):
        text.append(html[at:])
    cut()
    furniture = _furniture(out, elements, named)
    return [(path, text, linked, furniture[element], box, element) for path, text, linked, box, element in out], above, elements


def _furniture(found, elements, named) -> list[bool]:
    """Whether each element is, or lies in, one that is named as furniture and doesn't hold most of the page's text.

    Most is more than MOST_TEXT of the text out of links, and of that in articles and main elements if there are any.
    """
    size, boxed = [0] * len(elements), [0] * len(elements)
    for _, text, linked, box, element in found:
        size[element] += len(text) - linked
        boxed[element] += (len(text) - linked) * (box > 0)
    for k in range(len(elements) - 1, 0, -1):
        size[elements[k][1]] += size[k]
        boxed[elements[k][1]] += boxed[k]
    out = [False] * len(elements)
    for k in range(1, len(elements)):
        most = size[k] > MOST_TEXT * size[0] and (not boxed[0] or boxed[k] > MOST_TEXT * boxed[0])
        out[k] = out[elements[k][1]] or (named[k] and not most)
    return out


def path_scores(found, above) -> dict[tuple[int, bool, bool], float]:
    """The score of each (path, furniture, inside a box) of the blocks."""
    own, around = defaultdict(lambda: [0.0] * 4), defaultdict(lambda: [0.0] * 4)
    for path, text, linked, _, _, _ in found:
        share = linked / len(text)
        for sums in (own[path], around[above[path]]):
            for k, x in enumerate((min(len(text), LONG), min(len(PUNCTUATION.findall(text)), MARKS), share, 1)):
                sums[k] += x
    scores = {}
    for path, _, _, furniture, box, _ in found:
        key = (path, furniture, box > 0)
        if key not in scores:
            a, b = own[path], around[above[path]]
            length, marks, linked = ((a[k] / a[3] + b[k] / b[3]) / 2 for k in range(3))
            scores[key] = length * (1 + marks) * (1 - 0.9 * linked) * (PRIOR if furniture else CONTENT_WEIGHT if box else 1)
    return scores


def main_text(html: str | None) -> str:
    found, above, elements = blocks(html or "")
    scores = path_scores(found, above)
    best = max(scores.values(), default=0)
    boxes, held, chosen = set(), [False] * len(elements), []
    for path, _, _, furniture, box, element in found:
        share = KEEP_SHARE_INSIDE if box and not furniture else KEEP_SHARE
        chosen.append(scores[path, furniture, box > 0] >= share * best)
        if chosen[-1] and not furniture:
            boxes.add(box)
            tag, parent = elements[element]
            held[element] = element > 0 and tag not in ("html", "body")
            if tag in FLOW and elements[parent][0] not in ("", "html", "body"):
                held[parent] = True
    boxes.discard(0)
    for k, (tag, parent) in enumerate(elements):
        held[k] = held[k] or (tag in FLOW and held[parent])
    return " ".join(text for (_, text, _, furniture, box, element), c in zip(found, chosen, strict=True) if c or not furniture and (box in boxes or held[element]))


def _extract(batches):
    for batch in slices(batches):
        texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, url, main text and n_chars."""
    few_rows(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    out = rows.mapInArrow(_extract, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
