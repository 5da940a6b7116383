"""Trees of HTML elements, against a scan that keeps only the names of what is open."""

from __future__ import annotations

import html as entities
import re

import pytest

from tessera.sources import html_tree
from tessera.sources.html_tree import processed

NOISE = ["nav", "navigation", "menu", "sidebar", "ad", "advertisement", "footer", "header", "cookie", "popup", "modal", "banner"]


def by_scan(page):
    """The words of the main content and the numbers of elements, by one pass over tags: each word with the elements it is in."""
    raw = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    opened, seen, words, n = [], [], [], 0
    skip = None
    for m in re.finditer(r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|([^<]+)", raw):
        end, tag, rest, text = m[1], (m[2] or "").lower(), m[3] or "", m[4]
        if skip:  # raw text of a script or style element
            if end and tag == skip:
                skip = None
                opened.pop()
            continue
        if text is not None:
            words.append((entities.unescape(text), [e for e in opened]))
        elif end:
            at = [i for i, e in enumerate(opened) if e[1] == tag]
            opened = opened[: at[-1]] if at else opened
        else:
            attributes = {k.lower(): v for k, v in re.findall(r'([\w-]+)\s*=\s*"([^"]*)"', rest)}
            if tag in ("p", "div", "article", "h1", "h2", "ul", "ol", "table"):
                inner = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][1] in ("p", "div", "article", "li", "td", "main", "section")), None)
                if inner is not None and opened[inner][1] == "p":
                    opened = opened[:inner]
            if tag == "li":
                inner = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][1] in ("li", "ul", "ol")), None)
                if inner is not None and opened[inner][1] == "li":
                    opened = opened[:inner]
            if tag == "body":
                opened = [e for e in opened if e[1] != "head"]
            n += 1
            marks = [attributes.get("class", "").lower(), attributes.get("id", "").lower()]
            bad = tag in ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript") or any(w in x for x in marks for w in NOISE)
            e = (n, tag, attributes, bad)
            seen.append((e, [*opened, e]))
            if tag not in ("br", "img", "meta", "link", "hr", "input"):
                opened = [*opened, e]
            if tag in ("script", "style"):
                skip = tag
    kept = [e for e, path in seen if not any(x[3] for x in path)]
    tests = [lambda e: e[1] == "main", lambda e: e[1] == "article", lambda e: "content" in e[2].get("class", "").split(), lambda e: "main" in e[2].get("class", "").split(), lambda e: e[2].get("id") == "content", lambda e: e[2].get("id") == "main", lambda e: e[1] == "body"]
    main = next((e for fits in tests for e in kept if fits(e)), None)
    text = " ".join(t for t, path in words if not any(x[3] for x in path) and (main is None or main in path))
    counts = dict.fromkeys(html_tree.COUNTS, 0)
    for e in kept:
        if e[1] in html_tree.COUNTED:
            counts[html_tree.COUNTED[e[1]]] += 1
    return re.findall(r"\w+", text), counts


def test_every_page_against_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r for r in html_tree.pages(rows).collect()}
    pages = {r.page_id: r.html for r in rows.collect()}
    assert len(got) == len(pages)
    for i, page in pages.items():
        words, counts = by_scan(page)
        assert re.findall(r"\w+", re.sub(r"\]\([^)]*\)", "]", got[i].text)) == words, page[:300]
        assert {c: got[i][c] for c in html_tree.COUNTS} == counts


def test_nested_and_unclosed_noise():
    page = '<body><div class="ad"><div>in<div>deeper</div></div>still ad</div><p>one<nav>x<ul><li>y</nav><p>two<div id="cookie-bar">open to the end'
    assert processed(page)["text"] == "one\n\ntwo"
    assert processed('<div class="headline">gone</div><p>kept')["text"] == "kept"  # "ad" is within headline
    assert processed("<body><aside>a<script>if (a < b) { '</p>' }</script></aside><p>b")["text"] == "b"


@pytest.mark.parametrize("page,text", [
    ("<main>m</main><article>a</article>", "m"), ("<body><div class='x content'>c</div><article>a</article>", "a"), ("<body>x<div class='x content'>c</div><div id=main>i</div>", "c"), ("<body>x<div id=content>i</div>", "i"), ("plain &amp; &lt;", "plain & <"), ("", ""), (None, ""), ("<p>a</i></b><p>b</", "a\n\nb</"), ("<div>" * 3000 + "deep", "deep"), ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>", "- a\n- b\n  1. c\n  2. d"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 | 2 |\n3 |"), ("<pre>a\n  b</pre>", "a\n  b"), ("<p>a <b>b</b> <a href='/x'>c</a> <a>d</a><img src=s alt=t>", "a **b** [c](/x) d![t](s)"), ("<h2>t</h2>x<br>y", "## t\n\nx  \ny"),
])
def test_main_content_as_markdown(page, text):
    assert re.sub(r"[ ]+\n", lambda m: m[0] if m[0] == "  \n" else "\n", processed(page)["text"]) == text


def test_metadata():
    page = '<head><title> T &amp; t </title><title>second</title><meta name="og:Description" content="d1"><meta name=description content=d2><meta property="article:published_time" content="2020"><meta name="author"><meta name=x content=y></head>'
    got = processed(page)
    assert {k: got[k] for k in ("title", "description", "author", "keywords", "date")} == {"title": "T & t", "description": "d2", "author": "", "keywords": "", "date": "2020"}


def test_pages_of_any_key(spark):
    df = spark.createDataFrame([("a", "<p>x", 1), (None, None, 2)], "page_id string, html string, text int")
    assert sorted((str(r.page_id), r.text, r.paragraphs) for r in html_tree.pages(df).collect()) == [("None", "", 0), ("a", "x", 1)]
    assert html_tree.pages(df.limit(0)).count() == 0
