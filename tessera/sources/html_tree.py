"""HTML pages as trees of elements: metadata, structure, and the main content as Markdown, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.sources.html import FURNITURE

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Open elements that a start tag ends, and the elements that it doesn't look beyond.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_ENDS |= {b: ({"p"}, {"button", "td", "th", "table", "li", "div", "article", "section", "main", "blockquote"}) for b in _BLOCKS}
COUNTED = {"h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "h5": "h5", "h6": "h6", "p": "paragraphs", "ul": "lists", "ol": "lists", "table": "tables", "a": "links", "img": "images"}
COUNTS = list(dict.fromkeys(COUNTED.values()))
META = ("description", "author", "keywords", "date")


class Element:
    """A tag, its attributes and what it holds: elements and texts."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self) -> Iterator[Element]:
        """This element and all below, in the order of the page, without recursion."""
        left = [self]
        while left:
            x = left.pop()
            yield x
            left += [c for c in reversed(x.children) if isinstance(c, Element)]

    def text(self) -> str:
        out, left = [], [self]
        while left:
            x = left.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                left += reversed(x.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended, beyond = _ENDS.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in beyond:
                break
            if self.open[i].tag in ended:
                del self.open[i:]
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Element:
    """The page's elements under one without a name. Void elements hold nothing; paragraphs, items, rows and cells end where the next begins;
    an end tag ends what is open within its element, and is left out if that isn't open; what stays open ends with the page."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _noise(e: Element) -> bool:
    marks = (e.attributes.get("class", "").lower(), e.attributes.get("id", "").lower())
    return e.tag in FURNITURE or any(w in m for m in marks for w in fixed.ELEMENT_NOISE)


def cleaned(root: Element) -> Element:
    """The tree without furniture, with all that it holds, and without elements whose class or id has a fragment of furniture."""
    for e in root.walk():
        e.children = [c for c in e.children if isinstance(c, str) or not _noise(c)]
    return root


def main_content(root: Element) -> Element:
    """The first main element, else the first article, else the first of class content or main, of id content or main, else the body, else all."""
    classes = lambda e: e.attributes.get("class", "").split()
    named = lambda e: e.attributes.get("id")
    wanted = (lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: "content" in classes(e), lambda e: "main" in classes(e), lambda e: named(e) == "content", lambda e: named(e) == "main", lambda e: e.tag == "body")
    found: list[Element | None] = [None] * len(wanted)
    for e in root.walk():
        for i, fits in enumerate(wanted):
            if found[i] is None and fits(e):
                found[i] = e
    return next((e for e in found if e is not None), root)


#: What stands before and behind an element's content; "\n\n" parts blocks.
_MARKS = {f"h{i}": ("\n\n" + "#" * i + " ", "\n\n") for i in range(1, 7)} | {"b": ("**", "**"), "strong": ("**", "**"), "i": ("_", "_"), "em": ("_", "_"), "code": ("`", "`"), "br": ("  \n", ""), "hr": ("\n\n* * *\n\n", ""), "tr": ("\n", ""), "td": ("", " | "), "th": ("", " | "), "blockquote": ("\n\n> ", "\n\n"), "title": ("", "\n\n")}
_MARKS |= {b: ("\n\n", "\n\n") for b in _BLOCKS - set(_MARKS)}


def markdown(e: Element) -> str:
    """Headings, paragraphs, lists, emphasis, links, images and table cells as Markdown; white space is made single, blocks are parted by one empty line."""
    out: list[str] = []
    left: list[tuple] = [(e, None)]
    lists: list[list] = []  # of each open list: whether it is numbered, and its items so far
    while left:
        x, parent = left.pop()
        if isinstance(x, tuple):  # the end of an element
            what, mark = x
            if what in ("ul", "ol"):
                lists.pop()
            out.append(mark)
        elif isinstance(x, str):
            out.append(x if parent == "pre" else re.sub(r"\s+", " ", x))
        else:
            before, behind = _MARKS.get(x.tag, ("", ""))
            if x.tag in ("ul", "ol"):
                lists.append([x.tag == "ol", 0])
                before = behind = "" if len(lists) > 1 else "\n\n"
            elif x.tag == "li":
                numbered = lists[-1] if lists else [False, 0]
                numbered[1] += 1
                before = "\n" + "  " * max(len(lists) - 1, 0) + (f"{numbered[1]}. " if numbered[0] else "- ")
            elif x.tag == "a" and x.attributes.get("href"):
                before, behind = "[", f"]({x.attributes['href']})"
            elif x.tag == "img":
                before = f"![{x.attributes.get('alt', '')}]({x.attributes.get('src', '')})"
            out.append(before)
            left.append(((x.tag, behind), None))
            left += [(c, x.tag) for c in reversed(x.children)]
    text = re.sub(r" *\n *(?=\n)|(?<=\n)[ ]+(?=\n)", "\n", "".join(out))
    text = re.sub(r"(?<=\n\n) +", "", re.sub(r"\n{3,}", "\n\n", text))
    return re.sub(r"[ \t]+(?=\n\n|$)", "", re.sub(r"\n{3,}", "\n\n", text)).strip()


def metadata(root: Element) -> dict[str, str]:
    """title of the first title element; of meta tags by fragments of their name or property description, author, keywords and date (or published), the last of each."""
    out = dict.fromkeys(("title", *META), "")
    titled = False
    for e in root.walk():
        if e.tag == "title" and not titled:
            out["title"], titled = e.text().strip(), True
        elif e.tag == "meta":
            name, content = e.attributes.get("name", e.attributes.get("property", "")).lower(), e.attributes.get("content", "")
            kind = next((k for k in META if k in name or k == "date" and "published" in name), None)
            if kind and name and content:
                out[kind] = content
    return out


def processed(html: str | None) -> dict:
    root = tree(html or "")
    out = metadata(root)
    cleaned(root)
    out |= dict.fromkeys(COUNTS, 0)
    for e in root.walk():
        if e.tag in COUNTED:
            out[COUNTED[e.tag]] += 1
    return out | {"text": markdown(main_content(root))}


def pages(rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, description, author, keywords, date, the counts of COUNTS after cleaning, text (Markdown) of each page; a null page is an empty one."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            yield pd.DataFrame([{key: k} | processed(h) for k, h in zip(f[key], f[html], strict=True)], columns=[key, "title", *META, *COUNTS, "text"])

    return rows.select(key, F.col(html)).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} string" for c in ("title", *META)) + ", " + ", ".join(f"{c} long" for c in COUNTS) + ", text string")
