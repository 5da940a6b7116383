"""HTML pages: metadata, structure and main text, with string functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed

#: Elements that hold no content of the page.
FURNITURE = ["script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"]
STRUCTURE = ["h1", "h2", "h3", "p", "ul", "ol", "table", "a", "img"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html: Column | str, name: str) -> Column:
    return F.regexp_extract(_c(html), rf"(?i)<meta name=\"{name}\" content=\"([^\"]*)\"", 1)


def counts(html: Column | str) -> list[Column]:
    """How often each structural element opens."""
    return [F.regexp_count(_c(html), F.lit(rf"(?i)<{t}[ >]")).cast("long").alias(f"n_{t}") for t in STRUCTURE]


def without_furniture(html: Column | str) -> Column:
    """Comments, furniture elements and blocks whose class or id holds a noise word go."""
    out = F.regexp_replace(_c(html), r"(?s)<!--.*?-->", " ")
    for t in FURNITURE:
        out = F.regexp_replace(out, rf"(?is)<{t}[ >].*?</{t}>", " ")
    return F.regexp_replace(out, rf"(?is)<div (?:class|id)=\"[^\"]*(?:{'|'.join(fixed.PAGE_NOISE)})[^\"]*\">.*?</div>", " ")


def main_text(html: Column | str) -> Column:
    """The text of the first main or article element, else of the body, without tags; white space made single."""
    clean = without_furniture(html)
    article = F.regexp_extract(clean, r"(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>", 1)
    body = F.regexp_extract(clean, r"(?is)<body[^>]*>(.*)", 1)
    part = F.when(article != "", article).otherwise(body)
    return F.trim(F.regexp_replace(F.regexp_replace(part, r"<[^>]*>", " "), r"\s+", " "))
