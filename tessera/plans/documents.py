"""Queries that cut documents into chunks and read pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking
from tessera.sources import html, html_tree
from tessera.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def chunk_token(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.token_chunks(_docs(spark, sf))
    return rows.select("doc_id", "chunk_index", "tokens", chunking.chunk_id("chunk_index", "text").alias("chunk_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sentence_chunks(_docs(spark, sf)).select("doc_id", "chunk_index", "sentences", F.md5(F.col("text").cast("binary")).alias("digest"))


def chunk_stride(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.stride_chunks(_docs(spark, sf)).select("doc_id", "chunk_index", "start_char", F.md5(F.col("text").cast("binary")).alias("digest"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sections(_docs(spark, sf)).select("doc_id", "section", "lines", "characters")


def splitters(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.size(text.sentences("text")).cast("long").alias("sentences"), F.size(F.split("text", "\n\n")).cast("long").alias("paragraphs"), F.size(text.words("text")).cast("long").alias("words"))


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Number and mean length of each document's stride chunks."""
    rows = chunking.stride_chunks(_docs(spark, sf))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.length("text")), 6).alias("mean"))


def _cut(strategy):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return chunking.chunks(_docs(spark, sf), strategy)

    return run


def chunk_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut by the strategy of its content's type: sources stand in turn for videos, web pages, PDF files and policies."""
    kinds = list(chunking.BY_CONTENT)
    kind = F.get(F.array(*map(F.lit, kinds)), (F.pmod(F.xxhash64("source"), F.lit(len(kinds)))).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", "text", kind.alias("kind"))
    parts = [chunking.chunks(docs.where(F.col("kind") == k).select("doc_id", "text"), k).withColumn("kind", F.lit(k)) for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def html_meta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.title("html").alias("title"), html.meta("html", "description").alias("description"))


def html_structure(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", *html.counts("html"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    out = html.main_text("html")
    return table(spark, sf, "pages").select("page_id", F.length(out).cast("long").alias("length"), F.md5(out.cast("binary")).alias("digest"))


def html_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every page through its tree of elements: what its head says of it, the elements left after cleaning, and its main content as Markdown."""
    return html_tree.pages(table(spark, sf, "pages")).withColumn("digest", F.md5(F.col("text").cast("binary")))


QUERIES = {f.__name__: f for f in (chunk_token, chunk_sentences, chunk_stride, sections, splitters, chunk_stats, html_meta, html_structure, html_text, html_markdown, chunk_by_content)} | {f"chunk_{s}": _cut(s) for s in ("blanks", "recursive", "packed", "semantic", "late")}

_WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"
_SENT = "list_filter(string_split(regexp_replace(text, '([.!?؟])\\s+', '\\1\u241e', 'g'), '\u241e'), lambda s: trim(s, e' \\t\\n') <> '')"
_STARTS = "CASE WHEN {n} > 0 THEN range(0, greatest({n} - {overlap} - 1, 0) + 1, {step}) ELSE [] END"


def _windows(items: str, size: int, overlap: int) -> str:
    return f"WITH w AS (SELECT doc_id, {items} AS w FROM documents), s AS (SELECT doc_id, w, unnest({_STARTS.format(n='len(w)', overlap=overlap, step=size - overlap)}) AS i FROM w), c AS (SELECT doc_id, i // {size - overlap} AS chunk_index, w[i + 1:i + {size}] AS c FROM s)"


_STRIDE = f"WITH s AS (SELECT doc_id, text, unnest({_STARTS.format(n='length(text)', overlap=200, step=800)}) AS i FROM documents), c AS (SELECT doc_id, i // 800 AS chunk_index, i AS start_char, substr(text, i + 1, 1000) AS c FROM s)"
_CLEAN = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _t in html.FURNITURE:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}[ >].*?</{_t}>', ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?is)<div (?:class|id)=\"[^\"]*(?:{'|'.join(html.fixed.PAGE_NOISE)})[^\"]*\">.*?</div>', ' ', 'g')"

ORACLE_SQL = {
    "chunk_token": f"{_windows(_WORDS, 600, 50)} SELECT doc_id, chunk_index, len(c) AS tokens, substr(md5(chunk_index || ':' || substr(array_to_string(c, ' '), 1, 100)), 1, 12) AS chunk_id, md5(array_to_string(c, ' ')) AS digest FROM c",
    "chunk_sentences": f"{_windows(_SENT, 5, 1)} SELECT doc_id, chunk_index, len(c) AS sentences, md5(array_to_string(c, ' ')) AS digest FROM c",
    "chunk_stride": f"{_STRIDE} SELECT doc_id, chunk_index, start_char, md5(c) AS digest FROM c",
    "sections": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), h AS (SELECT *, sum(CAST(regexp_matches(line, '^(?:Section \\d+:|\\d+(?:\\.\\d+)* [A-Z]|[A-Z][A-Z !]{3,}$)') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM h GROUP BY ALL",
    "splitters": f"SELECT doc_id, len({_SENT}) AS sentences, len(string_split(text, chr(10) || chr(10))) AS paragraphs, len({_WORDS}) AS words FROM documents",
    "chunk_stats": f"{_STRIDE} SELECT doc_id, count(*) AS chunks, round(avg(length(c)), 6) AS mean FROM c GROUP BY doc_id",
    "html_meta": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<meta name=\"description\" content=\"([^\"]*)\"', 1) AS description FROM pages",
    "html_structure": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[ >]')) AS n_{t}" for t in html.STRUCTURE) + " FROM pages",
    "html_text": f"WITH c AS (SELECT page_id, {_CLEAN} AS h FROM pages), p AS (SELECT page_id, CASE WHEN regexp_extract(h, '(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1) <> '' THEN regexp_extract(h, '(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1) ELSE regexp_extract(h, '(?is)<body[^>]*>(.*)', 1) END AS p FROM c), t AS (SELECT page_id, trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM p) SELECT page_id, length(t) AS length, md5(t) AS digest FROM t",
}
