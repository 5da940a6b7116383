"""Source divergence audit: how far the word use of each language's sources lies apart, and by which terms."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import byte_pieces, shuffle_parts, stored, table

#: Documents of its language that a kept term is in at least.
LEAST_DOCUMENTS = 30
#: What is added to each count, the parts that a share is told in, and the terms told of each group.
SMOOTHING, SCALE, TOP = 5, 1_000_000_000, 50
#: Distinct terms that a task holds before it sends their counts on.
HELD_TERMS = 300_000
#: Bytes of a term: letters (A-Z become a-z) and all beyond ASCII; the others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, documents long"


def _counted(batches):
    def told():
        rows = [(lang, source, term, n, within[lang, source][term]) for (lang, source), terms in found.items() for term, n in terms.items()]
        lang, source, term, n, documents = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(documents, pa.int64())], names=["lang", "source", "term", "n", "documents"])

    found, within, held = {}, {}, 0  # by group: occurrences and documents of each term
    for b in batches:
        for lang, source, data in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("data"), strict=True):
            terms, own = found.setdefault((lang, source), Counter()), set()
            held -= len(terms)
            for piece in byte_pieces(data.as_py().translate(_BYTES)):
                words = piece.split()
                terms.update(words)
                own.update(words)
            within.setdefault((lang, source), Counter()).update(own)
            held += len(terms)
            if held > HELD_TERMS:
                yield told()
                found, within, held = {}, {}, 0
    if held:
        yield told()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, documents of the language it is in, by_source: entries (source, n). One shuffle, of counts that tasks have already added up."""
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("data")).mapInArrow(_counted, _COUNTS)
    per = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return per.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("by_source"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total) for 0 <= count <= total, in three steps of a thousand: exact up to totals of 9e15."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.floor((rest - rest % total) / total).cast("long")
        rest = rest % total
    return out + 1


def _sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each language: its sources (source, total of kept occurrences) in order, its kept terms and their occurrences. Sources without terms are there too."""
    totals = kept.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").groupBy("lang")
    per = groups.agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"), F.coalesce(F.sum("total"), F.lit(0)).alias("all"))
    return per.join(terms, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) of documents (text, lang, source) its distance from each other source of the language
    (part pair), and the `top` kept terms that it uses more than the language does (part term).

    Each kept term is pivoted into an array with a place for every source of its language; higher-order functions emit the array's
    contributions to the pairs of sources, which are summed in the map tasks first. An array is as wide as a language has sources.
    Null texts, languages and sources count as ''; repeated rows are documents of their own; a language without kept terms has pairs
    of value 0; an empty table gives an empty result; other columns are left behind.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = stored(term_counts(docs).where(F.col("documents") >= least_documents).drop("documents"), "kept-terms")
    langs = stored(_sources(docs, kept), "sources")
    # a language's row meets its terms in as many places as there are partitions: a hot language is dealt out
    n = shuffle_parts(spark)
    salt = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("salt"), "term", F.map_from_entries("by_source").alias("by_source")).join(langs.select("*", salt), ["lang", "salt"])
    counts = F.transform("sources", lambda s: F.coalesce(F.element_at("by_source", s.source), F.lit(0)))
    floor = F.col("n_terms") * SMOOTHING
    wide = terms.withColumn("counts", counts).select(
        "lang", "term", "sources", "counts",
        F.zip_with("counts", "sources", lambda c, s: share(c + SMOOTHING, s.total + floor)).alias("shares"),
        share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c) + SMOOTHING, F.col("all") + floor).alias("own"),
    )

    each = wide.select("lang", "shares", F.posexplode("shares").alias("i", "x"))
    emitted = F.transform(F.slice("shares", F.col("i") + 2, F.size("shares")), lambda y, k: F.struct((F.col("i") + 1 + k).alias("j"), F.abs(F.col("x") - y).alias("far")))
    sums = each.select("lang", "i", F.inline(emitted)).groupBy("lang", "i", "j").agg(F.sum("far").alias("far"))
    every = langs.select("lang", "sources", F.posexplode("sources").alias("a", "s")).select("lang", "a", F.col("s.source").alias("source"), F.posexplode("sources").alias("b", "t")).where("a != b")
    pairs = every.select("lang", "source", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.col("t.source").alias("item")).join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("far", F.lit(0)).alias("value"))

    above = F.filter(F.transform(F.arrays_zip("sources", "counts", "shares"), lambda z: F.struct(z.sources.source.alias("source"), z.counts.alias("n"), (z.shares - F.col("own")).alias("value"))), lambda z: (z.n > 0) & (z.value > 0))
    told = wide.select("lang", "term", F.inline(above)).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(w))
    return ranked(pairs).unionByName(ranked(told).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT lang, source, id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {_LETTERS}) AS term FROM d),
  k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
  g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
  gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL), lt AS (SELECT lang, sum(total)::HUGEINT AS total FROM gt GROUP BY lang),
  p AS (SELECT gt.lang, gt.source, k.term, coalesce(n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTHING}) // (total + {SMOOTHING} * v) AS p FROM gt JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
  q AS (SELECT lang, term, 1 + {SCALE}::HUGEINT * (sum(n)::HUGEINT + {SMOOTHING}) // (any_value(lt.total) + {SMOOTHING} * any_value(v)) AS q FROM p JOIN lt USING (lang) JOIN v USING (lang) GROUP BY lang, term),
  s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL),
  u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source != y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
