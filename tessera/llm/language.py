"""Language identification by Bayesian fusion of evidence.

Text likelihoods of a trigram model are combined with the language that the markup declares, the country suffix of the
address, and priors of the host, smoothed by its domain, that by its suffix, and that by all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BUCKETS = 1 << 15
#: Labelled documents of each language that the text model is fitted on: those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 400
#: Trigrams after which a text's evidence stops growing, as neighbouring trigrams tell the same.
EFFECTIVE_TRIGRAMS = 50.0
#: Rows that a level of the host's hierarchy weighs against the rows below it.
SMOOTHING = 10.0
#: Prior of a text in none of the languages; chance that a declaration or a country suffix is right.
UNKNOWN_PRIOR, DECLARED_RIGHT, SUFFIX_RIGHT = 0.01, 0.9, 0.8
#: Country suffixes that go with a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Share of a language's trigrams that the model takes to be anything, so that unseen ones don't outweigh the rest.
UNSEEN = 0.2
_SALTS = 16
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class TextModel:
    """log_p: the log probability of each trigram bucket in each language, beside that of no language."""

    log_p: np.ndarray

    def mean(self, text: str) -> tuple[int, np.ndarray]:
        """Trigrams around a letter, and their mean log probability by language."""
        h = trigrams(text)
        return len(h), self.log_p[h].mean(axis=0) if len(h) else np.zeros(self.log_p.shape[1])


def trigrams(text: str) -> np.ndarray:
    data = np.frombuffer(b" " + text.lower().encode().translate(_TO_SPACE) + b" ", dtype=np.uint8).astype(np.uint32)
    h = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1]) * np.uint32(0x85EBCA6B) + data[2:]
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17))[data[1:-1] != 32].astype(np.int64)


def fit(rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> TextModel:
    """From (text, language) rows. A language without rows is as likely as no language at all."""
    counts = np.zeros((BUCKETS, len(languages)))
    for text, language in rows:
        np.add.at(counts[:, languages.index(language)], trigrams(text), 1)
    p = (counts + 0.02) / (counts.sum(axis=0) + 0.02 * BUCKETS)
    log_p = np.log((1 - UNSEEN) * p + UNSEEN / BUCKETS)
    return TextModel(np.column_stack([log_p, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32))


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, per_language: int = SAMPLE_PER_LANGUAGE) -> TextModel:
    """Fit on at most per_language documents of each language, of those with an id; the bounded ids are sent to the scan for their texts."""
    known = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("lang").alias("label")).where("label_id is not null").where(F.col("label").isin(*languages))
    chosen = [r for c in languages for r in known.where(F.col("label") == c).orderBy(F.xxhash64("label_id"), "label_id").limit(per_language).collect()]
    if not chosen:
        return fit([], languages)
    sample = F.broadcast(docs.sparkSession.createDataFrame(sorted(set(chosen)), "label_id long, label string"))
    own = docs.select("doc_id", "text", "lang")  # whatever other columns are called
    rows = own.join(sample, (F.col("doc_id") == F.col("label_id")) & (F.col("lang") == F.col("label"))).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return fit([(r.text or "", r.label) for r in rows.collect()], languages)


def evidence(rows: DataFrame, model: TextModel, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """rows (text, host, declared and whatever else identifies them, in a struct `row`) with trigrams, likelihood (array by language, last: none) in place of the text."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [held.value.mean(t.as_py() or "") for t in b.column("text")]
            n = pa.array([x for x, _ in found], type=pa.int64())
            means = pa.array([m.astype(np.float64) for _, m in found], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "host", "declared")), n, means], names=["row", "host", "declared", "trigrams", "likelihood"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.select("row", F.coalesce("host", F.lit("")).alias("host"), "declared", F.col("text").cast("string").alias("text"))
    return out.mapInArrow(run, f"row {kind}, host string, declared string, trigrams long, likelihood array<double>")


def _share(own: list[Column], above: list[Column]) -> list[Column]:
    """Smoothed shares of counts, weighing SMOOTHING rows of the level above."""
    total = sum(own[1:], own[0])
    return [(c + F.lit(SMOOTHING) * a) / (total + F.lit(SMOOTHING)) for c, a in zip(own, above, strict=True)]


def _vote(languages: tuple[str, ...]) -> Column:
    """The place, from 1, of the language that a text's own trigrams favour."""
    own = F.slice("likelihood", 1, len(languages))
    return F.array_position(own, F.array_max(own))


def host_counts(scored: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> tuple[DataFrame, list[int]]:
    """host, and in h, d and s the texts by own language of the host, its domain and its suffix (arrays by language); and those of all rows."""
    k = range(len(languages))
    votes = scored.where("trigrams > 0").select("host", _vote(languages).alias("best"))
    parts = F.split("host", r"\.")
    hosts = votes.groupBy("host").agg(*(F.sum((F.col("best") == i + 1).cast("long")).alias(f"h{i}") for i in k))
    hosts = hosts.withColumn("domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host"))).withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("")))
    domains = hosts.groupBy("domain", "suffix").agg(*(F.sum(f"h{i}").alias(f"d{i}") for i in k))
    suffixes = domains.groupBy("suffix").agg(*(F.sum(f"d{i}").alias(f"s{i}") for i in k))
    totals = suffixes.agg(*(F.sum(f"s{i}").alias(f"a{i}") for i in k)).first()
    level = hosts.join(domains.drop("suffix"), "domain").join(suffixes, "suffix")
    return level.select("host", *(F.array(*(F.col(f"{x}{i}") for i in k)).alias(x) for x in "hds")), [x or 0 for x in totals]


def _prior(totals: list[int], languages: tuple[str, ...]) -> list[Column]:
    """Smoothed shares of host_counts() beside a row, whose own vote is taken out of all levels first: it is evidence already."""
    k = range(len(languages))
    own = [(F.col("vote") == i + 1).cast("int") for i in k]
    total = F.lit(sum(totals) + len(languages)) - (F.col("vote") > 0).cast("int")
    shares = [(F.lit(totals[i] + 1) - own[i]) / total for i in k]
    for level in "sdh":
        shares = _share([F.coalesce(F.col(level)[i], F.lit(0)) - F.when(F.col(level).isNotNull(), own[i]).otherwise(0) for i in k], shares)
    return shares


def fused(scored: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """row, language, confidence, text_language, accepted. `scored` is read twice, so it should be a stored table.

    A text without letters is 'und' and not accepted; so is one for which no language, with all evidence, is likelier than none.
    Null or unknown declarations and suffixes say nothing; known ones are as likely in any language for a text in none. Host rows are salted for the join, so no host's rows meet in one task.
    """
    n = len(languages)
    counts, totals = host_counts(scored, languages)
    priors = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumnRenamed("host", "prior_host")
    vote = F.when(F.col("trigrams") > 0, _vote(languages)).otherwise(0).cast("int")
    left = scored.withColumn("vote", vote).withColumn("salt", F.pmod(F.xxhash64("row", "likelihood"), F.lit(_SALTS)).cast("int"))
    rows = left.join(priors, (left.salt == priors.salt) & (F.col("host") == F.col("prior_host")), "left")
    rows = rows.withColumn("prior", F.array(*_prior(totals, languages)))
    declared = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]{2,3})", 1))
    suffix = F.element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), F.element_at(F.split("host", r"\."), -1))
    weight = F.col("trigrams") / (1 + F.col("trigrams") / F.lit(EFFECTIVE_TRIGRAMS))

    def told(said: Column, language: str, right: float) -> Column:
        wrong = (1 - right) / max(1, n - 1)
        return F.when(said.isin(*languages), F.log(F.when(said == language, F.lit(right)).otherwise(F.lit(wrong)))).otherwise(F.lit(0.0))

    logs = [F.log((1 - UNKNOWN_PRIOR) * F.col("prior")[i]) + weight * F.col("likelihood")[i] + told(declared, c, DECLARED_RIGHT) + told(suffix, c, SUFFIX_RIGHT) for i, c in enumerate(languages)]
    any_of = lambda said: F.when(said.isin(*languages), F.lit(float(-np.log(n)))).otherwise(F.lit(0.0))
    logs.append(F.lit(float(np.log(UNKNOWN_PRIOR))) + weight * F.col("likelihood")[n] + any_of(declared) + any_of(suffix))
    rows = rows.withColumn("logs", F.array(*logs))
    rows = rows.withColumn("odds", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    names = F.array(*map(F.lit, (*languages, UNKNOWN)))
    best = F.when(F.col("trigrams") > 0, F.array_position("odds", F.array_max("odds"))).otherwise(F.lit(n + 1)).cast("int")
    text_best = F.when(F.col("trigrams") > 0, F.array_position("likelihood", F.array_max("likelihood"))).otherwise(F.lit(n + 1)).cast("int")
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return rows.select("row", F.element_at(names, best).alias("language"), F.when(F.col("trigrams") > 0, F.array_max("odds") / total).otherwise(F.lit(1.0)).alias("confidence"), F.element_at(names, text_best).alias("text_language"), (best <= n).alias("accepted"))


def declared_in(markup: Column) -> Column:
    """The language that an html element declares, or null."""
    found = F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.when(found != "", found)


def documents_identified(docs: DataFrame, model: TextModel) -> DataFrame:
    """doc_id, text_key, source, language, confidence, text_language, accepted of each row; a document's source stands for its host."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").cast("string").alias("source"))
    rows = docs.select(row.alias("row"), F.col("source").cast("string").alias("host"), declared_in(F.col("text")).alias("declared"), "text")
    return fused(stored(evidence(rows, model), "evidence")).select("row.*", "language", "confidence", "text_language", "accepted")


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")


def pages_identified(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, language, confidence, text_language, accepted of each row; null pages and addresses say nothing."""
    row = F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(row.alias("row"), host.alias("host"), declared_in(F.col("html")).alias("declared"), visible(F.coalesce("html", F.lit(""))).alias("text"))
    return fused(stored(evidence(rows, model), "evidence")).select("row.*", "language", "confidence", "text_language", "accepted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return documents_identified(docs, train(docs)).select("doc_id", "language", F.round("confidence", 9).alias("confidence"), "text_language", "accepted")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(table(spark, sf_dir, "documents"))
    return pages_identified(table(spark, sf_dir, "pages"), model).select("page_id", "language", F.round("confidence", 9).alias("confidence"), "text_language", "accepted")
