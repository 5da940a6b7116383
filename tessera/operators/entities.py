"""Joining, merging and writing entities, mentions and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import dealt

IMPORTANCE = {"high": 3, "medium": 2, "low": 1}


def importance_rank(column: str = "importance"):
    return F.when(F.col(column) == "high", 3).when(F.col(column) == "medium", 2).otherwise(1)


def cooccurrence(mentions: DataFrame, least: int = 2, rows: int = 0) -> DataFrame:
    """a < b, frequency, confidence min(1, frequency / 10): entities that share at least `least` chunks. `rows`: about how many pairs there are in all chunks, by which they are dealt to tasks."""
    left, right = mentions.select("chunk_id", F.col("entity").alias("a")).distinct(), mentions.select("chunk_id", F.col("entity").alias("b")).distinct()
    pairs = dealt(left.join(right, "chunk_id").where("a < b").select("a", "b"), rows, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("frequency"))
    return pairs.where(F.col("frequency") >= least).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("frequency") / 10), 6))


def near_pairs(spans: DataFrame, window: int = 100) -> DataFrame:
    """Pairs of spans (doc_id, entity, start, upto) where the second starts within `window` characters behind the first's end.

    Spans meet by document and bin of `window` characters, so a long document is no single join key.
    """
    right = spans.select("doc_id", F.col("entity").alias("target"), F.col("start").alias("t_start"), (F.col("start") / window).cast("long").alias("bin"))
    left = spans.withColumn("low", (F.col("upto") / window).cast("long")).select("doc_id", F.col("entity").alias("source"), "upto", F.explode(F.array("low", F.col("low") + 1)).alias("bin"))
    pairs = left.join(right, ["doc_id", "bin"]).withColumn("gap", F.col("t_start") - F.col("upto")).where((F.col("gap") >= 0) & (F.col("gap") <= window) & (F.col("source") != F.col("target")))
    return pairs.select("doc_id", "source", "target", "gap", F.round(F.greatest(F.lit(0.3), 1 - F.col("gap") / window), 6).alias("confidence"))


def merged_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by name: greatest confidence, longest description, all documents, greatest importance."""
    rows = old.unionByName(new)
    longest = F.min_by("description", F.struct(-F.length("description"), F.col("description")))
    rank = F.max(importance_rank())
    return rows.groupBy("name").agg(F.max("confidence").alias("confidence"), longest.alias("description"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("documents")))), ",").alias("documents"), F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low").alias("importance"))


def without_document(rows: DataFrame, document: str) -> DataFrame:
    """Entities after a document is deleted: it leaves their lists, and those of no other document go."""
    return rows.withColumn("documents", F.array_remove("documents", document)).where(F.size("documents") > 0)


def remapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after entities were merged: ends follow mapping (old, new), loops go, equal edges add up."""
    m = lambda c: mapping.select(F.col("old").alias(c), F.col("new").alias(f"n_{c}"))
    rows = edges.join(m("a"), "a", "left").join(m("b"), "b", "left").select(F.coalesce("n_a", "a").alias("a"), F.coalesce("n_b", "b").alias("b"), "weight")
    return rows.where("a != b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def ensemble(found: DataFrame, least: float = 0.4) -> DataFrame:
    """key, sources, frequency, confidence: extractors' findings (key, source, confidence) merged and calibrated, up to 0.98."""
    per = found.groupBy("key").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("frequency"), F.max("confidence").alias("c"), F.max((F.col("source") == "llm").cast("int")).alias("llm"))
    raised = F.col("c") + F.when(F.col("sources") >= 3, 0.15).when(F.col("sources") == 2, 0.10).otherwise(0.0) + F.when(F.col("frequency") >= 3, 0.10).when(F.col("frequency") == 2, 0.05).otherwise(0.0) + F.when(F.col("llm") == 1, 0.05).otherwise(0.0)
    return per.select("key", "sources", "frequency", F.round(F.least(F.lit(0.98), raised), 6).alias("confidence")).where(F.col("confidence") >= least)


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
