"""Fusing, reranking and diversifying ranked lists: columns query_id, list, chunk_id, document_id, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranks(lists: DataFrame) -> DataFrame:
    """rank within each query's list, best score first, ties by chunk."""
    w = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "chunk_id")
    return lists.withColumn("rank", F.row_number().over(w).cast("long"))


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.element_at(table, key), F.lit(default))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of w / (k + rank), weights brought to sum 1 (none: each 1); carries the best original score."""
    if weights is None:
        share: Column = F.lit(1.0)
    else:
        total = sum(weights.values())
        share = lookup({n: w / total for n, w in weights.items()}, F.col("list"), 0.0)
    rows = ranks(lists).withColumn("part", share / (k + F.col("rank")))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("fused"), F.max("score").alias("best"), F.count(F.lit(1)).alias("lists"))


def weighted(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The sum of w * score, raised by a tenth for each further list that has the chunk."""
    rows = lists.withColumn("part", lookup(weights, F.col("list"), 0.0) * F.col("score"))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part") * (1 + 0.1 * (F.count(F.lit(1)) - 1)), 6).alias("fused"), F.count(F.lit(1)).alias("lists"))


def interleaved(lists: DataFrame, order: list[str]) -> DataFrame:
    """Round robin over the lists in the given order; a chunk counts where it is seen first. Returns position."""
    at = ranks(lists).withColumn("turn", F.array_position(F.array(*map(F.lit, order)), F.col("list")))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "turn")
    once = at.withColumn("n", F.row_number().over(first)).where("n = 1")
    w = Window.partitionBy("query_id").orderBy("rank", "turn")
    return once.select("query_id", "chunk_id", "list", F.row_number().over(w).cast("long").alias("position"))


def best_per_chunk(lists: DataFrame) -> DataFrame:
    """Duplicates of a chunk: the highest score stays, and the list it came from (first by name on ties)."""
    return lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min_by("list", F.struct(-F.col("score"), F.col("list"))).alias("list"))


def mixed(first: DataFrame, second: DataFrame, least: float) -> DataFrame:
    """All of the first list, and of the second what scores at least `least` and isn't there yet."""
    rows = first.withColumn("turn", F.lit(0)).unionByName(second.where(F.col("score") >= least).withColumn("turn", F.lit(1)))
    w = Window.partitionBy("query_id", "chunk_id").orderBy("turn", F.desc("score"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "chunk_id", "list", "score")


def dual(low: DataFrame, high: DataFrame, w_low: float, w_high: float) -> DataFrame:
    """Two levels, each with its weight; a chunk of both counts with the low level's score."""
    rows = low.withColumn("turn", F.lit(0)).withColumn("fused", F.col("score") * w_low).unionByName(high.withColumn("turn", F.lit(1)).withColumn("fused", F.col("score") * w_high))
    w = Window.partitionBy("query_id", "chunk_id").orderBy("turn", F.desc("fused"))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "chunk_id", F.round("fused", 6).alias("fused"))


def unified(lists: DataFrame) -> DataFrame:
    """The best score of each chunk, and its lists' names joined by +."""
    return lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("list")), "+").alias("sources"))


def round_robin_sources(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query, taking documents in turn; documents come in the order of their best row."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    placed = rows.withColumn("pos", F.row_number().over(by_score))
    of_document = Window.partitionBy("query_id", "document_id")
    placed = placed.withColumn("turn", F.row_number().over(of_document.orderBy("pos"))).withColumn("first", F.min("pos").over(of_document))
    w = Window.partitionBy("query_id").orderBy("turn", "first")
    return placed.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= k).select("query_id", "document_id", "chunk_id", "position")


def term_boost(score: Column, text: Column, terms: list[str], factor: float = 0.05, most: int = 2, cap: float = 0.98) -> Column:
    """The score raised by `factor` for each term in the text, at most `most` of them, up to `cap`."""
    found = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))
    return F.least(F.lit(cap), score + F.lit(factor) * F.least(found, F.lit(most)))


def keyword_order(score: Column, text: Column, terms: list[str]) -> Column:
    """What to sort by: the score raised by 0.3 a term, 0.5 at most."""
    found = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))
    return score + F.least(F.lit(0.3) * found, F.lit(0.5))


def reranked(rows: DataFrame, new_score: Column, k: int, threshold: float = -100.0) -> DataFrame:
    """Old and new rank of each row by `score` and by new_score (null: the old score), and the change; the first k."""
    scored = rows.withColumn("new_score", F.coalesce(new_score, F.col("score"))).where(F.col("new_score") >= threshold)
    old = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    new = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "chunk_id")
    scored = scored.withColumn("old_rank", F.row_number().over(old).cast("long")).withColumn("new_rank", F.row_number().over(new).cast("long"))
    return scored.where(F.col("new_rank") <= k).withColumn("rank_change", F.col("old_rank") - F.col("new_rank"))


def hybrid_entities(keyword: DataFrame, vector: DataFrame, w_keyword: float = 0.3, w_vector: float = 0.7) -> DataFrame:
    """Full outer union of keyword places (query_id, entity, place from 0, n) and cosines (query_id, entity, score)."""
    both = keyword.join(vector, ["query_id", "entity"], "full_outer")
    positional = (F.col("n") - F.col("place")) / F.col("n")
    return both.select("query_id", "entity", F.round(w_keyword * F.coalesce(positional, F.lit(0.0)) + w_vector * F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def validation(rows: DataFrame, threshold: float = 0.5, least_ratio: float = 0.4, corrected_ratio: float = 0.2) -> DataFrame:
    """Per query the share of results at or above the threshold, and what follows from it."""
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("score") >= threshold).alias("relevant"))
    ratio = F.col("relevant") / F.col("results")
    return per.select("query_id", "results", "relevant", F.round(ratio, 6).alias("ratio"), F.when(ratio >= least_ratio, "VALIDATED").when(ratio >= corrected_ratio, "PARTIAL").otherwise("FAILED").alias("status"))
