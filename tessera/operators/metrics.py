"""Retrieval metrics over ranked results (query_id, chunk_id, rank, relevance) and the relevant chunks' counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results with relevance (0 where unjudged), and each query's number of relevant chunks, n_relevant."""
    totals = qrels.where("relevance > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = results.join(qrels, ["query_id", "chunk_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    return rows.join(totals, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))


def per_query(rows: DataFrame) -> DataFrame:
    """Reciprocal rank, precision, recall, F1 and hit at the cuts, average precision, binary hits. Nothing relevant: 0."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("relevance") > 0).cast("int")
    rows = rows.withColumn("hit", hit).withColumn("seen", F.sum(hit).over(w))
    aggs = [F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.max("n_relevant").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap")]
    aggs += [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in CUTS]
    per = rows.groupBy("query_id").agg(*aggs)
    out = [F.col("query_id"), F.round("rr", 6).alias("mrr"), F.round(F.when(F.col("n") > 0, F.col("ap") / F.col("n")).otherwise(0.0), 6).alias("ap")]
    for k in CUTS:
        p, r = F.col(f"h{k}") / F.lit(k), F.when(F.col("n") > 0, F.col(f"h{k}") / F.col("n")).otherwise(0.0)
        out += [F.round(p, 6).alias(f"precision_{k}"), F.round(r, 6).alias(f"recall_{k}"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias(f"f1_{k}"), (F.col(f"h{k}") > 0).cast("long").alias(f"hit_{k}")]
    return per.select(*out)


def ndcg(rows: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Graded gain at k over the ideal gain of the query's judged chunks."""
    gain = rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("relevance") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")
    ideal = qrels.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("query_id").agg(F.sum(F.col("relevance") / F.log2(F.col("i") + 1.0)).alias("best"))
    return gain.join(ideal, "query_id", "left").select("query_id", F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg"))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least, greatest and count."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.round(F.avg(v), 9).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.count(v).alias("n"))


def of_retrieved(rows: DataFrame, k: int = 10) -> DataFrame:
    """Precision over what was retrieved (k at most, not k itself), recall and NDCG with relevance 0 or 1. Nothing relevant: 0."""
    hit = (F.col("relevance") > 0).cast("int")
    per = rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("found"), F.max("n_relevant").alias("n"), F.sum(hit / F.log2(F.col("rank") + 1.0)).alias("gain"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.lit(k))).cast("int"))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = lambda x: F.round(F.when(F.col("n") > 0, x).otherwise(0.0), 6)
    return per.select("query_id", F.round(F.col("hits") / F.col("found"), 6).alias("precision"), some(F.col("hits") / F.col("n")).alias("recall"), some(F.col("gain") / ideal).alias("ndcg"))


#: Weights of the checks of a test case; a recommended mode adds BONUS to a score above half; PASS is asked for.
CHECKS, BONUS, PASS = {"chunk_count": 0.10, "entity_match": 0.15, "chunk_content": 0.20, "answer_keywords": 0.20, "similarity": 0.35}, 0.1, 0.6


def case_score(recommended: Column) -> Column:
    """The weighted sum of the checks that passed (boolean columns by the names of CHECKS), 1 at most, raised if the mode was a recommended one; to 6 places."""
    score = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in CHECKS.items()), F.lit(0.0))
    return F.round(F.when(recommended & (F.round(score, 6) > 0.5), F.least(score + BONUS, F.lit(1.0))).otherwise(score), 6)
