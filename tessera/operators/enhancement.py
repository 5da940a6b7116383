"""Queries enhanced by hypothetical answers, and chunks found by hypothetical questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import vectors

MODES = ("combined", "hyde_only", "query_only")


def enhanced(queries: DataFrame, hypotheticals: DataFrame, mode: str = "combined", alpha: float = 0.5) -> DataFrame:
    """vec_id, v: each query's vector (vec_id, v) blended with the mean of its hypothetical answers' vectors (vec_id, v), `alpha` parts of its own; or
    that mean alone; or as it is. A query without hypothetical answers stays as it is. What makes the answers is a hook outside."""
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {MODES}")
    if mode == "query_only":
        return queries.select("vec_id", "v")
    means = vectors.mean_vectors(hypotheticals.select("vec_id", "v"), "vec_id")
    found = vector.blended("v", "mean", alpha) if mode == "combined" else F.col("mean")
    return queries.select("vec_id", "v").join(means, "vec_id", "left").select("vec_id", F.when(F.col("mean").isNull(), F.col("v")).otherwise(found).alias("v"))


def by_questions(queries: DataFrame, questions: DataFrame, k: int, most: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of each query (vec_id, v) by the best of the chunk's questions (vec_id, chunk_id, v), of which a
    chunk has at most `most`: so the k * most nearest questions hold the k best chunks."""
    near = vectors.nearest(queries, questions, k * most).join(questions.select("vec_id", "chunk_id"), "vec_id")
    return vectors.top_k(near.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, tie="chunk_id")
