"""Expansion of chunks over the entities that they mention: one hop by the same entity, two by related ones, with the path that led there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.modes import first_rows
from tessera.sources.shared import cut

#: Graph score of a hop, least score, chunks of a query, and related entities followed of each query.
DECAY, LEAST, MOST, RELATED = 0.7, 0.4, 15, 5


def gate(kind: Column, confidence: Column, frequency: Column, score: Column) -> Column:
    """Which edges are followed: extracted ones at confidence 0.7, common mentions from two on, alike meanings at 0.75."""
    return F.coalesce(F.when(kind == "llm", confidence >= 0.7).when(kind == "cooccurrence", frequency >= 2).when(kind == "semantic", score >= 0.75), F.lit(False))


def expanded(anchors: DataFrame, mentions: DataFrame, edges: DataFrame, most: int = MOST, related: int = RELATED) -> DataFrame:
    """query_id, chunk_id, hop, vector, graph, combined, via, rank: the best `most` chunks around each query's anchors (query_id, chunk_id), the anchors left out.

    mentions: chunk_id, entity, confidence. edges: a, b, strength, those that gate() lets through, followed both ways. Hop 1 leads to chunks that mention an
    entity of an anchor, hop 2 to those that mention one of the query's `related` strongest neighbours of such entities. A path scores 0.6 of the
    mention's confidence and 0.4 of DECAY for each hop; paths below LEAST go, a chunk counts by its best path (of equal ones the first by name), and `via` tells it.

    All of an entity's mentions differ in confidence alone, so of an entity only as many are followed as the result and the anchors
    can use up, and of its neighbours as many as the query can: both are ranked once for each entity, whichever queries reach it. A hot entity is no large group of any query.
    """
    anchors = cut(anchors.select("query_id", "chunk_id").distinct())
    own = cut(anchors.join(mentions.select("chunk_id", "entity"), "chunk_id").select("query_id", "entity").distinct())
    # both ways of an edge come of one row, so edges are worked out once
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = edges.select(F.explode(ways).alias("way"), "strength").select("way.a", "way.b", "strength")
    # a query's own entities are left out of its neighbours, so of an entity so many more are needed
    held = own.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    both = first_rows(both, ["a"], [F.desc("strength"), "b"], related + held)
    beside = own.join(both, own.entity == both.a).select("query_id", F.col("a").alias("from"), F.col("b").alias("entity"), "strength").join(own, ["query_id", "entity"], "left_anti")
    second = first_rows(first_rows(beside, ["query_id", "entity"], [F.desc("strength"), "from"], 1), ["query_id"], [F.desc("strength"), "entity"], related)
    first = own.select("query_id", "entity", F.lit(1).cast("long").alias("hop"), F.col("entity").cast("string").alias("via"))
    reached = cut(first.unionByName(second.select("query_id", "entity", F.lit(2).cast("long").alias("hop"), F.concat_ws(">", "from", "entity").alias("via"))))
    spare = anchors.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    top = first_rows(mentions.join(reached.select("entity").distinct(), "entity", "left_semi").select("entity", "chunk_id", "confidence"), ["entity"], [F.desc("confidence"), "chunk_id"], most + spare)
    paths = reached.join(top, "entity").join(anchors, ["query_id", "chunk_id"], "left_anti")
    graph = F.round(F.pow(F.lit(DECAY), F.col("hop")), 6)
    combined = F.round(0.6 * F.col("confidence") + 0.4 * graph, 6)
    scored = paths.select("query_id", "chunk_id", "hop", F.col("confidence").alias("vector"), graph.alias("graph"), combined.alias("combined"), "via").where(F.col("combined") >= LEAST)
    best = first_rows(scored, ["query_id", "chunk_id"], [F.desc("combined"), F.desc("graph"), F.desc("vector"), "via"], 1)
    order = [F.desc("combined"), F.desc("graph"), F.desc("vector"), "chunk_id"]
    return first_rows(best, ["query_id"], order, most, rank=True)
