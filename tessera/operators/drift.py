"""Iterative retrieval: a broad start, then follow-ups of those queries alone that aren't sure enough yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.modes import first_rows
from tessera.sources.shared import cut

#: Confidence at which a query is done, rounds of follow-ups, and chunks, communities and new follow-ups of each.
ENOUGH, ROUNDS, CHUNKS, WIDER, NEW = 0.7, 3, 10, 3, 2


def primer(seeds: DataFrame, mentions: DataFrame, chunk_communities: DataFrame, communities: int = 5, follow_ups: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The broad phase for seeds (query_id, entity): visited communities (query_id, community), follow-ups (query_id, entity, priority), and the confidence (query_id, confidence).

    Communities are those most of the seeds' chunks are in; follow-ups are entities that share chunks with the seeds; the confidence is the share
    of the seeds' chunks in the visited communities.
    """
    m = mentions.select("chunk_id", "entity")
    chunks = cut(seeds.join(m, "entity").select("query_id", "chunk_id").distinct())
    of = chunks.join(chunk_communities, "chunk_id").groupBy("query_id", "community").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("query_id"))
    visited = cut(first_rows(of.withColumn("share", share), ["query_id"], [F.desc("n"), "community"], communities))
    confidence = seeds.select("query_id").distinct().join(visited.groupBy("query_id").agg(F.round(F.sum("share"), 6).alias("c")), "query_id", "left").select("query_id", F.coalesce("c", F.lit(0.0)).alias("confidence"))
    shared = chunks.join(m, "chunk_id").join(seeds, ["query_id", "entity"], "left_anti").groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("priority"))
    return visited.select("query_id", "community"), cut(first_rows(shared, ["query_id"], [F.desc("priority"), "entity"], follow_ups)), confidence


def drift(seeds: DataFrame, mentions: DataFrame, chunk_communities: DataFrame, rounds: int = ROUNDS, enough: float = ENOUGH) -> DataFrame:
    """query_id, round, entity, confidence, communities, chunks: a row for the primer (round 0) and for each follow-up of each query; the greatest round of a query is its end.

    A round takes the queries below `enough` that have an unanswered follow-up, answers the one of highest priority by the entity's CHUNKS surest
    mentions (chunk_id, entity, confidence), visits the WIDER communities most of its chunks are in, and adds the NEW entities most
    mentioned beside it. Its answer is as sure as its chunks lie in visited communities (0.5, and 0.05 for each); a query keeps its best. Queries
    that are done leave the frontier, and each round's tables are cut, so a round costs what its active queries need.
    """
    m = mentions.select("chunk_id", "entity")
    visited, follow, start = primer(seeds, mentions, chunk_communities)
    sizes = lambda v: v.groupBy("query_id").agg(F.count(F.lit(1)).alias("communities"))
    none = F.lit(0).cast("long")
    state = cut(start.join(sizes(visited), "query_id", "left").select("query_id", F.lit(0).cast("long").alias("round"), F.lit(None).cast("long").alias("entity"), "confidence", F.coalesce("communities", none).alias("communities"), none.alias("chunks")))
    out, asked = state, None
    for i in range(1, rounds + 1):
        active = state.where(F.col("confidence") < enough).select("query_id", F.col("confidence").alias("before"))
        left = follow.join(active, "query_id")
        left = left if asked is None else left.join(asked, ["query_id", "entity"], "left_anti")
        picked = cut(first_rows(left, ["query_id"], [F.desc("priority"), "entity"], 1).select("query_id", "entity", "before"))
        if picked.isEmpty():
            break
        # an entity's mentions are ranked once, whichever queries ask for it
        own = mentions.join(picked.select("entity").distinct(), "entity", "left_semi")
        surest = first_rows(own.select("entity", "chunk_id", "confidence"), ["entity"], [F.desc("confidence"), "chunk_id"], CHUNKS).select("entity", "chunk_id").join(chunk_communities, "chunk_id", "left")
        wider = first_rows(own.join(chunk_communities, "chunk_id").groupBy("entity", "community").agg(F.count(F.lit(1)).alias("n")), ["entity"], [F.desc("n"), "community"], WIDER)
        visited = cut(visited.unionByName(picked.join(wider, "entity").select("query_id", "community")).distinct())
        found = cut(picked.join(surest, "entity").select("query_id", "entity", "chunk_id", "community", "before"))
        inside = found.join(visited.withColumn("known", F.lit(1)), ["query_id", "community"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("known").alias("inside"))
        answered = picked.join(inside, "query_id", "left").join(sizes(visited), "query_id", "left")
        sure = F.round(0.5 + 0.05 * F.coalesce("inside", none), 6)
        state = cut(answered.select("query_id", F.lit(i).cast("long").alias("round"), "entity", F.greatest("before", sure).alias("confidence"), F.coalesce("communities", none).alias("communities"), F.coalesce("chunks", none).alias("chunks")))
        out = out.unionByName(state)
        asked = picked.select("query_id", "entity") if asked is None else asked.unionByName(picked.select("query_id", "entity"))
        beside = found.select("query_id", "chunk_id").join(m, "chunk_id").groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("priority"))
        beside = beside.join(follow, ["query_id", "entity"], "left_anti").join(seeds, ["query_id", "entity"], "left_anti")
        follow = cut(follow.unionByName(first_rows(beside, ["query_id"], [F.desc("priority"), "entity"], NEW)))
    return out
