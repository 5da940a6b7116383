"""Entity resolution in its order: each entity joins the first cluster that a similar entity before it is in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

#: Cosine at or above which two entities are similar, and vectors of a block.
SIMILAR, HELD = 0.85, 20_000


def _blocks(index: DataFrame, held: int) -> DataFrame:
    """index with `block`: runs of rising ids of about `held` rows, cut at quantiles; a few numbers reach the driver."""
    n = max(4, -(-index.count() // held))
    at = index.withColumn("at", F.col("vec_id").cast("double"))
    cuts = sorted(set(at.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)))
    if not cuts:
        return index.withColumn("block", F.lit(0))
    return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="block").transform(at).withColumn("block", F.col("block").cast("int")).drop("at")


def _lowered(similar: float):
    """Of a later block's rows, those whose label falls to that of a similar row before them."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": [], "label_": []})
        a, b = a.sort_values("vec_id"), b.sort_values("vec_id")
        x, y = (np.stack(f["v"].to_numpy()) for f in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
        ids, others = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        label, new = a["leader"].to_numpy(), b["leader"].to_numpy().copy()
        if a["block"].iloc[0] == b["block"].iloc[0]:
            # one block: its rows decide one after the other, so chains within it end in one round
            for j in range(1, len(y)):
                near = np.round(y[:j] @ y[j], 6) >= similar
                near &= others[:j] < others[j]
                if near.any():
                    new[j] = min(new[j], new[:j][near].min())
        else:
            step = max(1, 1_000_000 // len(x))
            for i in range(0, len(y), step):
                near = (np.round(y[i : i + step] @ x.T, 6) >= similar) & (ids < others[i : i + step, None])
                new[i : i + step] = np.minimum(new[i : i + step], np.where(near, label, np.iinfo(np.int64).max).min(axis=1))
        fell = new < b["leader"].to_numpy()
        return pd.DataFrame({"vec_id": others[fell], "label_": new[fell]})

    return run


def leaders(index: DataFrame, similar: float = SIMILAR, held: int = HELD) -> DataFrame:
    """vec_id, leader: the cluster of each vector (vec_id, v), named by its first member, as if the vectors were taken by rising id and each
    cluster took all later ones similar to any member it has so far.

    That is the least leader among the similar vectors before it, or itself. All vectors look it up side by side, block against earlier
    block, until a round changes nothing: no row is made for a link, and rounds are few, as a round also follows the leader's own leader and
    ends all chains within a block. Vectors without length are alone. Repeated ids are one vector each and can't lead each other.
    """
    rows = cut(_blocks(index.select("vec_id", "v").where("vec_id is not null and v is not null"), held))
    blocks = rows.agg(F.max("block")).first()[0]
    if blocks is None:
        return rows.select("vec_id", F.col("vec_id").alias("leader"))
    labels = rows.select("vec_id", F.col("vec_id").alias("leader")).distinct()
    while True:
        state = rows.join(labels, "vec_id")
        left = state.select("vec_id", "v", "leader", "block", F.col("block").alias("early"), F.explode(F.sequence("block", F.lit(blocks))).alias("late"))
        # aliases make the right side's columns its own, as both sides come of one table
        right = state.select(*(F.col(c).alias(c) for c in ("vec_id", "v", "leader", "block")), F.explode(F.sequence(F.lit(0), "block")).alias("early"), F.col("block").alias("late"))
        found = left.groupBy("early", "late").cogroup(right.groupBy("early", "late")).applyInPandas(_lowered(similar), "vec_id long, label_ long")
        least = cut(found.groupBy("vec_id").agg(F.min("label_").alias("label_")))
        if least.isEmpty():
            return labels
        lowered = labels.join(least, "vec_id", "left").select("vec_id", F.coalesce("label_", "leader").alias("leader"))
        further = lowered.select(F.col("vec_id").alias("leader"), F.col("leader").alias("further"))
        labels = cut(lowered.join(further, "leader", "left").select("vec_id", F.least("leader", F.coalesce("further", "leader")).alias("leader")))


def resolved(members: DataFrame) -> DataFrame:
    """leader, text, type, confidence, size, variants: one entity for each cluster of members (leader, vec_id, text, type, confidence).

    The longest text is canonical, the first of those; the most frequent type, the least of those; the mean confidence to 2 places, but
    a single member's as it is; variants counts members of another text. All of it adds up in the tasks first, so a large cluster is no large group.
    """
    canonical = F.min_by("text", F.struct(-F.length("text"), F.col("vec_id")))
    per = members.groupBy("leader").agg(canonical.alias("text"), F.count(F.lit(1)).alias("size"), F.avg("confidence").alias("mean"), F.max("confidence").alias("only"))
    w = Window.partitionBy("leader").orderBy(F.desc("n"), "type")
    kinds = members.where("type is not null").groupBy("leader", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(w)).where("k = 1").select("leader", "type")
    same = members.groupBy("leader", "text").agg(F.count(F.lit(1)).alias("same"))
    out = per.join(kinds, "leader", "left").join(same, ["leader", "text"], "left")
    confidence = F.when(F.col("size") == 1, F.col("only")).otherwise(F.round(F.round("mean", 9), 2))
    return out.select("leader", "text", "type", confidence.alias("confidence"), "size", (F.col("size") - F.coalesce("same", F.lit(0))).alias("variants"))
