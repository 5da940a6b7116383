"""An inverted-file index of vectors: lists around centroids, searched by probing the nearest or exactly, by bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import HELD, _best
from tessera.sources.shared import cut

#: Vectors that the centroids are fitted on (the first by hash of the id; all are indexed), rounds of the fitting, and lists.
SAMPLE, ROUNDS, LISTS = 20_000, 10, 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids on the unit sphere: spherical K-means from a spread of distinct rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(0).permutation(len(distinct))[:lists]]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        c[full] = _unit(sums[full])
    return c


class VectorIndex:
    """Lists of the vectors (vec_id, v) of an index by nearest centroid, written once. Vectors without length are in none.

    A list is cut into pieces of about `held` vectors by hash, so a list that holds very many (copies of one vector) is no large group.
    Only the sample, the centroids, and a radius and a count for each list reach the driver.
    """

    def __init__(self, vectors: DataFrame, lists: int = LISTS, held: int = HELD):
        rows = vectors.select("vec_id", "v").where("v is not null").where(F.exists("v", lambda x: x != 0))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
        c = self.centroids = _fitted(_unit(np.array([r.v for r in sample])), lists) if sample else np.zeros((1, 1))

        def placed(frames):
            for f in frames:
                near = _unit(np.stack(f["v"].to_numpy())) @ c.T
                own = np.argmax(near, axis=1)
                yield f.assign(list=own.astype(np.int32), far=np.sqrt(np.maximum(2 - 2 * near[np.arange(len(own)), own], 0)))

        at = cut(rows.mapInPandas(placed, "vec_id long, v array<double>, list int, far double"))
        told = {r.list: r for r in at.groupBy("list").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
        self.radius = np.array([told[i].radius if i in told else -np.inf for i in range(len(c))])  # none is within an empty list
        pieces = [max(1, -(-told[i].n // held)) if i in told else 1 for i in range(len(c))]
        self.pieces = F.get(F.array(*map(F.lit, pieces)), F.col("list"))
        self.rows = at.withColumn("piece", F.pmod(F.xxhash64("vec_id"), self.pieces).cast("int")).drop("far")

    def _found(self, visits: DataFrame, k: int) -> DataFrame:
        """source, target, score: each visit's (vec_id, v, list) k best in each piece of the list."""
        asked = visits.select(*(F.col(c).alias(c) for c in visits.columns)).withColumn("piece", F.explode(F.sequence(F.lit(0), self.pieces - 1)))
        return asked.groupBy("list", "piece").cogroup(self.rows.groupBy("list", "piece")).applyInPandas(_best(k, None, "cosine", False), "source long, target long, score double")

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
        return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    def _visits(self, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
        """The lists nearest to each query (vec_id, v), or, with its kth score so far (column kth), the others that can hold a better one."""
        c, radius = self.centroids, self.radius

        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                near = _unit(np.stack(f["v"].to_numpy())) @ c.T
                order = np.argsort(-near, axis=1, kind="stable")
                if beyond:
                    # on the unit sphere no vector of a list is nearer than the centroid's distance less the radius; scores are rounded to 6 places
                    least = np.sqrt(np.maximum(2 - 2 * near, 0)) - radius - 1e-6
                    best = 1 - np.maximum(least, 0) ** 2 / 2
                    wanted = best >= f["kth"].fillna(-2).to_numpy()[:, None] - 1e-6
                    wanted &= np.isfinite(radius)
                    np.put_along_axis(wanted, order[:, :probes], False, axis=1)
                else:
                    wanted = np.zeros(near.shape, dtype=bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                row, col = np.nonzero(wanted)
                yield pd.DataFrame({"vec_id": f["vec_id"].to_numpy()[row], "v": f["v"].to_numpy()[row], "list": col.astype(np.int32)})

        return queries.mapInPandas(run, "vec_id long, v array<double>, list int")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """source, target, score, rank: the k vectors of highest cosine (to 6 places, ties by the smaller id) for each query (vec_id, v), itself left out.

        By probing, of the `probes` lists nearest to the query. Exact, in a second step also of all lists that by the triangle
        inequality can hold one as near as the kth found; the rest are not looked at. Any number of queries; those without length find nothing.
        """
        if not np.isfinite(self.radius).any():  # an empty index
            return queries.sparkSession.createDataFrame([], "source long, target long, score double, rank long")
        asked = queries.select("vec_id", "v").where("v is not null").where(F.exists("v", lambda x: x != 0))
        first = self._found(self._visits(asked, probes, False), k)
        if not exact:
            return self._top(first, k)
        first = cut(self._top(first, k).drop("rank"))
        kth = first.groupBy(F.col("source").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
        rest = asked.join(kth, "vec_id", "left")
        return self._top(first.unionByName(self._found(self._visits(rest, probes, True), k)), k)
