"""Nearest neighbours, similarity joins and diversification over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector

#: Vectors of one block of a grid.
HELD = 20_000
#: Scores of one step of a meeting of two blocks.
STEP = 1_000_000
#: Vectors of one block of an index that meets itself, scores of one step, and vectors of one side in it.
HELD_PAIRS, STEP_PAIRS, STRIP = 40_000, 4_000_000, 2_000


def hashed_counts(rows: DataFrame, word: str, size: int = 64) -> DataFrame:
    """The other columns of `rows` (a word of a text each), bucket and n: the hashed bag of words of each key as sparse rows. Null words count nowhere; texts without words have no row.

    Words are hashed in generated code and counted before the shuffle, so at most `size` rows of a key and task move.
    """
    keys = [c for c in rows.columns if c != word]
    each = rows.where(F.col(word).isNotNull()).select(*keys, vector.word_bucket(F.col(word), size).alias("bucket"))
    return each.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def hashed_vectors(rows: DataFrame, word: str, key: str, size: int = 64) -> DataFrame:
    """vec_id, v: the hashed bag of words of each key of `rows` (key, word) as a vector; keys without words have none."""
    bags = hashed_counts(rows.select(key, word), word, size).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double"))
    return bags.select(F.col(key).alias("vec_id"), places.alias("v"))


def top_k(rows: DataFrame, k: int, by: str = "query_id", tie: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """The k best-scored rows of each query, at or above the threshold, with rank; ties by the smaller id."""
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _alike(measure: str, x: np.ndarray, y: np.ndarray):
    """A function of a slice of x's rows: their scores with all of y, rounded to 6 places, -inf where there is none."""
    if measure == "dot":
        return lambda part: np.round(x[part] @ y.T, 6)
    if measure == "euclid":
        squares = (y * y).sum(axis=1)

        def distances(part):
            s = np.round(-np.sqrt(np.maximum((x[part] ** 2).sum(axis=1)[:, None] + squares - 2 * (x[part] @ y.T), 0)), 6)
            # small distances are taken anew from the differences, as those of squares lose their last places
            row, col = np.nonzero(s * s < 1e-4 * ((x[part] ** 2).sum(axis=1)[:, None] + squares))
            for i in range(0, len(row), 50_000):
                r, c = row[i : i + 50_000], col[i : i + 50_000]
                s[r, c] = np.round(-np.sqrt(((x[part][r] - y[c]) ** 2).sum(axis=1)), 6)
            return s

        return distances
    lengths = [np.linalg.norm(m, axis=1) for m in (x, y)]
    x, y = (m / np.maximum(n, 1e-300)[:, None] for m, n in zip((x, y), lengths, strict=True))
    sign = -1.0 if measure == "opposite" else 1.0

    def cosines(part):
        s = np.round(sign * (x[part] @ y.T), 6) + 0.0
        s = np.clip(s, 0, 1) if measure == "clipped" else s
        s[lengths[0][part] == 0] = -np.inf
        s[:, lengths[1] == 0] = -np.inf
        return s

    return cosines


#: How two vectors are compared: cosine, cosine cut to [0, 1], its negative (the farthest first), inner product, negative distance.
MEASURES = ("cosine", "clipped", "opposite", "dot", "euclid")


def _best(k: int, threshold: float | None, measure: str, same_label: bool):
    """A function of two blocks (vec_id, v, and label): each row's k best of the other block, as (source, target, score)."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        source, target, score = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
        if len(a) and len(b):
            b = b.sort_values("vec_id")
            ids, others = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            alike = _alike(measure, np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()))
            step = max(1, STEP // len(others))
            for i in range(0, len(ids), step):
                part = slice(i, i + step)
                s = alike(part)
                s[ids[part, None] == others] = -np.inf
                if threshold is not None:
                    s[s < threshold] = -np.inf
                if same_label:
                    s[a["label"].to_numpy()[part, None] != b["label"].to_numpy()] = -np.inf
                if s.shape[1] > k:  # what is below a query's kth score goes; of those at it the smallest ids stay
                    s[s < np.partition(s, -k, axis=1)[:, -k, None]] = -np.inf
                row, col = np.nonzero(s > -np.inf)
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                stay = np.arange(len(row)) - first < k
                row, col = row[stay], col[stay]
                source.append(ids[i + row])
                target.append(others[col])
                score.append(s[row, col])
        return pd.DataFrame({"source": np.concatenate(source), "target": np.concatenate(target), "score": np.concatenate(score)})

    return best


def top_k_blocks(queries: DataFrame, index: DataFrame, k: int, threshold: float | None, held: int = HELD, measure: str = "clipped", same_label: bool = False) -> DataFrame:
    """source, target, score, rank: for each query vector (vec_id, v) the k best others of the index at or above the threshold; with `same_label` (label on both sides) of its own label only.

    Blocks of about `held` vectors of either side meet pair by pair in a grid and are multiplied as matrices, a bounded part at a
    time, so no row is made for a pair that falls short; each meeting keeps its k best, ties by the smaller id, and these meet in one
    window. Any number of queries is dealt alike. Cosines of vectors without length are none.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure {measure} is none of {MEASURES}")
    rows, cols = (max(4, -(-side.count() // held)) for side in (queries, index))
    # both sides' keys have one type: else equal keys would hash to different partitions
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["vec_id", "v", *(["label"] if same_label else [])]
    left = queries.select(*columns, own(rows).alias("block"), every(cols).alias("other"))
    # aliases make the right side's columns its own where both sides come of one table
    right = index.select(*(F.col(c).alias(c) for c in columns), own(cols).alias("other"), every(rows).alias("block"))

    pairs = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(_best(k, threshold, measure, same_label), "source long, target long, score double")
    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, index: DataFrame, k: int, measure: str = "cosine", threshold: float | None = None, same_label: bool = False, held: int = HELD) -> DataFrame:
    """query_id, vec_id, score, rank: top_k_blocks() under the names of a search."""
    return top_k_blocks(queries, index, k, threshold, held, measure, same_label).withColumnsRenamed({"source": "query_id", "target": "vec_id"})


class _Kept:
    """The k best (target, score) of each row so far, ties by the smaller target, and of each row the score that a further one has to come up to."""

    def __init__(self, ids: np.ndarray, k: int, threshold: float):
        self.ids, self.k, self.least = ids, k, np.full(len(ids), threshold)
        self.row, self.target, self.score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)

    def add(self, row: np.ndarray, target: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[row]
        row, target, score = (np.concatenate(x) for x in ((self.row, row[good]), (self.target, target[good]), (self.score, score[good])))
        order = np.lexsort((target, -score, row))
        row, target, score = row[order], target[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.least[row[last]] = score[last]
        stay = place < self.k
        self.row, self.target, self.score = row[stay], target[stay], score[stay]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"source": self.ids[self.row], "target": self.target, "score": self.score})


def _both_best(k: int, threshold: float):
    """A function of two blocks (vec_id, v, and twin: whether they are one block): the k best of each row of either in the other.

    All pairs are multiplied in single precision; those that could come up to what their rows have so far, by its error, are scored again in double.
    """

    def prepared(block: pd.DataFrame):
        v = np.stack(block["v"].to_numpy())
        length = np.linalg.norm(v, axis=1)
        v = v[length != 0] / length[length != 0, None]
        return block["vec_id"].to_numpy()[length != 0], v, v.astype(np.float32)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _Kept(np.empty(0, dtype=np.int64), k, threshold).frame()
        twin = bool(a["twin"].iloc[0])
        (ids, x, fast_x), (others, y, fast_y) = prepared(a), prepared(b)
        if not len(ids) or not len(others):
            return _Kept(ids[:0], k, threshold).frame()
        # what is kept of a strip is sorted anew at each step, so strips are short
        tall, wide = STEP_PAIRS // STRIP, STRIP
        rows = [_Kept(ids[i : i + tall], k, threshold) for i in range(0, len(ids), tall)]
        cols = [_Kept(others[j : j + wide], k, threshold) for j in range(0, len(others), wide)]
        margin = 2e-6 + 2e-7 * (x.shape[1] + 8)  # of rounding to six places and of single precision

        def bar(least: np.ndarray) -> np.ndarray:
            return np.where(least <= 0, -np.inf, least - margin).astype(np.float32)  # all below 0 count as 0

        for j, down in enumerate(cols):
            for i, along in enumerate(rows):
                u, v, u_ids, v_ids = x[i * tall : (i + 1) * tall], y[j * wide : (j + 1) * wide], along.ids, down.ids
                s = fast_x[i * tall : (i + 1) * tall] @ fast_y[j * wide : (j + 1) * wide].T
                mask = s >= bar(along.least)[:, None]
                if not twin:
                    mask |= s >= bar(down.least)
                found = np.flatnonzero(mask)
                for at in range(0, len(found), 200_000):
                    p, q = np.divmod(found[at : at + 200_000], len(v_ids))
                    p, q = p[u_ids[p] != v_ids[q]], q[u_ids[p] != v_ids[q]]
                    score = np.round(np.clip(np.einsum("ij,ij->i", u[p], v[q]), 0, 1), 6) + 0.0
                    along.add(p, v_ids[q], score)
                    if not twin:
                        down.add(q, u_ids[p], score)
        return pd.concat([strip.frame() for strip in (rows if twin else rows + cols)])

    return best


def similar_pairs(index: DataFrame, k: int, threshold: float, held: int = HELD_PAIRS) -> DataFrame:
    """source, target, score, rank: for each vector (vec_id, v) the k others of the highest cosine, cut to [0, 1], at or above the threshold; ties by the smaller id. Vectors without length have none.

    Blocks of about `held` vectors meet each other and themselves once, and both sides keep their best of a meeting, so a pair is looked at once.
    """
    blocks = max(4, -(-index.count() // held))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    side = index.select("vec_id", "v", own.alias("own"))
    left = side.select("vec_id", "v", F.col("own").alias("block"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("other")).withColumn("twin", F.col("block") == F.col("other"))
    right = side.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), F.col("own").alias("other"))
    pairs = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(_both_best(k, threshold), "source long, target long, score double")
    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each can reach over the links a, b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[x], label[y])
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def linking_pairs(index: DataFrame, threshold: float, held: int = HELD) -> DataFrame:
    """a, b: links that join the same vectors, over any number of steps, as all links at cosines at or above the threshold.

    Equal vectors are linked to the one of the least id, which stands for them. Blocks of those, of about `held` vectors, meet pair by pair;
    of each meeting's links a spanning forest is kept, so every link counts and no more rows are made than there are vectors in the blocks.
    """
    same = index.groupBy("v").agg(F.min("vec_id").alias("a"))
    copies = index.join(same, "v").where((F.col("a") != F.col("vec_id")) & F.exists("v", lambda x: x != 0)).select("a", F.col("vec_id").alias("b"))
    blocks = max(8, -(-index.count() // held))
    side = same.select(F.col("a").alias("vec_id"), "v", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("own"))
    # both sides' keys have one type: else equal keys would hash to different partitions
    left = side.select("vec_id", "v", F.col("own").alias("block"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("other"))
    right = side.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), F.col("own").alias("other"))

    def forest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nodes = roots = np.empty(0, dtype=np.int64)
        if len(a) and len(b):
            x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            ids, others = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            step = max(1, STEP // len(y))
            for i in range(0, len(x), step):
                row, col = np.nonzero(np.round(np.clip(x[i : i + step] @ y.T, 0, 1), 6) >= threshold)
                nodes, roots = _roots(np.concatenate([nodes, ids[i + row]]), np.concatenate([roots, others[col]]))
        return pd.DataFrame({"a": roots, "b": nodes})[nodes != roots]

    return copies.unionByName(left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(forest, "a long, b long"))


def mean_vectors(rows: DataFrame, by: str) -> DataFrame:
    """The mean of each group's vectors, by position, brought to length 1."""
    parts = rows.select(by, F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("mean")).select(by, vector.normalized("mean").alias("mean"))


def diversity(candidates: DataFrame, by: str = "query_id") -> DataFrame:
    """1 less the mean cosine of each query's pairs of candidates (a bounded list each); 1 for fewer than two."""
    other = candidates.select(F.col(by).alias("o_by"), F.col("vec_id").alias("o_id"), F.col("v").alias("o_v"))
    pairs = candidates.join(other, (F.col(by) == F.col("o_by")) & (F.col("vec_id") < F.col("o_id")))
    mean = pairs.groupBy(by).agg(F.avg(vector.cosine("v", "o_v")).alias("m"))
    return candidates.select(by).distinct().join(mean, by, "left").select(by, F.round(1 - F.coalesce("m", F.lit(0.0)), 6).alias("diversity"))


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, by: str = "query_id") -> DataFrame:
    """Maximal marginal relevance: each query's candidates (vec_id, v, score), a bounded list, reordered greedily; unchanged if there are at most k."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        if len(pdf) > k:
            v = np.stack(pdf["v"].to_numpy())
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            sim, score, chosen = v @ v.T, pdf["score"].to_numpy(), [0]
            while len(chosen) < k:
                gain = weight * score - (1 - weight) * sim[:, chosen].max(axis=1)
                gain[chosen] = -np.inf
                chosen.append(int(np.argmax(gain)))
            pdf = pdf.iloc[chosen]
        return pd.DataFrame({by: pdf[by], "vec_id": pdf["vec_id"], "score": pdf["score"], "position": np.arange(1, len(pdf) + 1)})

    return candidates.select(by, "vec_id", "v", "score").groupBy(by).applyInPandas(pick, f"{by} long, vec_id long, score double, position long")


def latest_points(points: DataFrame, key: str, order: str) -> DataFrame:
    """Vector upsert: the newest point of each key, those without a vector left out; of equally new ones that of the least vector."""
    w = Window.partitionBy(key).orderBy(F.desc(order), "v")
    return points.where(F.col("v").isNotNull()).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
