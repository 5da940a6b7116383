"""Document fingerprints: SimHash, and searches for near fingerprints through permuted block tables."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_parts, stored, table, texts

BITS = 128
#: Differing bits up to which the search finds fingerprints: near copies, at 5-word Jaccard 0.8 or more, differ in at most so many.
RADIUS = 20
#: Ids divisible by this are the search's queries.
QUERY_EVERY = 20
#: Queries (16 bytes each) and fingerprints (60 bytes each, with their tables) that a task of the search holds; more are dealt over several.
MOST_HELD, MOST_INDEXED = 500_000, 250_000
#: Blocks that a fingerprint is cut into, each with its own table; queries and candidates looked at side by side.
BLOCKS, ASKED, CANDIDATES = 7, 256, 2_000_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return out


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str) -> bytes:
    """128 bits. Terms are pairs of neighbouring lower-cased words (or the only word), weighted by 1 + ln(count); no words: all bits 0."""
    words = text.lower().split()
    if not words:
        return bytes(BITS // 8)
    h = np.fromiter(map(_words().__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    terms, counts = np.unique(h, return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS, dtype=np.float64)
    for i in range(0, len(terms), 4096):
        part = terms[i : i + 4096]
        both = np.stack([_mixed(part), _mixed(part ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        votes += 2.0 * (weights[i : i + 4096] @ bits.astype(np.float32)) - weights[i : i + 4096].sum(dtype=np.float64)
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of bits that differ."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by the first as many of the following text, or all of them."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt out in runs of falling id: columns run, edge, rank_id; and the number of runs. The row behind a run's last comes once more with it, edge true.

    The runs' bounds are quantiles of the ids, as many as there are shuffle partitions; only one id for each run reaches the driver.
    Null ids come last. Rows of one id follow each other by text.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    docs = docs.withColumn("rank_id", F.coalesce("doc_id", F.lit(-(2**63))))
    ids = docs.select(F.col("rank_id").cast("double").alias("at"))
    cuts = sorted(set(ids.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = [c for c in cuts if np.isfinite(c)]
    runs = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="run") if cuts else None
    placed = docs.withColumn("at", F.col("rank_id").cast("double"))
    placed = (runs.transform(placed) if runs else placed.withColumn("run", F.lit(0.0))).drop("at").withColumn("run", F.col("run").cast("int"))
    firsts = {r.run: r.first for r in placed.groupBy("run").agg(F.max("rank_id").alias("first")).collect()}  # a row for each run
    order = sorted(firsts, reverse=True)
    edges = [(firsts[below], above) for above, below in zip(order, [*order[1:], *order[:1]], strict=True)]
    edge = F.broadcast(spark.createDataFrame(edges, "edge_id long, edge_run int"))
    own = placed.withColumn("edge", F.lit(False))
    joined = placed.join(edge, F.col("rank_id") == F.col("edge_id"))
    return own.unionByName(joined.select("doc_id", "text", "rank_id", F.col("edge_run").alias("run"), F.lit(True).alias("edge"))), n


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each whole text.

    The next document has the next smaller id; after the smallest comes the largest. A single document follows itself.
    Null texts count as empty; equal texts have equal fingerprints; repeated ids follow each other by text; an empty table gives an empty one.
    """
    placed, n = with_next(texts(docs, id_col, text_col))

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting, at, closed = None, None, False  # the row whose next one has not come; its run; whether the run's edge has come
        for b in batches:
            rows = []
            for i, t, r, edge in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("run").to_pylist(), b.column("edge").to_pylist(), strict=True):
                if r != at:
                    waiting, at, closed = None, r, False
                if closed:
                    continue
                text = t.as_py()
                own = fingerprint(text)
                if waiting is not None:
                    w, wt, wf = waiting
                    changed = edited(wt, text)
                    cf = fingerprint(changed)
                    rows.append((w, len(wt), hashlib.sha256(changed.encode()).hexdigest(), wf.hex(), cf.hex(), likeness(wf, cf), likeness(wf, own)))
                waiting, closed = (i, text, own), edge
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = placed.repartition(n, "run").sortWithinPartitions("run", "edge", F.desc("rank_id"), "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_CUTS = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]


def _block(x: np.ndarray, b: int) -> np.ndarray:
    """The bits of block b, as a number. Fingerprints are rows of two 64-bit halves."""
    lo, hi = _CUTS[b], _CUTS[b + 1]
    if hi <= 64:
        bits = x[:, 0] >> np.uint64(64 - hi)
    elif lo >= 64:
        bits = x[:, 1] >> np.uint64(BITS - hi)
    else:
        bits = x[:, 0] << np.uint64(hi - 64) | x[:, 1] >> np.uint64(BITS - hi)
    return (bits & np.uint64(2 ** (hi - lo) - 1)).astype(np.int64)


class BlockTables:
    """Fingerprints in BLOCKS tables, each in the order of the block that its permutation puts first.

    Of fingerprints that differ in at most `radius` bits some block differs in at most radius // BLOCKS bits (else all would differ in more
    than radius in sum). So a query looks up its block with each choice of so few bits changed, in every table, and finds all.
    """

    def __init__(self, x: np.ndarray, copies: np.ndarray, radius: int):
        self.x, self.copies, self.radius, self.least = x, copies, radius, radius // BLOCKS
        self.blocks = [_block(x, b) for b in range(BLOCKS)]
        self.order = [np.argsort(k, kind="stable") for k in self.blocks]
        widths = [_CUTS[b + 1] - _CUTS[b] for b in range(BLOCKS)]
        self.places = [np.searchsorted(k[o], np.arange(2**w + 1)) for k, o, w in zip(self.blocks, self.order, widths, strict=True)]
        self.changes = [np.array([sum(1 << i for i in bits) for n in range(self.least + 1) for bits in combinations(range(w), n)]) for w in widths]

    def others(self, asked: np.ndarray) -> np.ndarray:
        """For each query the copies of the fingerprints that differ in 1 to `radius` bits."""
        out = np.zeros(len(asked), dtype=np.int64)
        for j in range(0, len(asked), ASKED):
            q = asked[j : j + ASKED]
            own = [_block(q, b) for b in range(BLOCKS)]
            for b in range(BLOCKS):
                key = own[b][:, None] ^ self.changes[b]
                first = self.places[b][key].ravel()
                n = self.places[b][key + 1].ravel() - first
                some = np.flatnonzero(n)
                first, n, who = first[some], n[some], some // len(self.changes[b])
                ends = np.cumsum(n)
                cuts = np.unique(np.append(np.searchsorted(ends, np.arange(CANDIDATES, ends[-1], CANDIDATES)), len(n))) if len(n) else []
                at = 0
                for cut in cuts:
                    f, m = first[at:cut], n[at:cut]
                    w = np.repeat(who[at:cut], m)
                    i = self.order[b][np.arange(len(w)) + np.repeat(f - (np.cumsum(m) - m), m)]
                    far = np.bitwise_count(self.x[i, 0] ^ q[w, 0]) + np.bitwise_count(self.x[i, 1] ^ q[w, 1])
                    hit = (far <= self.radius) & (far > 0)
                    i, w = i[hit], w[hit]
                    for e in range(b):  # a pair counts in the first table that it is found in
                        new = np.bitwise_count(self.blocks[e][i] ^ own[e][w]) > self.least
                        i, w = i[new], w[new]
                    np.add.at(out, j + w, self.copies[i])
                    at = cut
        return out


def near_counts(counted: DataFrame, radius: int = RADIUS, most_held: int = MOST_HELD, most_indexed: int = MOST_INDEXED) -> DataFrame:
    """query, others: for each asked fingerprint the copies of others within the radius, where there are any. counted: fingerprint (distinct), copies, asked.

    Parts of all fingerprints meet parts of the queries in a grid; a meeting puts its fingerprints into block tables and looks up its queries. No
    row is made for a pair, and none of a group meet in one task.
    """
    told = counted.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked")).first()
    n, k = max(-(-told.n // most_indexed), min(16, shuffle_parts(counted.sparkSession))), max(1, -(-told.asked // most_held))
    rows = counted.select(F.unhex("fingerprint").alias("bits"), "copies", "asked", F.xxhash64("fingerprint").alias("h"))
    grid = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.where("asked").select("bits", F.lit(0).cast("long").alias("copies"), F.pmod("h", F.lit(k)).cast("int").alias("part"), grid(n).alias("i")).select("bits", "copies", (F.col("i") * k + F.col("part")).alias("cell"))
    index = rows.select("bits", "copies", F.pmod(F.shiftright("h", 20), F.lit(n)).cast("int").alias("part"), grid(k).alias("i")).select("bits", "copies", (F.col("part") * k + F.col("i")).alias("cell"))

    def run(batches):
        def told(held):
            x, copies = (np.concatenate(c) for c in zip(*held, strict=True))
            asked, known = x[copies == 0], copies > 0
            found = BlockTables(x[known], copies[known], radius).others(asked) if len(asked) else np.empty(0, dtype=np.int64)
            hit = np.flatnonzero(found)
            return pa.RecordBatch.from_arrays([pa.array([asked[i].astype(">u8").tobytes().hex() for i in hit], pa.string()), pa.array(found[hit])], names=["query", "others"])

        at, held = None, []  # the cell, and its rows
        for b in batches:
            bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            copies, cell = b.column("copies").to_numpy(), b.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell) != 0) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if lo == hi:
                    continue
                if cell[lo] != at and held:
                    yield told(held)
                    held = []
                at = cell[lo]
                held.append((bits[lo:hi], copies[lo:hi]))
        if held:
            yield told(held)

    dealt = queries.unionByName(index).repartition(n * k, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "query string, others long").groupBy("query").agg(F.sum("others").alias("others"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_next() of all documents, and for ids divisible by QUERY_EVERY how many other rows have a fingerprint within the radius (n_near; else null)."""
    rows = stored(compare_next(table(spark, sf_dir, "documents")), "fingerprints")
    per = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.max(F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))).alias("asked"))
    counts = per.where("asked").join(near_counts(per), F.col("query") == F.col("fingerprint"), "left").select(F.col("fingerprint").alias("found"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    asked = rows.where(asks).join(counts, F.col("found") == F.col("fingerprint"), "left").select(*rows.columns, "n_near")
    return asked.unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
