"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Trained in numpy on a bounded sample of labelled documents; a document's score is that of its highest-scoring
window, and all overlapping windows of the whole text are scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, texts

#: Words of a window; one starts at every word.
WINDOW = 6
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 8, 4096
#: Labelled documents of each class that the network is trained on: those with the smallest hash of their id.
SAMPLE_PER_CLASS = 1500
#: Words with an embedding of their own: those in at least so many training documents, the most frequent first.
LEAST_DOCS, MOST_WORDS = 2, 60_000
#: Passes over the sample, more of a small one: until so many batches have been learned from.
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 240, 96, 0.01, 7
THRESHOLD = 0.7
_EDGES = ".,;:!?\"'()[]{}*#&$%|<>-_=+/\\"
#: Characters of the longest word that is one token, and of the pieces of a longer one without punctuation.
LONGEST, PIECE = 50, 16
_RUNS = re.compile(f"[^{re.escape(_EDGES)}]+[{re.escape(_EDGES)}]*|[{re.escape(_EDGES)}]+")
_HELD_WORDS = 300_000
#: Windows, and words, that go through the network together.
_STEP = 2048


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(text: str) -> list[str]:
    """Lower-cased words; longer ones than LONGEST are cut behind their punctuation, and what is still too long into pieces that half overlap."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for w in words:
        for run in _RUNS.findall(w) if len(w) > LONGEST else [w]:
            out += [run] if len(run) <= LONGEST else [run[i : i + PIECE] for i in range(0, len(run) - PIECE // 2, PIECE // 2)]
    return out


def char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' byte trigrams, edges marked, one word behind the other, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw) + b"\0\0", dtype=np.uint8).astype(np.uint32)
    h = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1]) * np.uint32(0x85EBCA6B) + data[2:]
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    h = (h ^ h >> np.uint32(13)) % np.uint32(CHAR_BUCKETS)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(sizes)
    keep = np.ones(len(h), dtype=bool)
    keep[ends - 1] = keep[ends - 2] = False  # trigrams that reach into the next word
    return h[keep].astype(np.int64), ends - sizes - 2 * np.arange(len(raw))


def _windows(n: int) -> np.ndarray:
    """First words of all overlapping windows over n words; a shorter text is one window."""
    return np.arange(max(1, n - WINDOW + 1), dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """words: number of each known word, from 2 on (0: no word, 1: unknown). parts: the weights by name."""

    words: dict[str, int]
    parts: dict[str, np.ndarray]
    share: float = 0.5
    trained: bool = False

    @staticmethod
    def fresh(words: dict[str, int], odds: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        near = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        parts = {"word": near(len(words) + 2, WORD_DIM), "char": near(CHAR_BUCKETS, CHAR_DIM)}
        parts["word"][:, 0] = np.concatenate(([0, 0], odds))
        for d in "fb":
            parts |= {f"in_{d}": near(WORD_DIM + CHAR_DIM, 3 * HIDDEN) * 3, f"re_{d}": near(HIDDEN, 3 * HIDDEN) * 2, f"bias_{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}
        parts |= {"attend": near(2 * HIDDEN), "out": near(2 * HIDDEN), "level": np.zeros(1, dtype=np.float32)}
        return Network(words, parts)

    def number(self, word: str) -> int:
        return self.words.get(word.strip(_EDGES) or word, 1)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Embedding of each word: its own, beside the mean of its trigrams'."""
        ids, begins = char_ids(words)
        chars = np.add.reduceat(self.parts["char"][ids], begins) / np.diff(np.append(begins, len(ids)))[:, None]
        own = self.parts["word"][np.fromiter(map(self.number, words), dtype=np.int64, count=len(words))]
        return np.concatenate([own, chars], axis=1).astype(np.float32)

    def projected(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(inputs @ self.parts[f"in_{d}"] + self.parts[f"bias_{d}"] for d in "fb")

    def states(self, word, n: int, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (step, window, unit) of n windows; word(t): the projected words at step t."""
        re, h = self.parts[f"re_{d}"], np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.empty((WINDOW, n, HIDDEN), dtype=np.float32)
        k = 2 * HIDDEN
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, u = word(t), h @ re
            gates = _sigmoid(x[:, :k] + u[:, :k])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, k:] + r * u[:, k:])
            if keep is not None:
                keep.append((t, h, u[:, k:], r, z, new))
            h = new + z * (h - new)
            out[t] = h
        return out

    def pooled(self, both: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights (step, window) and the pooled states."""
        a = both @ self.parts["attend"]
        a = np.where(mask, a, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        return a, np.einsum("tb,tbk->bk", a, both)

    def logits(self, proj: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """A logit for each window of word rows; row 0 is padding."""
        both = np.concatenate([self.states(lambda t, p=p: p[ids[:, t]], len(ids), d) for p, d in zip(proj, "fb", strict=True)], axis=2)
        return self.pooled(both, ids.T > 0)[1] @ self.parts["out"] + self.parts["level"][0]

    def logits_along(self, proj: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """A logit for the window that starts at each of the word rows but the last WINDOW - 1; each word is looked up once.

        The same as logits(), with units as rows and windows as columns, so that every operation runs over long contiguous stretches.
        """
        n, k, half = len(rows) - WINDOW + 1, 2 * HIDDEN, np.float32(0.5)
        told = np.stack([self.parts["attend"], self.parts["out"]])  # what a state says to the attention and to the score
        said = np.zeros((WINDOW, 2, n), dtype=np.float32)
        for i, (p, d) in enumerate(zip(proj, "fb", strict=True)):
            own, re, side = np.ascontiguousarray(p[rows].T), np.ascontiguousarray(self.parts[f"re_{d}"].T), np.ascontiguousarray(told[:, i * HIDDEN : (i + 1) * HIDDEN])
            h = np.zeros((HIDDEN, n), dtype=np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x, u = own[:, t : t + n], re @ h
                gates = (x[:k] + u[:k]) * half
                np.tanh(gates, out=gates)
                gates *= half
                gates += half
                new = gates[:HIDDEN] * u[k:]
                new += x[k:]
                np.tanh(new, out=new)
                h -= new
                h *= gates[HIDDEN:]
                h += new
                said[t] += side @ h
        mask = np.lib.stride_tricks.sliding_window_view(rows > 0, n)
        a = np.where(mask, said[:, 0], np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        return (a * said[:, 1]).sum(axis=0) + self.parts["level"][0]

    def gradients(self, rows: np.ndarray, ids: np.ndarray, target: np.ndarray, word_of: np.ndarray, chars: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean cross entropy. rows: inputs of the word rows; word_of, chars: what those are made of."""
        p, g = self.parts, {}
        kept = {d: [] for d in "fb"}
        proj = self.projected(rows)
        both = np.concatenate([self.states(lambda t, q=q: q[ids[:, t]], len(ids), d, kept[d]) for q, d in zip(proj, "fb", strict=True)], axis=2)
        mask = ids.T > 0
        a, pool = self.pooled(both, mask)
        err = ((_sigmoid(pool @ p["out"] + p["level"][0]) - target) / len(target)).astype(np.float32)
        g["out"], g["level"] = err @ pool, err.sum(keepdims=True)
        d_pool = err[:, None] * p["out"]
        d_a = np.einsum("tbk,bk->tb", both, d_pool)
        d_s = a * (d_a - (a * d_a).sum(axis=0))
        g["attend"] = np.einsum("tb,tbk->k", d_s, both)
        d_both = a[:, :, None] * d_pool + d_s[:, :, None] * p["attend"]
        d_rows, k = np.zeros_like(rows), 2 * HIDDEN
        for i, d in enumerate("fb"):
            d_own = d_both[:, :, i * HIDDEN : (i + 1) * HIDDEN]
            d_proj, d_re, d_h = np.zeros_like(proj[i]), np.zeros_like(p[f"re_{d}"]), np.zeros((len(ids), HIDDEN), dtype=np.float32)
            for t, h, un, r, z, new in reversed(kept[d]):
                d_h = d_h + d_own[t]
                d_n = d_h * (1 - z) * (1 - new * new)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_u = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_re += h.T @ d_u
                np.add.at(d_proj, ids[:, t], np.concatenate([d_r, d_z, d_n], axis=1))
                d_h = d_h * z + d_u @ p[f"re_{d}"].T
            g[f"re_{d}"], g[f"bias_{d}"], g[f"in_{d}"] = d_re, d_proj.sum(axis=0), rows.T @ d_proj
            d_rows += d_proj @ p[f"in_{d}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], word_of, d_rows[:, :WORD_DIM])
        at, begins = chars
        sizes = np.diff(np.append(begins, len(at)))
        np.add.at(g["char"], at, np.repeat(d_rows[1:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        g["word"][0] = 0
        return g


class _Rows(dict):
    """Numbers words as they come, from 1 on."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self) + 1
        return out


class Scorer:
    """Scores texts; keeps the projected inputs of the words met so far, a bounded number of them."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.rows, self.done = _Rows(), 0
        self.proj = [np.zeros((1, 3 * HIDDEN), dtype=np.float32) for _ in "fb"]
        self.proj = [p + self.net.parts[f"bias_{d}"] for p, d in zip(self.proj, "fb", strict=True)]
        self.size = 1

    def _fill(self) -> None:
        if len(self.rows) == self.done:
            return
        fresh = list(self.rows)[self.done :] if self.done else list(self.rows)
        n = -len(fresh) % _STEP  # as many rows each time, so that a word's numbers don't depend on the words beside it
        new = [x[: len(fresh)] for x in self.net.projected(np.pad(self.net.inputs(fresh), ((0, n), (0, 0))))]
        for i in range(2):
            if self.size + len(fresh) > len(self.proj[i]):
                room = np.empty((2 * (self.size + len(fresh)), 3 * HIDDEN), dtype=np.float32)
                room[: self.size] = self.proj[i][: self.size]
                self.proj[i] = room
            self.proj[i][self.size : self.size + len(fresh)] = new[i]
        self.size += len(fresh)
        self.done = len(self.rows)

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of the texts, and the number of windows of each."""
        found = [np.fromiter(map(self.rows.__getitem__, w), dtype=np.int64, count=len(w)) for w in map(tokens, texts)]
        self._fill()
        padded = [np.pad(x, (0, max(0, WINDOW - len(x)))) for x in found]
        sizes = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
        rows = np.concatenate([*padded, np.zeros(-(int(sizes.sum()) - WINDOW + 1) % _STEP, dtype=np.int64)]) if padded else np.empty(0, dtype=np.int64)
        out = [self.net.logits_along(self.proj, rows[i : i + _STEP + WINDOW - 1]) for i in range(0, len(rows) - WINDOW + 1, _STEP)]
        # windows that reach into the next text are left out
        keep = np.ones(int(sizes.sum()), dtype=bool)
        for k in range(1, WINDOW):
            keep[np.cumsum(sizes) - k] = False
        return np.concatenate(out)[: len(keep) - WINDOW + 1][keep[: len(keep) - WINDOW + 1]] if out else np.empty(0, dtype=np.float32), sizes - WINDOW + 1

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        if len(self.rows) > _HELD_WORDS:
            self.reset()
        logits, counts = self.window_logits(texts)
        return np.round(_sigmoid(np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64)), 7)


def fit(docs: list[str], toxic: list[int]) -> Network:
    """Train on whole texts. Each epoch learns from the windows that score highest now, of toxic and of clean documents, and a random one of each clean document.

    With labels of one class only (or none) the network is untrained and scores are the smoothed share of toxic labels.
    """
    y = np.array(toxic, dtype=np.float32)
    share = (sum(toxic) + 0.5) / (len(toxic) + 1)
    split = [tokens(t) for t in docs]
    seen: dict[str, list[int]] = {}
    for w, label in zip(split, toxic, strict=True):
        for x in {v.strip(_EDGES) or v for v in w}:
            seen.setdefault(x, [0, 0])[label] += 1
    kept = sorted((w for w, c in seen.items() if sum(c) >= LEAST_DOCS), key=lambda w: (-sum(seen[w]), w))[:MOST_WORDS]
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    c = np.array([seen[w] for w in kept], dtype=np.float64).reshape(-1, 2)
    odds = np.log((c[:, 1] + 0.5) / (n1 + 1)) - np.log((c[:, 0] + 0.5) / (n0 + 1))
    # words of few documents tell little, whatever their odds
    odds = np.clip(odds * (c.sum(axis=1) / (c.sum(axis=1) + 5)), -3, 3).astype(np.float32)
    net = Network.fresh({w: i + 2 for i, w in enumerate(kept)}, odds)
    net.share = share
    if len(set(toxic)) < 2:
        return net
    rng = np.random.default_rng(SEED)
    names = _Rows()
    found = [np.fromiter(map(names.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]
    words = list(names)
    word_of = np.array([0, *map(net.number, words)], dtype=np.int64)
    weight = np.concatenate(([0, 0], odds))[word_of]
    views = [np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, WINDOW - len(x)))), WINDOW)[_windows(len(x))] for x in found]
    score = [weight[v].clip(0).sum(axis=1) for v in views]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.parts.items()}
    step = 0
    ids, begins = char_ids(words)
    ends = np.append(begins[1:], len(ids))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // (len(docs) + int(n0))))
    for epoch in range(epochs):
        picks = [(v[np.argmax(s)], label) for v, s, label in zip(views, score, toxic, strict=True)]
        picks += [(v[rng.integers(len(v))], 0) for v, label in zip(views, toxic, strict=True) if not label]
        order = rng.permutation(len(picks))
        for i in range(0, len(order), BATCH):
            chosen = [picks[j] for j in order[i : i + BATCH]]
            batch, target = np.stack([v for v, _ in chosen]), np.array([t for _, t in chosen], dtype=np.float32)
            used, at = np.unique(np.append(0, batch), return_inverse=True)  # row 0 stays the padding
            at = at[1:].reshape(batch.shape)
            real = used[1:] - 1
            chars = np.concatenate([ids[begins[r] : ends[r]] for r in real]) if len(real) else ids[:0]
            first = np.cumsum([0, *(ends[real] - begins[real])[:-1]]) if len(real) else begins[:0]
            rows = np.zeros((len(used), WORD_DIM + CHAR_DIM), dtype=np.float32)
            if len(real):
                rows[1:, :WORD_DIM] = net.parts["word"][word_of[used[1:]]]
                rows[1:, WORD_DIM:] = np.add.reduceat(net.parts["char"][chars], first) / (ends[real] - begins[real])[:, None]
            g = net.gradients(rows, at, target, word_of[used], (chars, first))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            net.trained = True
            for k, grad in g.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.parts[k] = (net.parts[k] - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        if epoch + 1 < epochs:
            scorer, score = Scorer(net), []
            for i in range(0, len(docs), 500):
                logits, counts = scorer.window_logits(docs[i : i + 500])
                score += np.split(logits, np.cumsum(counts)[:-1])
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Fit on at most per_class labelled documents of each class; neither null labels, texts of unknown ids nor held-out rows are used.

    The sample's ids are bounded, so they are sent to the scan of the documents; of repeated ids one text is taken.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)").where(~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    chosen = []
    for c in (0, 1):
        chosen += known.where(F.col("toxic") == c).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class).collect()
    if not chosen:
        return fit([], [])
    sample = F.broadcast(spark.createDataFrame(chosen, "label_id long, toxic int"))
    rows = texts(docs).join(sample, F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic").collect()
    rows.sort(key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    return fit([r.text for r in rows], [r.toxic for r in rows])


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each whole text; null and empty texts have one empty window. Scores are told to 7 places; sums of single precision depend on what else is in a batch, so about one equal text in 2,000 differs in the last place."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    share = None if net.trained else net.share

    def run(batches):
        scorer = Scorer(model.value)
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 256):
                part = b.column("text").slice(i, 256).to_pylist()
                out.append(scorer.scores(part) if share is None else np.full(len(part), share))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
