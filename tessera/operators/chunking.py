"""Cutting texts into chunks. Windows of tokens and sentences stay in the JVM; greedy and recursive cuts run a text at a time in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

SCHEMA = "doc_id long, chunk_index long, text string"


def chunk_id(index: Column | str, body: Column | str) -> Column:
    """The first 12 hex digits of the md5 of place and first 100 characters."""
    return F.substring(F.md5(F.concat_ws(":", index, F.substring(body, 1, 100)).cast("binary")), 1, 12)


def windows(items: Column, size: int, overlap: int) -> Column:
    """Arrays of `size` items, each sharing `overlap` with the one before; the last ends with the items."""
    step = size - overlap
    n = F.size(items)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i + 1, size))


def token_chunks(docs: DataFrame, size: int = 600, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, tokens, text: windows of white-space tokens."""
    items = docs.select("doc_id", text.words("text").alias("items"))  # split once, not for each window
    rows = items.select("doc_id", F.posexplode(windows(F.col("items"), size, overlap)).alias("chunk_index", "w"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("w").cast("long").alias("tokens"), F.array_join("w", " ").alias("text"))


def sentence_chunks(docs: DataFrame, size: int = 5, overlap: int = 1) -> DataFrame:
    items = docs.select("doc_id", text.sentences("text").alias("items"))
    rows = items.select("doc_id", F.posexplode(windows(F.col("items"), size, overlap)).alias("chunk_index", "w"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("w").cast("long").alias("sentences"), F.array_join("w", " ").alias("text"))


def stride_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of characters at a fixed stride."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    rows = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start_char"), F.expr(f"substring(text, start + 1, {size})").alias("text"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, lines: lines grouped under the header above them (numbered, "Section n:", or all capitals); 0 before the first."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    header = F.col("line").rlike(r"^(?:Section \d+:|\d+(?:\.\d+)* [A-Z]|[A-Z][A-Z !]{3,}$)")
    rows = lines.withColumn("section", F.sum(header.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    return rows.groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.count(F.lit(1)).alias("lines"), F.min_by("line", "line_no").alias("title"), F.sum(F.length("line")).alias("characters"))


def _each(docs: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, at, out = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for k, c in enumerate(cut(t.as_py() or "")):
                    ids.append(i)
                    at.append(k)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(at, type=pa.int64()), pa.array(out, type=pa.string())], names=["doc_id", "chunk_index", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def cut_at_blanks(body: str, size: int, overlap: int) -> list[str]:
    """Windows of characters that end at the last blank of their second half; each goes on `overlap` characters before the end of the last."""
    out, start = [], 0
    while start < len(body):
        end = min(len(body), start + size)
        if end < len(body) and (blank := body.rfind(" ", start + size // 2, end)) > 0:
            end = blank
        out.append(body[start:end].strip())
        if end == len(body):
            break
        start = max(start + 1, end - overlap)
    return [x for x in out if x]


SEPARATORS = ["\n\n", "\n", "。", ".", "؟", ".", " ", ""]


def cut_recursively(body: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces at the first separator that occurs, those too long at the next, packed up to `size`, with the end of each before the next."""
    sep = next((s for s in separators if s == "" or s in body), "")
    rest = separators[separators.index(sep) + 1 :]
    pieces = [body[i : i + size] for i in range(0, len(body), size)] if sep == "" else [p + sep for p in body.split(sep)[:-1]] + [body.split(sep)[-1]]
    small = []
    for p in pieces:
        small += cut_recursively(p, size, 0, rest) if len(p) > size and rest else [p]
    out, held = [], ""
    for p in small:
        if held and len(held) + len(p) > size:
            out.append(held)
            held = held[-overlap:] if overlap else ""
            if len(held) + len(p) > size:
                held = held[len(held) + len(p) - size :] if len(p) < size else ""
        held += p
    if held.strip():
        out.append(held)
    return [x.strip() for x in out if x.strip()]


def sentences_of(body: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?؟])\s+", body) if s.strip()]


def pack_sentences(body: str, size: int, overlap: int) -> list[str]:
    """Whole sentences up to `size` characters; a chunk begins with the last sentences of the one before, up to `overlap`."""
    out, held = [], []
    for s in sentences_of(body):
        if held and sum(map(len, held)) + len(held) + len(s) > size:
            out.append(" ".join(held))
            tail, n = [], 0
            for x in reversed(held):
                if n + len(x) > overlap:
                    break
                tail.insert(0, x)
                n += len(x)
            held = tail
        held.append(s)
    return [*out, " ".join(held)] if held else out


def word_vector(sentence: str, size: int = 64) -> np.ndarray:
    """A sentence as a hashed bag of words of length 1, for merging without a model."""
    v = np.zeros(size)
    for w in sentence.lower().split():
        v[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % size] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def merge_similar(body: str, threshold: float = 0.7, most: int = 800, least: int = 100, embed: Callable[[str], np.ndarray] = word_vector, renormalise: bool = True) -> list[str]:
    """Semantic chunks: the next sentence joins while it is like the running mean and there is room; small chunks join the one before."""
    groups: list[list[str]] = []
    mean, n = None, 0
    for s in sentences_of(body):
        v = embed(s)
        words = len(s.split())
        if groups and n + words <= most and float(mean @ v) >= threshold:
            groups[-1].append(s)
            k = len(groups[-1])
            mean = (mean * (k - 1) + v) / k
            if renormalise and np.linalg.norm(mean):
                mean = mean / np.linalg.norm(mean)
            n += words
        else:
            groups.append([s])
            mean, n = v, words
    out: list[list[str]] = []
    for g in groups:
        if out and sum(len(s.split()) for s in g) < least:
            out[-1] += g
        else:
            out.append(g)
    return [" ".join(g) for g in out]


def late_boundaries(body: str, least: int = 100, most: int = 512) -> list[str]:
    """Chunks between paragraph and sentence ends, grown to at least `least` words and cut before `most`."""
    units = [s for p in body.split("\n\n") for s in sentences_of(p)]
    out, held = [], []
    for u in units:
        if held and len(" ".join(held).split()) + len(u.split()) > most:
            out.append(" ".join(held))
            held = []
        held.append(u)
        if len(" ".join(held).split()) >= least:
            out.append(" ".join(held))
            held = []
    return [*out, " ".join(held)] if held else out


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tokens": token_chunks,
    "sentences": sentence_chunks,
    "stride": stride_chunks,
    "blanks": lambda d: _each(d, lambda t: cut_at_blanks(t, 1000, 200)),
    "recursive": lambda d: _each(d, lambda t: cut_recursively(t, 1000, 200)),
    "packed": lambda d: _each(d, lambda t: pack_sentences(t, 1000, 100)),
    "semantic": lambda d: _each(d, merge_similar),
    "late": lambda d: _each(d, late_boundaries),
}
#: Strategy by content type.
BY_CONTENT = {"youtube": "semantic", "webpage": "recursive", "pdf": "late", "policy": "packed"}


def chunks(docs: DataFrame, strategy: str) -> DataFrame:
    """Chunks by a strategy's name, or by a content type's."""
    return STRATEGIES[BY_CONTENT.get(strategy, strategy)](docs)
