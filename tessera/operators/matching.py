"""Many names in many texts: names and texts meet by equal runs of words, never text by name."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of the longest name that is looked for.
MOST_WORDS = 8
#: Bits of the filter that says which words begin a name: what is sent to the tasks, whatever the number of names.
FILTER_BITS = 1 << 23
#: Runs of words that a task holds before it sends them on.
HELD_RUNS = 200_000
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def keyed(names: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """name, run (its words joined by one space), length in words, first (its first word): each name of the column `name` once.

    Names without words, or with more than `most_words`, are never found and left out.
    """

    def run(batches):
        for b in batches:
            split = [(n, words(n)) for n in b.column("name").to_pylist() if n is not None]
            split = [(n, w) for n, w in split if 0 < len(w) <= most_words]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in split], pa.string()), pa.array([" ".join(w) for _, w in split], pa.string()), pa.array([len(w) for _, w in split], pa.int32()), pa.array([w[0] for _, w in split], pa.string())], names=["name", "run", "length", "first"])

    return names.select("name").distinct().mapInArrow(run, "name string, run string, length int, first string")


def _filter(keys: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """A bit for each first word's CRC, and the lengths that occur: at most bits / 8 bytes and a few numbers reach the driver, built up by the tasks."""
    place = F.crc32(F.col("first").cast("binary")) % bits + 1  # buckets and positions count from 1
    parts = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for p in parts:
        data, at = np.frombuffer(p.bits, dtype=np.uint8), (p.bucket - 1) * 4096
        out[at : at + 4096] |= data[: len(out) - at]
    return out, sorted(r.length for r in keys.select("length").distinct().collect())


def linked(texts: DataFrame, names: DataFrame, most_words: int = MOST_WORDS, bits: int = FILTER_BITS) -> DataFrame:
    """kind, text_id, name, n, first: every name (column name) that a text (kind, text_id, text) holds as whole words, how often, and the place of the word where it first begins.

    Case and what stands between words don't count; overlapping names all count; of equal runs every spelling is told. Texts are read once, by
    slices of their words; only runs that begin with some name's first word leave the task, each once for a text, and meet the names by
    equality. Null texts and names hold nothing; rows of one (kind, text_id) are told each.
    """
    keys = keyed(names, most_words)
    held, lengths = _filter(keys, bits)

    def runs(batches):
        def told():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "text_id", "run", "n", "first"])

        begins: dict[str, bool] = {}
        out = []
        for b in batches:
            for kind, i, t in zip(b.column("kind").to_pylist(), b.column("text_id").to_pylist(), b.column("text"), strict=True):
                w = words(t.as_py() or "")
                n, first = Counter(), {}
                for at, word in enumerate(w):
                    known = begins.get(word)
                    if known is None:
                        if len(begins) > 500_000:
                            begins.clear()
                        place = zlib.crc32(word.encode()) % bits
                        known = begins[word] = bool(held[place >> 3] >> (place & 7) & 1)
                    if known:
                        for length in lengths:
                            if at + length <= len(w):
                                run = " ".join(w[at : at + length])
                                n[run] += 1
                                first.setdefault(run, at)
                out += [(kind, i, r, c, first[r]) for r, c in n.items()]
                if len(out) > HELD_RUNS:
                    yield told()
                    out = []
        if out:
            yield told()

    found = texts.select("kind", F.col("text_id").cast("long").alias("text_id"), "text").mapInArrow(runs, "kind string, text_id long, run string, n long, first long")
    return found.join(keys.select("run", "name"), "run").select("kind", "text_id", "name", "n", "first")


def longest(found: DataFrame, k: int = 3) -> DataFrame:
    """Of each text's names (linked()) the k longest, ties by name, with rank."""
    w = Window.partitionBy("kind", "text_id").orderBy(F.desc(F.length("name")), "name")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
