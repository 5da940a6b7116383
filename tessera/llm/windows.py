"""Substring dedup: every window of 50 words gets a Rabin-Karp hash; windows that an earlier document has go."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import byte_pieces, shuffle_parts, table

#: Words of a window.
WINDOW = 50
#: Window hashes that a task holds before it deals them out, and about how many of all meet in a bucket.
HELD_WINDOWS, BUCKET_WINDOWS = 1_000_000, 1_000_000
#: Words hashed at a time, of one text.
SPAN = 1 << 18
#: Multipliers of the two hashes: one is the window's name, the other deals it to a bucket. Windows are taken for equal if both agree.
NAME, PLACE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: A null id stands behind all others.
LAST = 2**63 - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


@lru_cache(maxsize=4)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse, modulo 2**64."""
    n = SPAN + WINDOW
    up, down = (np.full(n, x, dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def rolled(words: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of each window of the word hashes, by differences of one running sum."""
    n = len(words) - WINDOW + 1
    up, down = _powers(base)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * down[: len(words)], out=sums[1:])
    return (sums[WINDOW:] - sums[:n]) * up[WINDOW - 1 : WINDOW - 1 + n]


def window_hashes(data: bytes):
    """Names and places of the text's windows in order, some at a time."""
    look, held = _words().__getitem__, np.empty(0, dtype=np.uint64)
    for piece in byte_pieces(data):
        words = piece.split()
        for i in range(0, len(words), SPAN):
            part = words[i : i + SPAN]
            held = np.concatenate([held, np.fromiter(map(look, part), dtype=np.uint64, count=len(part))])
            for j in range(0, len(held) - WINDOW + 1, SPAN):
                span = held[j : j + SPAN + WINDOW - 1]
                yield rolled(span, NAME), rolled(span, PLACE) >> np.uint64(16)
            held = held[max(0, len(held) - WINDOW + 1) :]


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, dtype=np.int64)


def parts_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """The part that each document's text is dealt to; _part() is the same as a column."""
    each, at = np.unique(doc, return_inverse=True)
    return np.fromiter((zlib.crc32(b"%d" % x) % parts for x in each.tolist()), dtype=np.int64, count=len(each))[at]


def _part(key: str, parts: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def _packed(bucket: np.ndarray, doc: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its documents, how many windows each has there, and the windows, document by document."""
    order = np.lexsort((doc, bucket))
    bucket, doc, name = bucket[order], doc[order], name[order]
    at = [*_runs(bucket).tolist(), len(bucket)]
    out = []
    for lo, hi in zip(at, at[1:], strict=False):
        firsts = _runs(doc[lo:hi])
        out.append((int(bucket[lo]), doc[lo:hi][firsts].tobytes(), np.diff(np.append(firsts, hi - lo)).astype(np.int32).tobytes(), name[lo:hi].tobytes()))
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "docs", "counts", "names"])


def _unpacked(docs: list, counts: list, names: list) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.concatenate(docs), np.concatenate(counts)), np.concatenate(names)


def _dealt(buckets: int):
    """Windows to buckets. Of a window that several of the task's documents have only the least document's goes there; for the others it is decided (buckets below 0, by the document's part)."""

    def flush(docs, names, places):
        doc = np.repeat(np.array(docs, dtype=np.int64), [len(x) for x in names])
        name, bucket = np.concatenate(names), (np.concatenate(places) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket, name))
        doc, name, bucket = doc[order], name[order], bucket[order]
        first = np.concatenate([[True], (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])])
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        again = np.concatenate([[False], ~first[1:] & (doc[1:] == doc[:-1])])
        later = (doc > least) & ~again
        yield _packed(bucket[first], doc[first], name[first])
        if later.any():
            yield _packed(-1 - parts_of(doc[later], buckets), doc[later], name[later])

    def run(batches):
        docs, names, places, held = [], [], [], 0
        for b in batches:
            for i, data in zip(b.column("doc_key").to_pylist(), b.column("data"), strict=True):
                for name, place in window_hashes(data.as_py()):
                    docs.append(i)
                    names.append(name)
                    places.append(place)
                    held += len(name)
                    if held >= HELD_WINDOWS:
                        yield from flush(docs, names, places)
                        docs, names, places, held = [], [], [], 0
        if held:
            yield from flush(docs, names, places)

    return run


def _judged(buckets: int):
    """Of each bucket, the windows that a document shares with one of a smaller id, packed by the document's part."""

    def later(docs, counts, names):
        doc, name = _unpacked(docs, counts, names)
        order = np.argsort(name, kind="stable")
        starts = _runs(name[order])
        least = np.empty(len(doc), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(doc))))
        return doc[doc > least], name[doc > least]

    def told(found):
        doc, name = (np.concatenate(x) for x in zip(*found, strict=True))
        return _packed(parts_of(doc, buckets), doc, name)

    def run(batches):
        at, held, found, size = None, ([], [], []), [], 0
        for b in batches:
            for bucket, *row in zip(*(b.column(c) for c in ("bucket", "docs", "counts", "names")), strict=True):
                bucket, row = bucket.as_py(), [np.frombuffer(x.as_py(), dtype=kind) for x, kind in zip(row, (np.int64, np.int32, np.uint64), strict=True)]
                if bucket != at and held[0]:
                    found.append(later(*held))
                    size += len(found[-1][0])
                    held = ([], [], [])
                at = bucket
                if bucket < 0:  # decided by a task before
                    found.append(_unpacked(*([x] for x in row)))
                    size += len(found[-1][0])
                else:
                    for to, x in zip(held, row, strict=True):
                        to.append(x)
                if size >= HELD_WINDOWS:
                    yield told(found)
                    found, size = [], 0
        if held[0]:
            found.append(later(*held))
        if any(len(d) for d, _ in found):
            yield told(found)

    return run


def repeated_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """part, docs, counts, names: the windows that a document (doc_key, data) shares with one of a smaller key, packed by the documents' parts.

    A window is counted in its bucket; buckets are met one at a time within a task. A task sends one row's worth of a window however
    many of its documents have it, so a passage of very many documents is no hot key.
    """
    dealt = docs.mapInArrow(_dealt(buckets), "bucket long, docs binary, counts binary, names binary")
    judged = dealt.repartition(shuffle_parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_judged(buckets), "bucket long, docs binary, counts binary, names binary")
    return judged.withColumnRenamed("bucket", "part")


def intervals(data: bytes, names: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs (start, end) of words covered by the text's windows of these names."""
    names, at, covered = np.unique(names), 0, []
    for name, _ in window_hashes(data):
        found = np.searchsorted(names, name)
        hit = at + np.flatnonzero(names[np.minimum(found, len(names) - 1)] == name)
        if len(hit):
            cuts = np.flatnonzero(np.diff(hit) > WINDOW) + 1
            covered += [(int(x[0]), int(x[-1]) + WINDOW) for x in np.split(hit, cuts)]
        at += len(name)
    out = []
    for lo, hi in covered:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept_words(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """How many words the text has, and those outside the spans, joined by one space."""
    at, kept, left = 0, [], list(reversed(spans))
    for piece in byte_pieces(data):
        words = piece.split()
        lo, end = 0, at + len(words)
        part = []
        while left and left[-1][0] < end:
            part += words[lo : max(lo, left[-1][0] - at)]
            lo = min(len(words), left[-1][1] - at)
            if left[-1][1] > end:
                break
            left.pop()
        part += words[lo:]
        if part:
            kept.append(b" ".join(part))
        at = end
    return at, b" ".join(kept)


_OUT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def _removed(batches):
    """Texts of a part behind the windows that its documents lose."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def told(rows):
        cols = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*cols[:3], cols[3].cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    at, held, doc, name = None, ([], [], []), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    for b in batches:
        rows, size = [], 0
        for part, i, key, data, *row in zip(*(b.column(c) for c in ("part", "doc_id", "doc_key", "data", "docs", "counts", "names")), strict=True):
            if part.as_py() != at:
                at, held, doc, name = part.as_py(), ([], [], []), doc[:0], name[:0]
            if not key.is_valid:
                for to, x, kind in zip(held, row, (np.int64, np.int32, np.uint64), strict=True):
                    to.append(np.frombuffer(x.as_py(), dtype=kind))
                continue
            if held[0]:
                doc, name = _unpacked(*held)
                order = np.argsort(doc, kind="stable")
                doc, name, held = doc[order], name[order], ([], [], [])
            lo, hi = np.searchsorted(doc, key.as_py()), np.searchsorted(doc, key.as_py(), side="right")
            data = data.as_py()
            spans = intervals(data, name[lo:hi]) if hi > lo else []
            n, kept = kept_words(data, spans)
            rows.append((i.as_py(), n, [{"start": lo, "end": hi} for lo, hi in spans], kept))
            size += len(kept)
            if size > 1 << 26:
                yield told(rows)
                rows, size = [], 0
        if rows:
            yield told(rows)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans, kept: the words of each text that no earlier document's window covers, joined by one space.

    Words are what ASCII white space parts, unchanged. A window is WINDOW consecutive words; a span is a maximal run of words covered
    by windows that a document with a smaller id has too, judged on the input. Rows of one id don't take from each other, and each
    loses what smaller ids have; a null id counts as the largest. Null texts have no words; texts shorter than a window stay whole; an
    empty table gives an empty one; other columns are left behind. Windows are equal if 64 bits of name and the bucket (at least as
    many as the input needs) agree: fewer than one in 100 TB is expected to be taken wrongly.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("doc_key", F.coalesce("doc_id", F.lit(LAST)))
    n = shuffle_parts(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(4 * n, -(-size // (5 * BUCKET_WINDOWS)))
    null = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    texts = rows.select(_part("doc_key", buckets).alias("part"), F.lit(1).alias("turn"), "doc_id", "doc_key", "data", *null("binary", "docs", "counts", "names"))
    gone = repeated_windows(rows.select("doc_key", "data"), buckets).select("part", F.lit(0).alias("turn"), *null("long", "doc_id", "doc_key"), *null("binary", "data"), "docs", "counts", "names")
    return texts.unionByName(gone).repartition(n, "part").sortWithinPartitions("part", "turn").mapInArrow(_removed, _OUT)


def removed_words(spans: Column | str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", removed_words("spans").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
  m AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h HAVING min(doc_id) != max(doc_id)), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM w JOIN m USING (h) WHERE doc_id > least),
  n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (last IS NULL OR last < i - 1) AS n_spans FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM g) GROUP BY doc_id),
  x AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM d), k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
  SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
