"""Suffix-array dedup by blockwise construction with a difference cover.

Every `width`-byte string is filed under its anchor, the least-hashed `gram`-byte string in it, so equal strings lie in one
block, and so do whole stretches of strings that follow each other. Stretches whose anchor occurs once are done. The bytes of
the others are brought together by block, equal ones merged, and a bounded set of blocks at a time becomes one text, whose
suffixes are sorted: one bucket of leading bytes at a time, by the first PERIOD bytes, and longer ties by the ranks of
cover-sample suffixes, which are computed beforehand. Neighbours in that order with `width` bytes in common are the repeats.
Hashes only bring strings together; bytes decide, but for texts that are equal as a whole, which SHA-256 tells.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget, shuffle_parts, stored, table, tidy

WIDTH, GRAM = 100, 32
#: Period of the difference cover, in bytes, a multiple of 8.
PERIOD = 32
#: Anchors that one bucket of the first shuffle should hold, and bytes of one bucket of the second.
BUCKET_ANCHORS, BUCKET_BYTES = 1_500_000, 12_000_000
#: Bytes of blocks that are sorted as one text (a larger block is one on its own), and suffixes of a bucket of leading bytes from which it is split by a further byte.
TEXT_BYTES, BUCKET_SUFFIXES = 4_000_000, 200_000
#: Documents (two numbers each) up to which a list of them is sent to all tasks; a longer one is joined by shuffle.
SENT_ROWS = 500_000
_SEGMENT = 1 << 16
_NO_ID = 1 << 62


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all gram-byte strings (gram: a power of 2), each level joining two halves."""
    h, n = _bytes_table()[data], 1
    while n < gram:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
        n *= 2
    return h


def runs(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a text's bytes: first and last start, anchor and anchor's hash of each run of starts with one anchor."""
    if len(data) < width:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = gram_hashes(data, gram)
    span = width - gram + 1
    top = mixed(h) & ~np.uint64(_SEGMENT - 1)
    parts = []
    step = _SEGMENT - span  # segments overlap, so that each start's window lies in one
    for at in range(0, len(h) - span + 1, step):
        m = top[at : at + step + span - 1] | np.arange(min(step + span - 1, len(h) - at), dtype=np.uint64)
        n = 1
        while 2 * n <= span:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if n < span:
            m = np.minimum(m[: n - span], m[span - n :])
        parts.append((m & np.uint64(_SEGMENT - 1)).astype(np.int64) + at)
    anchor = np.concatenate(parts)
    begins = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = begins, np.append(begins[1:], len(anchor)) - 1
    anchor = anchor[begins]
    return first, last, anchor, mixed(h[anchor] + np.uint64(1))


_ENTRY = np.dtype([("block", "<u8"), ("doc", "<u2"), ("first", "<u4"), ("more", "u1")])
_RUN = np.dtype([("start", "<u4"), ("more", "u1"), ("block", "<u8")])
_PIECE = np.dtype([("block", "<u8"), ("id", "<i8"), ("key", "<i8"), ("start", "<u4"), ("size", "u1")])
_KNOWN = 65535


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    by = np.argsort(values, kind="stable")
    twice = values[by][1:] == values[by][:-1]
    out = np.zeros(len(values), dtype=bool)
    out[by] = np.concatenate(([False], twice)) | np.concatenate((twice, [False])) if len(values) else False
    return out


def _asked(docs: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """doc_id, text_key, runs (packed _RUN): runs of starts whose anchor occurs elsewhere too; rows of a document may be several.

    Anchors travel as packed arrays, a row for each bucket and batch. Anchors repeated in a batch are told at once, and one of each
    goes on, for the other batches.
    """
    schema = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64())])

    def packed(ids, keys, doc, rows):
        """A row of runs for each document; rows in the documents' order."""
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        data = [rows[i:j].tobytes() for i, j in zip(at, [*at[1:], len(doc)], strict=True)]
        return pa.array(ids[doc[at]], mask=ids[doc[at]] == _NO_ID), pa.array(keys[doc[at]]), pa.array(data, type=pa.binary())

    def emit(batches):
        for big in batches:
            for at in range(0, big.num_rows, 50_000):
                b = big.slice(at, 50_000)
                ids, keys = b.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False), b.column("text_key").to_numpy(zero_copy_only=False)
                found = [runs(np.frombuffer(t.as_buffer(), dtype=np.uint8), width, gram) for t in b.column("text")]
                doc = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                if not len(doc):
                    continue
                first, last, block = (np.concatenate([x[k] for x in found]) for k in (0, 1, 3))
                again = _repeated(block)
                if again.any():
                    rows = np.empty(int(again.sum()), dtype=_RUN)
                    rows["start"], rows["more"], rows["block"] = first[again], (last - first)[again], block[again]
                    told = packed(ids, keys, doc[again], rows)
                    k = len(told[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, -1)), pa.nulls(k, pa.binary()), told[2], told[0], told[1]], schema=schema)
                _, one = np.unique(block, return_index=True)
                known = again[one]
                doc, first, last, block = doc[one], first[one], last[one], block[one]
                bucket = (mixed(block) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                out = np.empty(len(by), dtype=_ENTRY)
                out["block"], out["doc"], out["first"], out["more"] = block[by], np.where(known, _KNOWN, doc)[by], first[by], (last - first)[by]
                kinds, start = np.unique(bucket[by], return_index=True)
                tables, rows = [], []
                for i, j in zip(start, [*start[1:], len(by)], strict=True):
                    part = out[i:j]
                    own = part["doc"] != _KNOWN
                    used, number = np.unique(part["doc"][own], return_inverse=True)
                    part["doc"][own] = number
                    tables.append(ids[used].tobytes() + keys[used].tobytes())
                    rows.append(part.tobytes())
                null = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(tables, type=pa.binary()), pa.array(rows, type=pa.binary()), null, null], schema=schema)

    def meet(batches):
        at, held = None, []

        def close():
            e = np.concatenate([x[0] for x in held])
            source = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            pick = np.flatnonzero(_repeated(e["block"]) & (e["doc"] != _KNOWN))
            if len(pick):
                base = np.cumsum([0, *(len(x[1]) for x in held)])[source[pick]]
                ids, keys = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
                doc, e = base + e["doc"][pick], e[pick]
                by = np.argsort(doc, kind="stable")
                rows = np.empty(len(by), dtype=_RUN)
                rows["start"], rows["more"], rows["block"] = e["first"][by], e["more"][by], e["block"][by]
                yield pa.RecordBatch.from_arrays(list(packed(ids, keys, doc[by], rows)), names=["doc_id", "text_key", "runs"])

        for b in batches:
            buckets_of = b.column("bucket").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(buckets_of >= 0).tolist():
                if buckets_of[i] != at and held:
                    yield from close()
                    held = []
                at = buckets_of[i]
                raw = b.column("ids")[i].as_buffer()
                k = raw.size // 16
                held.append((np.frombuffer(b.column("data")[i].as_buffer(), _ENTRY), np.frombuffer(raw, np.int64, k), np.frombuffer(raw, np.int64, k, 8 * k)))
            told = pa.array(np.flatnonzero(buckets_of < 0))
            if len(told):
                yield pa.RecordBatch.from_arrays([b.column(c).take(told) for c in ("doc_id", "text_key", "data")], names=["doc_id", "text_key", "runs"])
        if held:
            yield from close()

    sent = docs.mapInArrow(tidy(emit), "bucket long, ids binary, data binary, doc_id long, text_key long")
    dealt = sent.repartition(buckets, F.when(F.col("bucket") < 0, F.xxhash64("doc_id", "text_key")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(meet), "doc_id long, text_key long, runs binary")


@lru_cache(maxsize=4)
def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in 0 to period - 1 of which any difference modulo period is one of two; and for any two remainders the least shift that takes both into the cover."""
    cover: list[int] = [0]
    missing = set(range(1, period))
    while missing:
        best = max(range(1, period), key=lambda x: (len(missing & {d % period for c in cover for d in (x - c, c - x)}), -x))
        missing -= {d % period for c in cover for d in (best - c, c - best)}
        cover.append(best)
    inside = np.zeros(period, dtype=bool)
    inside[cover] = True
    at = np.arange(period)
    both = inside[(at[:, None, None] + at) % period] & inside[(at[None, :, None] + at) % period]
    return np.array(sorted(cover)), both.argmax(axis=2)


def sample_ranks(words: np.ndarray, size: int, period: int = PERIOD) -> np.ndarray:
    """Ranks, from 1, of the suffixes at the cover's positions, at their positions; 0 elsewhere and behind the end.

    words: the 8 bytes from each position on, as big-endian numbers, zeros behind the end. A sample position's successor `period`
    further on is a sample position too, so what a rank tells doubles with each round, until no two are equal.
    """
    cover, _ = difference_cover(period)
    at = (np.arange(0, size, period)[:, None] + cover).ravel()
    at = at[at < size]
    rank = np.zeros(size + period, dtype=np.int32)
    keys = [words[at + k] for k in range(0, period, 8)]
    reach = period
    while True:
        by = np.lexsort(keys[::-1])
        new = np.zeros(len(at), dtype=bool)
        for k in keys:
            k = k[by]
            new[1:] |= k[1:] != k[:-1]
        if new[1:].all() or reach >= size:
            break
        rank[at[by]] = np.cumsum(new, dtype=np.int32) + 1
        keys = [rank[at], np.where(at + reach < size, rank[np.minimum(at + reach, size)], 0)]
        reach *= 2
    if not new[1:].all():  # zeros at the very end: the shorter suffix is the smaller
        by = np.lexsort((-at, *keys[::-1]))
    rank[at[by]] = np.arange(1, len(at) + 1, dtype=np.int32)
    return rank


def _ties_in_order(pos: np.ndarray, group: np.ndarray, rank: np.ndarray, period: int) -> np.ndarray:
    """pos, in groups that follow each other, sorted within each by the cover sample: merge sort of all groups side by side.

    Two suffixes are compared at the shift that takes both of their positions into the cover.
    """
    _, shift = difference_cover(period)
    shift = shift.ravel()
    residue = pos % period
    n = len(pos)
    place = np.arange(n)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(begin, n))
    base, end = np.repeat(begin, size), np.repeat(begin + size, size)
    order = place.copy()  # sorted place -> row
    run = 1
    while True:
        wide = np.flatnonzero(end - base > run)  # places of groups that have further runs
        if not len(wide):
            return pos[order]
        b, e = base[wide], end[wide]
        own = (wide - b) // run
        left = own % 2 == 0
        low = b + (own + np.where(left, 1, -1)) * run  # the run beside it
        high = np.minimum(low + run, e)
        low = np.minimum(low, high)
        first = low.copy()
        me = order[wide]
        while True:
            going = np.flatnonzero(low < high)
            if not len(going):
                break
            mid = (low[going] + high[going]) >> 1
            x, y = me[going], order[mid]
            d = shift[residue[x] * period + residue[y]]
            a, c = rank[pos[x] + d], rank[pos[y] + d]
            above = (c < a) | (c == a) & ~left[going]  # equal ones of a left run come first
            low[going] = np.where(above, mid + 1, low[going])
            high[going] = np.where(above, high[going], mid)
        to = b + own // 2 * 2 * run + (wide - (b + own * run)) + (low - first)
        order[to] = me
        run *= 2


def repeats(text: np.ndarray, starts: np.ndarray, width: int = WIDTH, period: int = PERIOD, bucket_suffixes: int = BUCKET_SUFFIXES) -> np.ndarray:
    """Which of the starts begin a width-byte string that also begins at a smaller one of them. width: more than period and 8."""
    size = len(text)
    padded = np.concatenate([text, np.zeros(2 * period + 8, dtype=np.uint8)]).astype(np.uint64)
    words = np.zeros(size + 2 * period, dtype=np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    rank = sample_ranks(words, size, period)
    out = np.zeros(size, dtype=bool)
    due = [(starts, 0)]
    while due:
        pos, depth = due.pop()
        if len(pos) > bucket_suffixes and depth < period or depth == 0:
            lead = text[pos + depth]
            by = np.argsort(lead, kind="stable")
            cuts = np.flatnonzero(np.diff(lead[by])) + 1
            due += [(x, depth + 1) for x in np.split(pos[by], cuts)]
            continue
        if len(pos) < 2:
            continue
        keys = [words[pos + k] for k in range(period - 8, -1, -8)]
        by = np.lexsort(keys)
        new = np.zeros(len(pos), dtype=bool)
        new[0] = True
        for k in keys:
            k = k[by]
            new[1:] |= k[1:] != k[:-1]
        pos = pos[by]
        tied = ~new | np.append(~new[1:], False)
        pos, group = pos[tied], np.cumsum(new)[tied]
        if not len(pos):
            continue
        pos = _ties_in_order(pos, group, rank, period)
        same = group[1:] == group[:-1]
        for k in [*range(period, width - 8, 8), width - 8]:
            at = np.flatnonzero(same)
            same[at] = words[pos[at] + k] == words[pos[at + 1] + k]
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.repeat(np.minimum.reduceat(pos, head), np.diff(np.append(head, len(pos))))
        out[pos[pos != least]] = True
    return out[starts]


def _piece_rows(docs: DataFrame, asked: DataFrame, buckets: int, width: int) -> DataFrame:
    """doc_id, text_key, start, upto: covered bytes, and beside them bucket, data: pieces (bytes of runs), each once for a batch.

    Of equal pieces of a block in a batch only the earliest goes on, and the others are covered.
    """
    per = asked.groupBy("doc_id", "text_key").agg(F.collect_list("runs").alias("runs")).withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    with_text = docs.join(per, (docs.text_key == F.col("f_key")) & docs.doc_id.eqNullSafe(F.col("f_id"))).select("doc_id", "text_key", "text", "runs")
    names = ["doc_id", "text_key", "start", "upto", "bucket", "data"]

    def cut(batches):
        for b in batches:
            ids, keys = b.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False), b.column("text_key").to_numpy(zero_copy_only=False)
            texts_of, runs_of = b.column("text"), b.column("runs")
            seen, pieces, rows = set(), [], []
            c_id, c_key, c_start, c_upto = [], [], [], []
            last = None
            for i in np.lexsort((keys, ids)).tolist():
                who = int(ids[i]), int(keys[i])
                if who == last:
                    continue
                last = who
                data = texts_of[i].as_buffer().to_pybytes()
                r = np.frombuffer(b"".join(runs_of[i].as_py()), dtype=_RUN)
                r = np.sort(r, order="start")
                r = r[np.concatenate(([True], r["start"][1:] != r["start"][:-1]))]  # repeated rows tell the same
                covered = []
                for start, more, block in r.tolist():
                    piece = data[start : start + more + width]
                    if (key := (block, piece)) in seen:
                        covered.append((start, start + more + width))
                        continue
                    seen.add(key)
                    pieces.append(piece)
                    rows.append((block, *who, start, more + width))
                if covered:
                    low, high = np.array(covered, dtype=np.int64).T
                    spans_of = merged(low, high)
                    c_id += [who[0]] * len(spans_of)
                    c_key += [who[1]] * len(spans_of)
                    c_start += [x for x, _ in spans_of]
                    c_upto += [y for _, y in spans_of]
            k = len(c_id)
            c_id = np.array(c_id, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c_id, mask=c_id == _NO_ID), pa.array(c_key, type=pa.int64()), pa.array(c_start, type=pa.int64()), pa.array(c_upto, type=pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=names)
            if not rows:
                continue
            head = np.array(rows, dtype=_PIECE)
            bucket = (mixed(head["block"]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            found, start = np.unique(bucket[by], return_index=True)
            data = [np.int64(j - i).tobytes() + head[by[i:j]].tobytes() + b"".join(pieces[x] for x in by[i:j].tolist()) for i, j in zip(start, [*start[1:], len(by)], strict=True)]
            null = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array(found), pa.array(data, type=pa.binary())], names=names)

    return with_text.mapInArrow(tidy(cut), "doc_id long, text_key long, start long, upto long, bucket long, data binary")


def _compared(pieces: DataFrame, buckets: int, width: int, text_bytes: int) -> DataFrame:
    """doc_id, text_key, start, upto: bytes covered, of packed pieces by bucket."""

    def sort(batches):
        at, held = None, []

        def spans_of(row, head, low, high):
            ids = head["id"][row]
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _NO_ID), pa.array(head["key"][row]), pa.array(low), pa.array(high)], names=["doc_id", "text_key", "start", "upto"])

        def close():
            heads, blobs = [], []
            for raw in held:
                k = int(np.frombuffer(raw, np.int64, 1)[0])
                heads.append(np.frombuffer(raw, _PIECE, k, 8))
                blobs.append(np.frombuffer(raw, np.uint8, offset=8 + k * _PIECE.itemsize))
            head, blob = np.concatenate(heads), np.concatenate(blobs)
            begin = np.cumsum(head["size"], dtype=np.int64) - head["size"]
            by = np.lexsort((head["start"], head["key"], head["id"]))
            head, begin = head[by], begin[by]
            own = np.concatenate(([True], (head["id"][1:] != head["id"][:-1]) | (head["key"][1:] != head["key"][:-1]) | (head["start"][1:] != head["start"][:-1])))
            head, begin = head[own], begin[own]
            whole = blob.tobytes()
            seen, fresh = set(), np.ones(len(head), dtype=bool)
            for i, (block, start, size) in enumerate(zip(head["block"].tolist(), begin.tolist(), head["size"].tolist(), strict=True)):
                if (key := (block, whole[start : start + size])) in seen:
                    fresh[i] = False
                else:
                    seen.add(key)
            del seen, whole
            old = np.flatnonzero(~fresh)
            if len(old):
                low = head["start"][old].astype(np.int64)
                yield spans_of(old, head, low, low + head["size"][old])
            some = np.flatnonzero(fresh)
            some = some[_repeated(head["block"][some])]
            by_block = some[np.argsort(head["block"][some], kind="stable")]
            block = head["block"][by_block]
            ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)) if len(block) else []
            total = np.cumsum(head["size"][by_block], dtype=np.int64)
            i = 0
            for k, j in enumerate(ends):
                if k + 1 < len(ends) and total[ends[k + 1] - 1] - (total[i - 1] if i else 0) <= text_bytes:
                    continue
                row = np.sort(by_block[i:j])  # the order of documents and starts
                i = j
                size = head["size"][row].astype(np.int64)
                offset = np.cumsum(size) - size
                inside = np.arange(size.sum())
                text = blob[np.repeat(begin[row] - offset, size) + inside]
                many = size - width + 1
                first = np.cumsum(many) - many
                starts = np.repeat(offset - first, many) + np.arange(many.sum())
                cover = repeats(text, starts, width)
                piece = np.repeat(np.arange(len(row)), many)
                hit = np.flatnonzero(cover)
                if len(hit):
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (piece[hit[1:]] != piece[hit[:-1]]))))
                    low, high = hit[new], hit[np.append(new[1:], len(hit)) - 1]
                    own = row[piece[low]]
                    base = head["start"][own].astype(np.int64) - offset[piece[low]]
                    yield spans_of(own, head, base + starts[low], base + starts[high] + width)

        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if bucket != at and held:
                    yield from close()
                    held = []
                at = bucket
                held.append(data.as_py())
        if held:
            yield from close()

    dealt = pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(sort), "doc_id long, text_key long, start long, upto long")


def merged(start: np.ndarray, upto: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes in any of the spans."""
    if not len(start):
        return []
    by = np.argsort(start, kind="stable")
    start, upto = start[by], np.maximum.accumulate(upto[by])
    new = np.concatenate(([True], start[1:] > upto[:-1]))
    begins = np.flatnonzero(new)
    return list(zip(start[begins].tolist(), upto[np.append(begins[1:], len(start)) - 1].tolist(), strict=True))


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _copies(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, upto: the rows whose whole text a row with a smaller id has too."""
    keys = stored(docs.where(F.octet_length("text") >= width).select("doc_id", "text_key", F.octet_length("text").cast("long").alias("upto"), F.unhex(F.sha2("text", 256)).alias("sha")), "keys")
    firsts = stored(keys.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "least"), "firsts")
    out = stored(keys.join(_sent(firsts), "sha").where("doc_id > least or doc_id is null and least is not null").select("doc_id", "text_key", "upto").distinct(), "copies")
    forget(keys, firsts)
    return out


def spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text, text_key and more) with spans: the bytes, start to upto, covered by a width-byte string that also starts earlier; null: none."""
    parts = shuffle_parts(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = docs.select("doc_id", "text", "text_key")
    copies = _copies(own, width)
    gone = copies.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"))
    own = own.join(_sent(gone), (own.text_key == F.col("g_key")) & own.doc_id.eqNullSafe(F.col("g_id")), "left_anti")
    asked = stored(_asked(own, max(parts, int(size * 2 / (width - gram + 2)) // BUCKET_ANCHORS), width, gram), "asked")
    n = asked.agg(F.sum(F.octet_length("runs"))).first()[0] or 0
    buckets = max(parts, n // _RUN.itemsize * (width + (width - gram) // 2) // BUCKET_BYTES)
    pieces = stored(_piece_rows(own, asked, buckets, width), "pieces")
    forget(asked)
    compared = stored(_compared(pieces.where("bucket is not null").select("bucket", "data"), buckets, width, TEXT_BYTES), "compared")
    covers = copies.select("doc_id", "text_key", F.lit(0).cast("long").alias("start"), "upto").union(compared)
    covers = stored(covers.union(pieces.where("bucket is null").select("doc_id", "text_key", "start", "upto")), "covers")
    forget(copies, pieces, compared)
    per = covers.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "upto")).alias("spans")).withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
    return docs.join(per, (docs.text_key == F.col("c_key")) & docs.doc_id.eqNullSafe(F.col("c_id")), "left").drop("c_id", "c_key")


def _each(batch):
    """Bytes and maximal removed runs of each row of spans()."""
    for t, s in zip(batch.column("text"), batch.column("spans"), strict=True):
        rows = s.values
        runs_of = merged(rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False)) if rows is not None else []
        yield t.as_buffer().to_pybytes(), runs_of


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    if not removed:
        return data
    at, out = 0, []
    for i, j in removed:
        out.append(data[at:i])
        at = j
    return b"".join([*out, data[at:]])


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct(*keep).alias("rest")] if keep else []))
    return found.withColumn("text_key", F.xxhash64("text"))


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (the text without the removed bytes; bytes of a character cut in two go too), n_removed, and rest, a struct of the columns `keep`.

    Earlier means a smaller doc_id (null ids last; among equal ids, by text hash) or an earlier start in the same text.
    Rows repeated in id and text count as one document and keep the same bytes. Texts under `width` bytes, null or empty ones keep all.
    """

    def run(batches):
        for b in batches:
            found = [(_kept(d, r).decode(errors="ignore"), sum(j - i for i, j in r)) for d, r in _each(b)]
            rest = [b.column("rest")] if keep else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], type=pa.string()), pa.array([n for _, n in found], type=pa.int64()), *rest], names=["doc_id", "kept", "n_removed", *(["rest"] if keep else [])])

    own = _keyed(docs, id_col, text_col, keep)
    rest = f", rest {own.schema['rest'].dataType.simpleString()}" if keep else ""
    return spans(own, width).mapInArrow(tidy(run), f"doc_id long, kept string, n_removed long{rest}")


def digests(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; cases as in deduplicated(), but the bytes that stay are taken as they are."""

    def run(batches):
        for b in batches:
            rows = [(len(d), sum(j - i for i, j in r), len(r), hashlib.sha256(_kept(d, r)).hexdigest()) for d, r in _each(b)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, type=pa.int64()) for c in cols[:3]), pa.array(cols[3], type=pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans(_keyed(docs, id_col, text_col), width).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
