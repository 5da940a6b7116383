"""Best-fit packing by best-two-fit.

Texts become pieces of at most `width` tokens. Shards of pieces are packed on their own: a bin is filled
greedily with the longest pieces that fit, then its smallest piece gives way to two unpacked ones that fill
the widened gap more tightly.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder, vocabulary_path
from tessera.llm.common import stored, table, texts

WIDTH = 4096
END_ID = 1
#: Pieces of a shard; a shard ends with one part-filled sequence at most, so the loss is a few sequences in thousands.
SHARD_PIECES = 20_000


def pieces(docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids with end_id behind, cut every `width`; an empty or null text is one piece of one id."""
    path = path or vocabulary_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own, step = encoder(path), 4 * width
        for b in batches:
            rows, at, n, crc = [], [], [], []
            for k, ids in enumerate(own.packed(b.column("text").to_pylist())):
                ids += end
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    rows.append(k)
                    at.append(i // 4)
                    n.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = np.array(at, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, type=pa.int64())), pa.array(at // width, type=pa.int32()), pa.array(at), pa.array(n, type=pa.int64()), pa.array(crc, type=pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length (1 to width)."""
    n = len(lengths)
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    waiting = defaultdict(list)  # by length, the rows that are not packed yet
    for i in order[::-1].tolist():
        waiting[int(lengths[i])].append(i)
    left = np.zeros(width + 1, dtype=np.int64)
    for size, rows in waiting.items():
        left[size] = len(rows)
    sizes = np.flatnonzero(left)  # those that are left, ascending

    def take(size: int) -> int:
        nonlocal sizes
        left[size] -= 1
        if not left[size]:
            sizes = np.delete(sizes, np.searchsorted(sizes, size))
        return waiting[size].pop()

    def give_back(size: int, row: int) -> None:
        nonlocal sizes
        if not left[size]:
            sizes = np.insert(sizes, np.searchsorted(sizes, size), size)
        left[size] += 1
        waiting[size].append(row)

    k = 0
    while len(sizes):
        held: list[tuple[int, int]] = []
        gap = width
        while gap and len(sizes) and (at := int(np.searchsorted(sizes, gap, side="right"))):
            size = int(sizes[at - 1])
            held.append((size, take(size)))
            gap -= size
        if gap and len(held) > 1 and len(sizes):
            small, row = held[-1]  # filled longest first, so the last is the smallest
            room = gap + small
            first = sizes[: np.searchsorted(sizes, room, side="left")]
            if len(first):
                at = np.searchsorted(sizes, room - first, side="right") - 1
                second = sizes[np.maximum(at, 0)]
                fits = (at >= 0) & ((first != second) | (left[first] > 1))
                total = np.where(fits, first + second, 0)
                # the same length twice where only one is left: the next smaller one beside it
                alone = (at >= 1) & (first == second) & (left[first] == 1)
                total = np.where(alone, first + sizes[np.maximum(at - 1, 0)], total)
                second = np.where(alone, sizes[np.maximum(at - 1, 0)], second)
                best = int(np.argmax(total))
                if total[best] > small:
                    a, b = int(first[best]), int(second[best])
                    held[-1] = a, take(a)
                    held.append((b, take(b)))
                    give_back(small, row)
        begin = 0
        for size, row in held:
            where[row], offset[row] = k, begin
            begin += size
        k += 1
    return where, offset


def pack(cut: DataFrame, width: int = WIDTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces() with sequence_id and offset. `cut` is read twice, so it should be a stored table.

    Shards are dealt by row, not by key, so that no key fills one; each is packed by one task in bounded memory.
    """
    shards = max(1, -(-cut.count() // shard_pieces))

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        where, offset = best_two_fit(pdf["length"].to_numpy(), width)
        out = pdf.drop(columns="shard")
        out["sequence_id"], out["offset"] = where + (shard << 32), offset
        return out

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(table(spark, sf_dir, "documents")), "pieces"))
