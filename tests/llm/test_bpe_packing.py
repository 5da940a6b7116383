from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing

POOL = "abcXYZ  \n\t'sdrevlm0123½²ⅫÀéİıſΣσςǅ日本語한국어🎉́̈\x1c\x1f\x85\xa0​ _-.<|>ªºµ‘…ﬁ٣"


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    return bpe.ForcedBoundaryBPE(path), Tokenizer.from_file(path)


def test_same_as_the_library(both):
    own, theirs = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "  ", "<|endoftext|>a<|startoftext|> <|endoftext|>", "a" * 3000, "日" * 1500, "ab" * 1500]
    for some in (texts, texts[:50]):  # the second time from the table
        for t, packed, decimal in zip(some, own.packed(some), own.decimal(some), strict=True):
            ids = theirs.encode(t, add_special_tokens=False).ids
            assert own.encode(t) == ids == np.frombuffer(packed, "<u4").tolist()
            assert decimal == " ".join(map(str, ids))
            assert own.decode(ids) == own.decode_decimal(decimal) == theirs.decode(ids, skip_special_tokens=False)


def test_rows_of_every_length(both):
    """Words of 1 to 80 bytes, with a table of few places, as merged side by side and on their own."""
    _, theirs = both
    few = bpe.ForcedBoundaryBPE(bpe.vocabulary_path(), held=50)
    rng = random.Random(3)
    for alphabet in ("abcdest", "éèaou", "the.!', ", "zqxj0"):
        texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 60))) for _ in range(150)]
        for t, packed in zip(texts, few.packed(texts), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_queries_equal_the_library(spark, sf, both):
    """op6_bpe and op10_packing over whole tables, with ids from the library."""
    _, theirs = both
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: theirs.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, sf).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in got.items()} == {i: (len(x), sha(" ".join(map(str, x))), sha(theirs.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    rows = packing.op10_packing(spark, sf).collect()
    want = {(i, k): (at, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for i, x in ids.items() for k, at in enumerate(range(0, len(x) + 1, 4096)) for p in [[*x, 1][at : at + 4096]]}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 4096
    assert len(places) <= -(-sum(len(x) + 1 for x in ids.values()) // 4096) + 1


def test_cuts_are_pairs_of_no_token(both):
    own, _ = both
    for word in ("straße", "日本語", "hello", "qzxjk"):
        raw = word.encode()
        pieces = own.fragments(raw)
        assert b"".join(pieces) == raw
        at = 0
        for p in pieces[:-1]:
            at += len(p)
            assert not own.joined[raw[at - 1], raw[at]]


def test_frames(spark):
    df = spark.createDataFrame([(1, "The cat", "x"), (1, "The cat", "y"), (None, None, "z"), (3, "", None)], "doc_id long, text string, ids string")
    got = sorted(bpe.digests(df).collect(), key=str)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (3, 0), (None, 0)]
    assert got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.text for r in bpe.decode(bpe.encode(df)).collect()) == ["", "", "the</w> cat</w>", "the</w> cat</w>"]
    assert bpe.digests(df.limit(0)).count() == 0


def test_packing(spark, both):
    own, _ = both
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["cat", "dog", "bird"]) for _ in range(rng.choice([0, 3, 50, 900, 5000])))) for i in range(120)] + [(None, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = packing.pack(packing.pieces(df).cache(), shard_pieces=40).collect()
    want = defaultdict(int)
    for i, t in data:
        ids = own.encode(t or "") + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], dtype="<u4")
            want[i, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


def test_best_two_fit_is_tight():
    lengths = np.random.default_rng(0).integers(1, 700, 4000)
    where, offset = packing.best_two_fit(lengths)
    assert where.max() + 1 <= -(-lengths.sum() // 4096) + 1
    assert np.bincount(where, weights=lengths).max() <= 4096
    # 6 + 2 leaves 2 free; the 2 gives way to 3 and 1, which fill all
    where, _ = packing.best_two_fit(np.array([6, 5, 5, 3, 1]), 10)
    assert where.max() == 1
