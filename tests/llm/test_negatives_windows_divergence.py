from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, negatives, registry, windows


@pytest.mark.parametrize("name", ["op11_negatives", "op12_windows", "op13_divergence"])
def test_same_rows_as_sql(spark, sf, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf), oracle.connect(sf), registry.ORACLE_SQL[name]) == ""


def hard_negatives(rows):
    """By brute force, over rows (vec_id, embedding, label)."""
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in used:
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, w, other in used if j != i]
        for minus, j, _ in sorted(x for x in scores if x[2] == label)[:5]:
            inside = sorted(x for x in scores if x[2] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus)
            out += [(i, j, n + 1, x[1], -minus, -x[0]) for n, x in enumerate(inside[:10])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, v string, top string, shard int"


def mine(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "v", "top", 1) for r in rows], VECTORS)
    return sorted(map(tuple, negatives.mined(df, **sizes).collect()))


@pytest.mark.parametrize("lists,shard_rows", [(64, 20_000), (8, 100), (3, 37)])
def test_hard_negatives_by_brute_force(spark, lists, shard_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).round(2).tolist(), int(rng.integers(10))) for i in range(700)]
    rows += [(i, centres[0].round(2).tolist(), i % 3) for i in range(700, 1000)]  # a third are one vector: ties by id
    got = mine(spark, rows, lists=lists, shard_rows=shard_rows)
    assert got == hard_negatives(rows) and len(got) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (200, [], 2), (300, [0.0, 0.0], 2), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [1.0, inf], 1), (5, [1.0, 0.5], None), (None, [1.0, 0.5], 1), (6, [0.5, 0.25], 2), (8, [0.9], 2), (9, [0.5, -0.2], 2), (9, [0.5, -0.2], 2), (10, [-1.0, 0.0], 2), (12, [1.0, 0.5], 2), (13, [1e6, 1.0], 3)]
    assert mine(spark, rows) == hard_negatives(rows) == mine(spark, rows, shard_rows=3)
    assert mine(spark, []) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 4)], int(rng.integers(3))) for i in range(300)]
    assert mine(spark, rows, lists=4, shard_rows=90) == hard_negatives(rows)
    assert negatives.prepared(spark.createDataFrame([(1, [1e8, 1e8], 1), (2, [1e300], 1)], "vec_id long, embedding array<double>, label int")).count() == 0


def test_lists_are_left_out(spark):
    """A visit returns nothing from lists that its window or its floor rules out, and the same as a scan from the others."""
    c = np.array([[100.0, 0.0], [0.0, 100.0]])
    visit = negatives._visitor(c, "<i8", 2, 2, False)
    import pandas as pd

    pack = lambda x: np.array(x, dtype="<i8").tobytes()
    lists = pd.DataFrame({"list": [0, 1], "radius": [1.0, 1.0], "ids": [pack([3, 4]), pack([5])], "labels": [pack([0, 0]), pack([0])], "vectors": [pack([[100, 1], [100, 0]]), pack([[0, 100]])]})
    ask = lambda **x: pd.DataFrame([{"anchor_id": 1, "positive_id": 2, "label": 1, "v": [10, 1], "lo": negatives.NONE, "hi": 2**62, "floor": negatives.NONE, "floor_id": 2**63 - 1} | x])
    assert visit(lists, ask())["ids"][0].tolist() == [3, 4]
    assert visit(lists, ask(hi=500))["ids"][0].tolist() == [5]
    assert visit(lists, ask(floor=1000, floor_id=4))["ids"][0].tolist() == [3]
    assert len(visit(lists, ask(floor=2000))) == 0


def removed(docs):
    """By brute force: (id, words, removed, sha of the kept) of each (id, text)."""
    first = {}
    split = [(2**63 - 1 if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for key, _, w in split:
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, key), key)
    out = []
    for key, i, w in split:
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < key for j in range(k, k + 50)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def scan(spark, docs, **parts):
    df = spark.createDataFrame([(i, t, "n", 7, "d") for i, t in docs], "doc_id long, text string, names string, doc_key int, data string")
    rows = windows.deduplicated(df).select("doc_id", "n_words", windows.removed_words("spans"), F.sha2(F.col("kept").cast("binary"), 256))
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("held,bucket,span", [(1_000_000, 1_000_000, 1 << 18), (300, 1_000_000, 64), (70, 2_000, 1 << 18)])
def test_repeated_windows(spark, monkeypatch, held, bucket, span):
    monkeypatch.setattr(windows, "HELD_WINDOWS", held)
    monkeypatch.setattr(windows, "BUCKET_WINDOWS", bucket)
    rng = random.Random(held)
    word = lambda n: [f"w{rng.randrange(30)}" for _ in range(n)]
    shared = [" ".join(word(n)) for n in (49, 50, 51, 130)]
    docs = [(i, " ".join(x for _ in range(3) for x in (rng.choice(shared), " ".join(word(rng.randrange(60)))))) for i in range(60)]
    docs += [(100 + i, docs[0][1]) for i in range(40)]  # copies
    docs += [(7, docs[3][1]), (None, docs[3][1]), (None, docs[3][1]), (200, None), (201, ""), (202, " \t\n"), (203, "a " * 400), (204, "a\x0ba\x0c" * 100), (-5, "a " * 60), (205, "é é " * 60), (206, "x" * 5000)]
    assert scan(spark, docs) == removed(docs)


def test_no_documents_and_long_ones(spark, monkeypatch):
    assert scan(spark, []) == []
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(600_000))  # more than one piece and one span
    words = text.split()
    docs = [(1, text), (2, " ".join(words[300_000:300_070])), (3, " ".join(words[10:200]) + " x " + text)]
    assert scan(spark, docs) == removed(docs)


def test_rolled_hashes_are_those_of_each_window():
    words = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    for base in (windows.NAME, windows.PLACE):
        want = [sum(int(x) * pow(base, 49 - j, 2**64) for j, x in enumerate(words[i : i + 50])) % 2**64 for i in range(151)]
        assert windows.rolled(words, base).tolist() == want


def diverging(rows, least=30, top=50):
    """By brute force, over rows (text, lang, source)."""
    n, within, langs = Counter(), Counter(), defaultdict(set)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        langs[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n.update((lang, source, t) for t in terms)
        within.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for (a, t), d in within.items() if a == lang and d >= least]
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        every = sum(total.values())
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in sources) + 5) // (every + 5 * len(kept)) for t in kept}
        for s in sources:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            up = [(q[t] - p[s][t], t.encode()) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            out += [(lang, s, part, x.decode(), -v, i + 1) for part, rows_ in (("pair", sorted(far)), ("term", sorted(up)[:top])) for i, (v, x) in enumerate(rows_)]
    return sorted(out)


def audited(spark, rows, **how):
    df = spark.createDataFrame([(*r, "t", "x", 1) for r in rows], "text string, lang string, source string, term string, sources string, salt int")
    return sorted(map(tuple, divergence.audit(df, **how).collect()))


def test_divergence_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 40)
    rng = random.Random(2)
    word = lambda: rng.choice(["Alpha", "beta2gamma", "été", "ÄB", "x y", "don't", f"t{rng.choice('abcdefghij')}"])
    rows = [(" ".join(word() for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", "", None])) for _ in range(300)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("once", "fr", "s3"), ("é" * 50_000 + " zz", "en", "long"), ("12 34", None, "none")] + [("copy of copy", "en", "a")] * 40
    got = audited(spark, rows, top=3)
    assert got == diverging(rows, top=3) and ("fr", "s1", "pair", "s2", 0, 1) in got
    assert audited(spark, rows, least_documents=10**6) == diverging(rows, least=10**6)
    assert audited(spark, []) == []


def test_shares_are_exact(spark):
    rows = [(7, 9 * 10**15), (9 * 10**15, 9 * 10**15), (5, 5), (1, 3), (123456789012345, 9007199254740993), (0, 10)]
    df = spark.createDataFrame(rows, "c long, n long").select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.c // r.n for r in df.collect())
