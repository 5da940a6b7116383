"""The join of an index with itself looks at a pair once, and finds what a look at all pairs finds."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import expansion, vectors


def _all_pairs(ids, v, k, threshold):
    length = np.linalg.norm(v, axis=1)
    u = v / np.maximum(length, 1e-300)[:, None]
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    out = set()
    for i, a in enumerate(ids):
        best = sorted((-s[i, j], b) for j, b in enumerate(ids) if a != b and length[i] and length[j] and s[i, j] >= threshold)[:k]
        out |= {(a, b, -x, n) for n, (x, b) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.999999])
@pytest.mark.parametrize("strip", [3, 2_000])
def test_both_sides_of_a_meeting(spark, monkeypatch, threshold, strip):
    """Copies, ties at the kth place, scores a hair apart, opposite vectors and some without length."""
    monkeypatch.setattr(vectors, "STRIP", strip)
    monkeypatch.setattr(vectors, "STEP_PAIRS", 4 * strip)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 8))
    v[20:40] = v[:20]
    v[40:60] = v[:20] + 1e-4 * rng.normal(size=(20, 8))
    v[60:70] = -v[:10]
    v[70:73] = 0
    ids = rng.permutation(1000)[:150].tolist()
    df = spark.createDataFrame(list(zip(ids, v.tolist(), strict=True)), "vec_id long, v array<double>")
    for held in (12, 40_000):
        found = vectors.similar_pairs(df, 4, threshold, held=held).collect()
        assert {(r.source, r.target, r.score, r["rank"]) for r in found} == _all_pairs(ids, v, 4, threshold)


def test_a_pair_is_multiplied_once(spark, monkeypatch):
    """Each block comes to a meeting with each other one on one side only: n blocks and a twin, not n on both sides."""
    df = spark.range(64).selectExpr("id AS vec_id", "array(1.0D, cast(id AS double)) AS v")
    seen = spark.sparkContext.accumulator(0)
    whole = vectors._both_best

    def counted(k, threshold):
        best = whole(k, threshold)

        def run(a, b):
            seen.add(len(a) * len(b))
            return best(a, b)

        return run

    monkeypatch.setattr(vectors, "_both_best", counted)
    assert vectors.similar_pairs(df, 3, 0.1, held=16).count() == 64 * 3
    assert seen.value < 0.7 * 64 * 64


def test_edges_of_an_expansion_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b", "0.9D AS strength").mapInArrow(count, "a long, b long, strength double")
    mentions = spark.range(82).selectExpr("id AS chunk_id", "id div 2 AS entity", "0.8D AS confidence")
    anchors = spark.createDataFrame([(1, 10), (2, 30)], "query_id long, chunk_id long")
    found = {(r.query_id, r.chunk_id, r.hop, r.via) for r in expansion.expanded(anchors, mentions, edges).collect()}
    assert found == {(q, c, h, via) for q, e in ((1, 5), (2, 15)) for c, h, via in ((2 * e + 1, 1, f"{e}"), *((c, 2, f"{e}>{o}") for o in (e - 1, e + 1) for c in (2 * o, 2 * o + 1)))}
    assert seen.value == 40
