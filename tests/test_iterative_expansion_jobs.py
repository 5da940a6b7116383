"""Ordered sub-queries, trees of communities, the vector index, expansion, and jobs in a stream, by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, community_tree, drift, enhancement, graph, subqueries, vectors
from tessera.operators.vector_index import VectorIndex
from tessera.streaming import events, jobs


def visited_by_recursion(needs):
    order, seen = [], set()

    def visit(i):
        if i in seen:
            return
        seen.add(i)
        for d in needs[i]:
            if 0 <= d < len(needs):
                visit(d)
        order.append(i)

    for i in range(len(needs)):
        visit(i)
    return order


def test_visit_order_of_random_plans(spark):
    rng = random.Random(4)
    plans = [[[rng.randrange(-1, n + 1) for _ in range(rng.randrange(4))] for _ in range(n)] for n in range(15) for _ in range(10)]
    plans += [[rng.sample(range(i), min(i, rng.randrange(3))) for i in range(40)] for _ in range(5)] + [[[i + 1] for i in range(3000)]]
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(plans)] + [(-1, None, 1), (-2, [None, [0, None]], 1)], "plan long, needs array<array<int>>, node int")
    got = {}
    for r in subqueries.visit_order(df).orderBy("plan", "position").collect():
        got.setdefault(r.plan, []).append(r.node)
    assert -1 not in got and got[-2] == [0, 1]
    assert all(got.get(i, []) == (visited_by_recursion(p) if len(p) < 100 else list(range(len(p)))[::-1]) for i, p in enumerate(plans))
    for p in plans[150:155]:  # without cycles, whatever is needed comes before
        at = {n: k for k, n in enumerate(got[plans.index(p)])}
        assert all(at[d] < at[n] for n, ds in enumerate(p) for d in ds)


def test_levels_report_cycles(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcdef"] + [(2, "a"), (2, "b"), (3, "x")], "plan long, node string")
    needs = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "e"), (1, "e", "d"), (1, "f", "e"), (2, "a", "a"), (2, "b", "gone"), (2, "lost", "b")], "plan long, node string, needed string")
    got = {(r.plan, r.node): r.level for r in subqueries.levels(nodes, needs).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (1, "f"): None, (2, "a"): None, (2, "b"): 0, (3, "x"): 0}
    assert subqueries.levels(nodes.limit(0), needs).count() == 0


def test_questions_carry_answers(spark):
    subs = spark.createDataFrame([(1, 0, "who leads ACME"), (1, 1, "where was born"), (1, 2, "which"), (1, 3, "loop"), (2, 0, "")], "plan long, node long, text string")
    needs = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 2, 1), (1, 3, 3)], "plan long, node long, needed long")
    got = {(r.plan, r.node): (r.question, r.answer) for r in subqueries.answered(subs, needs).collect()}
    assert got == {(1, 0): ("who leads ACME", "leads"), (1, 1): ("where was born [leads]", "leads"), (1, 2): ("which [leads, leads]", "leads"), (1, 3): (None, None), (2, 0): ("", "")}


def by_depth_first(nodes, relevance, threshold, least, most):
    """nodes: id: parent. The choice for one query, as a walk from the roots."""
    children = {i: sorted(k for k, p in nodes.items() if p == i) for i in nodes}
    below = lambda i: sum(1 + below(c) for c in children[i])
    scored, pruned, chosen = [], 0, []

    def walk(i):
        nonlocal pruned
        scored.append(i)
        if relevance.get(i, 0.0) < threshold:
            pruned += 1 + below(i)
        elif children[i]:
            for c in children[i]:
                walk(c)
        else:
            chosen.append((i, False))

    for i in sorted(i for i, p in nodes.items() if p is None):
        walk(i)
    order = lambda i: (-relevance.get(i, 0.0), i)
    spare = sorted((i for i in nodes if not children[i] and (i, False) not in chosen), key=order)
    chosen += [(i, True) for i in spare[: max(0, least - len(chosen))]]
    return sorted(chosen, key=lambda x: order(x[0]))[:most], len(scored), pruned


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_from_the_roots_down(spark, seed):
    rng = random.Random(seed)
    nodes = {f"2:{i}": None for i in range(4)} | {f"1:{i}": rng.choice([None, *(f"2:{k}" for k in range(4))]) for i in range(8)} | {f"0:{i:02}": rng.choice([None, *(f"1:{k}" for k in range(8))]) for i in range(25)}
    relevance = {q: {i: round(rng.random(), 3) for i in nodes if rng.random() < 0.8} for q in range(12)} | {12: {}, 13: dict.fromkeys(nodes, 1.0)}
    df = spark.createDataFrame(list(nodes.items()), "id string, parent string")
    rated = spark.createDataFrame([(q, i, r) for q, x in relevance.items() for i, r in x.items()], "query_id long, id string, relevance double")
    chosen, stats = community_tree.select(df, rated, spark.createDataFrame([(q,) for q in relevance], "query_id long"), 3, least=4, most=6)
    got, told = {}, {r.query_id: r for r in stats.collect()}
    for r in chosen.collect():
        got.setdefault(r.query_id, []).append((r.id, r.padded))
    for q, x in relevance.items():
        want, scored, pruned = by_depth_first(nodes, x, 0.3, 4, 6)
        assert sorted(got[q]) == sorted(want)
        assert (told[q].total, told[q].scored, told[q].pruned, told[q].selected) == (len(nodes), scored, pruned, len(want))


def test_tree_of_levels(spark):
    rows = [(0, n, n // 2) for n in range(12)] + [(1, n, n // 6) for n in range(12)] + [(2, n, 0 if n < 11 else 1) for n in range(12)]
    members = spark.createDataFrame(rows, "level long, node long, community long")
    got = {r.id: (r.parent, r["size"]) for r in community_tree.tree(members, 3, 2).collect()}
    assert got == {f"0:{i}": (f"1:{i // 3}", 2) for i in range(6)} | {"1:0": ("2:0", 6), "1:1": ("2:0", 6), "2:0": (None, 11)}
    degree = spark.createDataFrame([(n, n % 5) for n in range(12)], "node long, degree long")
    top = {(r.level, r.community): r.members for r in community_tree.key_members(members, degree, 2).collect()}
    assert top[1, 0] == "4,3" and top[2, 1] == "11"


def modularity_of(edges, of, resolution):
    m = sum(w for _, _, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    volume = {}
    for n, d in degree.items():
        volume[of[n]] = volume.get(of[n], 0) + d
    return sum(w for a, b, w in edges if of[a] == of[b]) / m - resolution * sum((v / (2 * m)) ** 2 for v in volume.values())


@pytest.mark.parametrize("resolution", [1.0, 2.0])
def test_communities_against_modularity_by_hand(spark, resolution):
    """Four cliques in a ring, with a few more edges by chance: moves raise the modularity counted by hand, to that of the cliques or above."""
    rng = random.Random(8)
    edges = {(6 * c + i, 6 * c + j): 2 for c in range(4) for i in range(6) for j in range(i)} | {(6 * c, (6 * c + 6) % 24): 1 for c in range(4)}
    for _ in range(4):
        edges.setdefault(tuple(rng.sample(range(24), 2)), 1)
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, weight long")
    alone, cliques = ({n: f(n) for n in range(24)} for f in (lambda n: n, lambda n: n // 6))
    scores = [modularity_of(rows, alone, resolution)]
    for rounds in (2, 4, 8):
        of = {r.node: r.community for r in graph.louvain_level(df, resolution, rounds).collect()}
        scores.append(modularity_of(rows, of, resolution))
    assert scores == sorted(scores) and scores[-1] >= modularity_of(rows, cliques, resolution) - 1e-9
    for level in range(2):  # each level holds the one below whole
        found = graph.louvain(df, 2, resolution).where(f"level = {level}").groupBy("community").count().count()
        assert 1 <= found <= 24


def test_index_is_exact_and_its_probes_find_most(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(15, 12))
    v = np.concatenate([centres[rng.integers(15, size=1500)] + 0.3 * rng.normal(size=(1500, 12)), np.tile(centres[0], (500, 1))])
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    queries = df.where("vec_id % 20 in (0, 3)")
    index = VectorIndex(df, lists=20, held=200)
    rows = lambda x: {tuple(r) for r in x.select("source", "target", "score", "rank").collect()}
    want = rows(vectors.top_k_blocks(queries, df, 10, None, measure="cosine"))
    assert rows(index.search(queries, 10, probes=2, exact=True)) == want
    assert not any(s == 3 or t == 3 for s, t, _, _ in want)
    kth = {}
    for s, _, score, _ in want:
        kth[s] = min(score, kth.get(s, 2))
    found = rows(index.search(queries, 10, probes=4))
    assert sum(score >= kth[s] for s, _, score, _ in found) >= 0.9 * len(want)
    assert VectorIndex(df.limit(0)).search(queries, 10, exact=True).count() == 0


def test_drift_stops_by_query(spark):
    """A sure query asks nothing; one without follow-ups ends at the primer; others end at the first sure answer or after three rounds."""
    mentions = [(c, e, 1 - c / 1000) for e in range(12) for c in (e, e + 1, 100 + e)]
    chunks = {c: c % 7 for c, _, _ in mentions}
    df = spark.createDataFrame(mentions, "chunk_id long, entity long, confidence double")
    communities = spark.createDataFrame(list(chunks.items()), "chunk_id long, community long")
    seeds = spark.createDataFrame([(1, 0), (2, 5), (3, 99)], "query_id long, entity long")
    rows = drift.drift(seeds, df, communities, enough=0.62).orderBy("query_id", "round").collect()
    per = {}
    for r in rows:
        per.setdefault(r.query_id, []).append(r)
    assert [r["round"] for r in per[3]] == [0] and per[3][0].confidence == 0.0
    for q in (1, 2):
        steps = per[q]
        assert [r["round"] for r in steps] == list(range(len(steps))) and len(steps) <= 4
        assert all(r.confidence < 0.62 for r in steps[:-1]) and len({r.entity for r in steps}) == len(steps)
        assert [r.confidence for r in steps] == sorted(r.confidence for r in steps)
    sure = drift.drift(seeds, df, communities, enough=0.0).collect()
    assert {r["round"] for r in sure} == {0} and len(sure) == 3


def test_jobs_expire_alike_in_stream_and_batch(spark, tmp_path):
    rng = random.Random(5)
    day = 86_400
    rows, number = [], 0
    for job in range(25):
        at = rng.randrange(3 * day)
        for _ in range(rng.randrange(1, 9)):
            number += 1
            rows.append((job, number, 1_700_000_000 + at, rng.choice(["view", "click", "error"])))
            at += rng.choice([60, 3600, day - 1, day, day + 1, 3 * day])
    rows.append((999, 10**6, 1_700_000_000 + 60 * day, "view"))  # moves the watermark beyond all others
    rows.sort(key=lambda r: r[2])
    swapped = rows[:]
    for i in range(0, len(rows) - 2, 5):  # somewhat late, within the watermark
        if rows[i + 1][2] - rows[i][2] < 500:
            swapped[i], swapped[i + 1] = rows[i + 1], rows[i]
    schema = "user_id long, event_id long, seconds long, event_type string"
    timed = lambda df: df.withColumn("at", F.timestamp_seconds("seconds"))
    source = tmp_path / "in"
    for i in range(0, len(swapped), 20):
        spark.createDataFrame(swapped[i : i + 20], schema).coalesce(1).write.mode("append").parquet(str(source))
    batch = sorted(map(tuple, jobs.expired(timed(spark.createDataFrame(rows, schema))).collect()))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(source)))
        got = sorted(map(tuple, events.run_available(jobs.expired_stream(live), "expired_jobs", str(tmp_path / "check"), "append").collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == batch and len(batch) > 40
    now = {r.job for r in jobs.active(timed(spark.createDataFrame(rows, schema))).collect()}
    assert now == {999}


def test_enhanced_queries(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, v array<double>")
    answers = spark.createDataFrame([(1, [0.0, 2.0]), (1, [0.0, 4.0])], "vec_id long, v array<double>")
    found = lambda *how: {r.vec_id: [round(x, 6) for x in r.v] for r in enhancement.enhanced(queries, answers, *how).collect()}
    assert found("query_only") == {1: [1.0, 0.0], 2: [0.0, 1.0]}
    assert found("hyde_only") == {1: [0.0, 1.0], 2: [0.0, 1.0]}
    assert found("combined", 0.5) == {1: [0.707107, 0.707107], 2: [0.0, 1.0]}
    with pytest.raises(ValueError):
        enhancement.enhanced(queries, answers, "other")


def test_chunks_by_content_are_those_of_their_strategies(spark):
    text = " ".join(f"Word{i} and more of it." for i in range(400))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    for kind, strategy in chunking.BY_CONTENT.items():
        assert sorted(map(tuple, chunking.chunks(df, kind).collect())) == sorted(map(tuple, chunking.chunks(df, strategy).collect()))
        assert chunking.chunks(df, kind).where("doc_id = 1").count() > 1
