"""What SQL twins don't cover: greedy and iterative operators, properties, streams."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators import chunking, fusion, graph, modes, vectors
from tessera.sources import html
from tessera.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rrf_worked_example_and_order_invariance(spark):
    data = [(1, "a", 10, 0, 0.9), (1, "a", 11, 0, 0.8), (1, "b", 11, 0, 0.7), (1, "b", 12, 0, 0.6)]
    names = "query_id long, list string, chunk_id long, document_id long, score double"
    one = {r.chunk_id: r.fused for r in fusion.rrf(spark.createDataFrame(data, names)).collect()}
    assert one == {10: round(1 / 61, 9), 11: round(1 / 62 + 1 / 61, 9), 12: round(1 / 62, 9)}
    random.Random(1).shuffle(data)
    assert one == {r.chunk_id: r.fused for r in fusion.rrf(spark.createDataFrame(data, names)).collect()}


def test_mmr_picks_distinct_and_keeps_short_lists(spark):
    rng = np.random.default_rng(0)
    data = [(1, i, [float(x) for x in rng.standard_normal(4)], float(rng.random())) for i in range(12)]
    names = "query_id long, vec_id long, v array<double>, score double"
    picked = [r.vec_id for r in vectors.mmr(spark.createDataFrame(data, names), 5).orderBy("position").collect()]
    assert len(set(picked)) == 5 and picked[0] == max(data, key=lambda r: r[3])[1]
    assert vectors.mmr(spark.createDataFrame(data[:3], names), 5).count() == 3


def test_pagerank_mass(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 3, 1)], "a long, b long, weight long")
    start = spark.createDataFrame([(0, 1.0)], "node long, p double")
    ranks = {r.node: r["rank"] for r in graph.pagerank(graph.adjacency(edges), start, 8).collect()}
    assert math.isclose(sum(ranks.values()), 1.0, abs_tol=1e-9) and ranks[0] > ranks[3]


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(9)] + [(20, 21, 1)], "a long, b long, weight long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {**{i: 0 for i in range(10)}, 20: 20, 21: 20}
    seeds = spark.createDataFrame([(0,), (4,), (21,)], "seed long")
    assert rows(graph.shortest_paths(graph.adjacency(edges).select("src", "dst"), seeds, 6)) == [(0, 4, 4, [0, 1, 2, 3, 4])]


def test_louvain_finds_two_cliques(spark):
    clique = lambda at: [(at + i, at + j, 1) for i in range(5) for j in range(i)]
    edges = spark.createDataFrame(clique(0) + clique(10) + [(0, 10, 1)], "a long, b long, weight long")
    members = graph.louvain_level(edges)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    q = graph.modularity(edges, members).first().modularity
    assert -0.5 <= q <= 1 and q > 0.4


def test_chunkers_cover_their_text():
    body = ("One sentence here. Another one follows! Is that so? " * 60).strip()
    for cut in (lambda t: chunking.cut_at_blanks(t, 200, 0), lambda t: chunking.cut_recursively(t, 200, 0), lambda t: chunking.pack_sentences(t, 200, 0), chunking.merge_similar, chunking.late_boundaries):
        found = cut(body)
        assert "".join("".join(found).split()) == "".join(body.split())
        assert cut("") == [] and cut("word") == ["word"]
    assert all(len(c) <= 200 for c in chunking.cut_recursively("x" * 5000, 200, 0))
    assert all(len(c) <= 200 for c in chunking.cut_at_blanks(body, 200, 50))


def test_windows_end_with_the_items(spark):
    df = spark.range(1).select(*(chunking.windows(F.sequence(F.lit(1), F.lit(n)), 5, 1).alias(f"n{n}") for n in (1, 5, 6, 9, 10)))
    assert [[list(w) for w in x] for x in df.first()] == [[[1]], [[1, 2, 3, 4, 5]], [[1, 2, 3, 4, 5], [5, 6]], [[1, 2, 3, 4, 5], [5, 6, 7, 8, 9]], [[1, 2, 3, 4, 5], [5, 6, 7, 8, 9], [9, 10]]]


def test_similar_pairs_is_exact_and_directed(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((40, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, v array<double>, label long")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(np.clip(n @ n.T, 0, 1), 6)
    want = set()
    for i in range(40):
        for j in sorted((j for j in range(40) if j != i and s[i, j] >= 0.3), key=lambda j: (-s[i, j], j))[:3]:
            want.add((i, j))
    assert {(r.source, r.target) for r in vectors.similar_pairs(df, 3, 0.3, 3).collect()} == want


def test_linking_pairs_keep_every_copy_and_link(spark):
    """A group of more than 1000 equal vectors and its weaker neighbours, in blocks of several sizes, against all links."""
    rng = np.random.default_rng(3)
    hot = np.array([1.0, 0, 0, 0, 0, 0])
    v = np.concatenate([np.tile(hot, (1100, 1)), rng.standard_normal((60, 6)), np.zeros((2, 6)), hot * 0.4 + np.eye(6)[[5, 4]]])
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(n @ n.T, 6) >= 0.35
    np.fill_diagonal(s, False)
    want = {}
    for i in np.flatnonzero(s.any(axis=1)):
        if int(i) not in want:
            reached, front = {int(i)}, [int(i)]
            while front:
                front = [int(j) for k in front for j in np.flatnonzero(s[k]) if int(j) not in reached and not reached.add(int(j))]
            want |= dict.fromkeys(reached, min(reached))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, v array<double>")
    for held in (20_000, 100):
        assert {r.node: r.component for r in graph.connected_components(vectors.linking_pairs(df, 0.35, held).localCheckpoint()).collect()} == want
    assert len(want) >= 1100 and vectors.linking_pairs(df.limit(0), 0.35).count() == 0


def test_html_main_text(spark):
    page = "<html><head><title> A b </title><style>x</style></head><body><nav>menu</nav><!-- c --><article><h1>T</h1><p>Hello <b>there</b></p></article></body></html>"
    r = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(html.title("h"), html.main_text("h")).collect()
    assert [tuple(x) for x in r] == [("A b", "T Hello there"), (None, None), ("", "")]


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "in"
    batch.repartition(3).write.parquet(str(src))
    live = events.run_available(events.windowed(events.stream(spark, str(src), batch.schema), "1 day"), "live_windows", str(tmp_path / "cp"))
    assert rows(live) == rows(events.windowed(events.timed(batch), "1 day"))


def test_similar_pairs_in_every_partitioning(spark):
    """The same rows as brute force, whatever the number of partitions and blocks, without adaptive plans."""

    rng = np.random.default_rng(3)
    v = rng.standard_normal((120, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(np.clip(unit @ unit.T, 0, 1), 6)
    want = {(i, int(j)) for i in range(120) for j in sorted((j for j in range(120) if j != i and s[i, j] >= 0.3), key=lambda j: (-s[i, j], j))[:4]}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {(r.source, r.target) for r in vectors.similar_pairs(df, 4, 0.3, held=25).collect()} == want
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_dispatch_gives_way_to_the_alternative_and_to_vector(spark):
    ids = lambda n: spark.range(n).select(F.col("id").alias("chunk_id"))

    def broken(k):
        raise modes.ModeUnavailable("no index")

    known = {"vector": lambda k: ids(k), "broken": broken, "wrong": lambda k: ids(k).select("no_such_column"), "local": lambda k: ids(2)}
    used = lambda *a: [r.used for r in modes.dispatch(known, *a).select("used").distinct().collect()]
    assert used("local") == ["local"]
    assert used("broken") == ["vector"]
    assert used("drift") == ["vector"]
    assert used("broken", None, ("local", "vector")) == ["local"]
    assert used("bypass") == []
    with pytest.raises(AnalysisException):  # a bug is no reason to answer in another mode
        used("wrong")
    assert modes.dispatch(known, "vector", 500).count() == modes.MOST_K
    assert modes.dispatch(known, "vector").count() == modes.DEFAULT_K


def test_two_levels_keep_the_surest(spark):
    names = spark.createDataFrame([(1, "red bolt", 0.9), (2, "red nut", 0.8), (3, "Red red pin", 0.7), (4, "red cap", 0.1), (5, "blue cap", 0.5)], "entity long, name string, confidence double")
    said = spark.createDataFrame([(c, e, 0.1 * c) for e in range(1, 6) for c in range(1, 6)], "chunk_id long, entity long, confidence double")
    terms = spark.createDataFrame([("q", "red"), ("none", "green")], "query_id string, term string")
    low = {(r.query_id, r.chunk_id): r.score for r in modes.low_level(terms, names, said).collect()}
    assert set(low) == {("q", 3), ("q", 4), ("q", 5)}
    relevance = spark.createDataFrame([("q", c, 0.1 * c) for c in range(1, 10)], "query_id string, community long, relevance double")
    chunks = spark.createDataFrame([(c, 10 * c + i, i) for c in range(1, 10) for i in range(5)], "community long, chunk_id long, weight long")
    high = modes.high_level(relevance, chunks).collect()
    assert {r.chunk_id for r in high} == {10 * c + i for c in range(5, 10) for i in (2, 3, 4)}
