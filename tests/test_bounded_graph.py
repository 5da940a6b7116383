"""Rounds over graphs whose rows don't grow with seeds, queries or a task's share of the table."""

from __future__ import annotations

import random

import oracle
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, modes
from tessera.plans import registry
from tessera.sources import shared


def _random_graph(spark, nodes=60, many=90):
    rng = random.Random(3)
    pairs = sorted({tuple(rng.sample(range(nodes), 2)) for _ in range(many)})
    return pairs, spark.createDataFrame(pairs, "src long, dst long")


def _distances(pairs, seed, hops):
    found, now = {seed: 0}, {seed}
    for h in range(1, hops + 1):
        now = {b for a, b in pairs if a in now} - set(found)
        found |= {n: h for n in now}
    return found


def test_waves_hold_a_row_for_each_node_and_flock(spark):
    """100 seeds of one hub: a wave of a node is one row a flock, not one a seed."""
    arcs = spark.createDataFrame([(i, 1000) for i in range(100)], "src long, dst long")
    seeds = spark.createDataFrame([(i,) for i in range(100)], "seed long")
    waves = graph._waves(arcs, graph._numbered(seeds), 2)
    assert [w.count() for w in waves] == [100, 2]
    assert graph.traverse(arcs, seeds, 2).count() == 200


def test_traverse_and_paths_of_a_directed_graph(spark):
    pairs, arcs = _random_graph(spark)
    seeds = spark.createDataFrame([(i,) for i in range(0, 60)] + [(99,)], "seed long")
    want = {(s, n, d) for s in [*range(60), 99] for n, d in _distances(pairs, s, 3).items()}
    assert {tuple(r) for r in graph.traverse(arcs, seeds, 3).collect()} == want
    assert {r.node for r in graph.reachable(arcs, seeds, 3).collect()} == {n for _, n, _ in want}
    lengths = {(s, n): d for s, n, d in want if s < n}
    assert {(r.a, r.b): r.length for r in graph.path_lengths(arcs, seeds, 3).collect()} == lengths
    ways = {(s,): s for s in range(60)}
    least = {}
    for _ in range(3):
        ways = {(*w, b): w[0] for w in ways for a, b in pairs if a == w[-1]}
        for w in ways:
            if lengths.get((w[0], w[-1])) == len(w) - 1:
                least[w[0], w[-1]] = min(w, least.get((w[0], w[-1]), w))
    assert {(r.a, r.b): tuple(r.path) for r in graph.shortest_paths(arcs, seeds, 3).collect()} == least


def test_a_term_meets_its_surest_entities_only(spark):
    names = spark.createDataFrame([(i, "red ring" if i % 2 else "red", 0.5 + (i % 7) / 20) for i in range(200)], "entity long, name string, confidence double")
    terms = spark.createDataFrame([(q, t) for q in range(50) for t in ("red", "ring")], "query_id long, term string")
    found = modes.seeds(terms, names)
    order = sorted([(-(0.5 + (i % 7) / 20), i) for i in range(200)] + [(-(0.5 + (i % 7) / 20), i) for i in range(1, 200, 2)])[:3]
    assert sorted(map(tuple, found.collect())) == sorted((q, i) for q in range(50) for _, i in order)
    assert "WindowGroupLimit [term" in found._jdf.queryExecution().executedPlan().toString()


def test_tables_of_known_size_are_dealt_to_more_tasks(spark, monkeypatch):
    rows = spark.range(100).withColumn("k", F.col("id") % 10)
    assert shared.dealt(rows, 100, "k").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(shared, "TASK_ROWS", 5)
    assert shared.dealt(rows, 100, "k").rdd.getNumPartitions() == 20


def test_a_number_of_tasks_holds_where_the_session_has_more_partitions(spark, monkeypatch):
    """Partitions left to the session are put together by their bytes, whatever the rows."""
    rows = spark.range(100).withColumn("k", F.col("id") % 10)
    monkeypatch.setattr(shared, "TASK_ROWS", 20)
    counted = shared.dealt(rows, 100, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, counted.collect())) == [(k, 10) for k in range(10)]
    assert counted.rdd.getNumPartitions() == 5


@pytest.mark.parametrize("name,rows", [("entity_rels", 0), ("entity_context", 0), ("cooccurrence", 12_000), ("subgraph", 2_000), ("referential_filter", 12_000), ("graph_document", 12_000)])
def test_large_tables_are_dealt_up_to_the_last_step(spark, sf, monkeypatch, name, rows):
    """With nodes too many to be sent, the last step too has a task for so many rows, and the rows are those of SQL."""
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    monkeypatch.setattr(graph, "SENT_NODES", 0, raising=False)
    sent = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.QUERIES[name](spark, sf)
        assert oracle.differences(found, oracle.connect(sf), registry.ORACLE_SQL[name]) == ""
        assert found.rdd.getNumPartitions() >= rows / 200 - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
