"""Many names in texts, searches in blocks, ordered clusters, mended JSON and the stored graph, by brute force and round trips."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import json_repair
from tessera.operators import matching, resolution, vectors
from tessera.plans import storage
from tessera.sources import shared
from tessera.sources.shared import shared_dir
from tessera.sources.store import GraphStore

NAMES = ["New York", "new  york", "York", "the", "a b c d", "Dr. Smith", "x", "été d'Or", "", "...", None, "w " * 9, "Big-Apple Inc", "the the", "İstanbul"]
TEXTS = [("document", 1, "New York, new york; YORK the the the x"), ("document", 1, "the"), ("turn", 1, None), ("turn", 2, ""), ("turn", None, "a b c d e a, b. c d"), ("item", 3, "dr smith and Dr. Smith's été d’or big apple inc"), ("item", 4, "yorkthe x_ newyork " + "w " * 50), ("item", 5, "İSTANBUL i̇stanbul")]


def found_by_hand(texts, names, most=8):
    out = []
    for kind, i, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        for name in {n for n in names if n is not None}:
            x = re.findall(r"\w+", name.lower())
            at = [k for k in range(len(w)) if x and len(x) <= most and w[k : k + len(x)] == x]
            if at:
                out.append((kind, i, name, len(at), at[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("most,bits,held", [(8, 1 << 23, 200_000), (2, 1 << 15, 3), (8, 1 << 15, 1)])
def test_names_in_texts(spark, monkeypatch, most, bits, held):
    monkeypatch.setattr(matching, "HELD_RUNS", held)
    texts = spark.createDataFrame([(*t, "n", 1) for t in TEXTS], "kind string, text_id long, text string, name string, first int")
    names = spark.createDataFrame([(n, "r") for n in NAMES], "name string, run string")
    got = sorted(map(tuple, matching.linked(texts, names, most, bits).collect()), key=str)
    assert got == found_by_hand(TEXTS, NAMES, most) and got
    assert matching.linked(texts.limit(0), names).count() == matching.linked(texts, names.limit(0)).count() == 0


def test_longest_names(spark):
    rows = [("turn", 1, "ab", 1, 0), ("turn", 1, "abc", 1, 0), ("turn", 1, "xy", 1, 0), ("turn", 1, "aa", 1, 0), ("turn", 2, "z", 5, 3)]
    got = matching.longest(spark.createDataFrame(rows, "kind string, text_id long, name string, n long, first long")).orderBy("text_id", "rank").collect()
    assert [(r.text_id, r.name, r["rank"]) for r in got] == [(1, "abc", 1), (1, "aa", 2), (1, "ab", 3), (2, "z", 1)]


@pytest.mark.parametrize("measure", ["cosine", "opposite", "dot", "euclid", "clipped"])
def test_searches_of_any_number_of_queries(spark, measure):
    """Blocks of 40 vectors, so that there are many more queries than one block holds; a hundred copies tie by id."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)).round(3)
    v[100:200] = v[7]
    v[300:303] = 0
    df = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)], "vec_id long, v array<double>, label long")
    score = {
        "dot": lambda a, b: a @ b, "euclid": lambda a, b: -np.sqrt(((a - b) ** 2).sum()), "cosine": lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b)),
        "opposite": lambda a, b: -(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), "clipped": lambda a, b: min(1, max(0, a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))),
    }[measure]
    for same, threshold in ((False, None), (True, 0.2 if measure != "euclid" else -2.0)):
        got = {}
        for r in vectors.nearest(df, df, 5, measure, threshold, same, held=40).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in range(0, 400, 9):
            with np.errstate(invalid="ignore"):
                every = [(-round(float(score(v[q], v[j])), 6), j) for j in range(400) if j != q and (not same or q % 3 == j % 3)]
            want = sorted(x for x in every if not np.isnan(x[0]) and (threshold is None or -x[0] >= threshold))[:5]
            mine = sorted(got.get(q, []))
            assert [x[0] for x in mine] == list(range(1, len(want) + 1))
            assert np.allclose([-x[2] for x in mine], [w[0] for w in want], atol=2e-6)
            assert [x[1] for x in mine] == [w[1] for w in want] or measure != "dot"
    with pytest.raises(ValueError):
        vectors.nearest(df, df, 5, "other")


def in_order(v, similar):
    """Clusters one after the other, as they are defined."""
    with np.errstate(invalid="ignore"):
        n = np.linalg.norm(v, axis=1)
        near = np.round((v / np.maximum(n, 1e-300)[:, None]) @ (v / np.maximum(n, 1e-300)[:, None]).T, 6) >= similar
    leader, left = {}, set(range(len(v)))
    for i in range(len(v)):
        if i in left:
            cluster = [i]
            for j in range(i + 1, len(v)):
                if j in left and near[cluster, j].any():
                    cluster.append(j)
            left -= set(cluster)
            leader |= dict.fromkeys(cluster, i)
    return leader


@pytest.mark.parametrize("held", [4_000, 90])
def test_clusters_in_order(spark, held):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(2_000, 5))
    v[rng.choice(2_000, 1_200, replace=False)] = v[17]  # more than 1,000 copies
    v[5] = 0
    df = spark.createDataFrame([(i, x.tolist(), "n") for i, x in enumerate(v)], "vec_id long, v array<double>, leader string")
    got = {r.vec_id: r.leader for r in resolution.leaders(df, 0.93, held).collect()}
    assert got == in_order(v, 0.93) and len(set(got.values())) > 20


def test_clusters_depend_on_the_order(spark):
    """A chain joins only as far as it rises: 2 reaches 1 through nothing before it."""
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    df = spark.createDataFrame([(1, angle(0)), (2, angle(40)), (3, angle(20)), (4, angle(60)), (5, None)], "vec_id long, v array<double>")
    assert {r.vec_id: r.leader for r in resolution.leaders(df, 0.93).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    assert resolution.leaders(df.limit(0)).count() == 0


def test_merged_entities_of_a_cluster(spark):
    rows = [(1, 1, "KSA", "Loc", 0.8), (1, 2, "Saudi Arabia", "Loc", 0.9), (1, 3, "Saudi-Arabia", "Org", 0.7), (1, 4, "Saudi Arabia", None, 0.6), (9, 9, "solo", None, 0.123456)]
    got = {r.leader: tuple(r)[1:] for r in resolution.resolved(spark.createDataFrame(rows, "leader long, vec_id long, text string, type string, confidence double")).collect()}
    assert got == {1: ("Saudi Arabia", "Loc", 0.75, 4, 2), 9: ("solo", None, 0.123456, 1, 0)}


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(JSON, max_size=3) | st.dictionaries(st.text(), JSON, max_size=4), st.booleans(), st.sampled_from([None, 1]))
def test_any_prefix_is_mended(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    assert json_repair.repaired(text) == text
    for n in range(1, len(text)):
        assert json_repair.valid(json_repair.repaired(text[:n])), text[:n]
    assert json.loads(json_repair.repaired(text + " and so on")) == value


@pytest.mark.parametrize("text,want", [('{"a":1,}', '{"a":1}'), ("[1,2,,3]", "[1,2,3]"), ('{"a":1 "b":2}', '{"a":1,"b":2}'), ('x {"a": [1,2} tail', '{"a":[1,2]}'), ('```json\n{"a":1\n```', '{"a":1}'), ("{a: b}", '{"a":"b"}'), ('{"a":tru', '{"a":true}'), ('{"a":-', '{"a":null}'), ('{"a":1.e', '{"a":1}'), ('{"a":"\\u00', '{"a":""}'), ('{"a":NaN}', '{"a":"NaN"}'), ("no json", None), ("", None), (None, None), ('{"a":"x\ny"}', '{"a":"x\\ny"}')])
def test_mended_json(text, want):
    assert json_repair.repaired(text) == want


def test_mended_column(spark):
    df = spark.createDataFrame([('{"a":[1',), (None,), ("",)], "t string").select(json_repair.repair("t").alias("j"))
    assert [r.j for r in df.collect()] == ['{"a":[1]}', None, None]


def test_equal_texts_are_mended_once(monkeypatch):
    calls, mend = [], json_repair.repaired
    monkeypatch.setattr(json_repair, "repaired", lambda t: calls.append(t) or mend(t))
    assert json_repair.each_once(pd.Series(['{"a":1', None, "x", '{"a":1', "x"], dtype=object)).tolist() == ['{"a":1}', None, None, '{"a":1}', None]
    assert sorted(calls) == ["x", '{"a":1']


def test_cuts_of_one_file_are_mended_in_many_tasks(spark, tmp_path, monkeypatch):
    """Events of one row group, which one task reads, and one without properties."""
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    rows = [(i, f'{{"k": {i}}}') for i in range(30)] + [(99, None)]
    spark.createDataFrame(rows, "event_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = storage.json_repair(spark, str(tmp_path))
    assert sorted(map(tuple, found.where("event_id = 12").collect())) == [(12, n, n > 0, 1 if n == 7 else 12 if n > 7 else None) for n in range(10)]
    assert found.count() == sum(len(p) + 1 for _, p in rows[:-1])
    assert found.rdd.getNumPartitions() == -(-found.count() // 50)


def graph(spark, documents, weight=1.0):
    e = spark.createDataFrame([("A", "t", 0.5, "d", "low", documents), ("B" + documents[0], None, 0.4, None, "high", documents), (None, "t", 0.1, "", "low", documents)], "name string, type string, confidence double, description string, importance string, documents array<string>")
    r = spark.createDataFrame([("A", "B", "likes", weight, documents)], "source string, target string, type string, weight double, documents array<string>")
    c = spark.createDataFrame([(f"c{d}", d, "text") for d in documents], "chunk_id string, document string, text string")
    return {"entities": e, "relationships": r, "chunks": c}


def content(store):
    return {n: sorted(map(str, store.read(n).collect())) for n in ("chunks", "entities", "relationships")}


@pytest.fixture
def store(spark):
    import uuid

    return GraphStore(spark, f"{shared_dir(spark)}/test-store-{uuid.uuid4().hex}", 4)


def test_store_merges_and_deletes(spark, store):
    assert content(store) == {"chunks": [], "entities": [], "relationships": []}
    assert store.merge(graph(spark, ["x"]), ("s", 0)) and store.merge(graph(spark, ["y"], 3.0), ("s", 1))
    rows = {r.name: r for r in store.read("entities").collect()}
    assert rows["A"].documents == ["x", "y"] and set(rows) == {"A", "Bx", "By"}
    assert [tuple(r) for r in store.read("relationships").collect()] == [("A", "B", "likes", 3.0, ["x", "y"])]
    before, version = content(store), store.manifest()["version"]
    assert not store.merge(graph(spark, ["y"], 9.0), ("s", 1)) and not store.merge(graph(spark, ["q"]), ("s", 0))
    assert content(store) == before and store.manifest()["version"] == version
    store.delete_document("x")
    assert {r.name: r.documents for r in store.read("entities").collect()} == {"A": ["y"], "By": ["y"]}
    assert store.read("relationships").count() == 0 and [r.document for r in store.read("chunks").collect()] == ["y"]
    store.delete_document("nobody")
    after = content(store)
    store.vacuum()
    assert content(store) == after and GraphStore(spark, store.root).buckets == 4


def test_a_failed_write_leaves_the_old_state(spark, store):
    store.merge(graph(spark, ["x"]))
    before = content(store)
    broken = graph(spark, ["y"]) | {"relationships": graph(spark, ["y"])["relationships"].withColumn("weight", F.raise_error(F.lit("broken")).cast("double"))}
    with pytest.raises(Exception, match="broken"):
        store.merge(broken, ("s", 5))
    assert content(store) == before and store.manifest()["batches"] == {}
    store.vacuum()
    assert content(store) == before


def test_of_two_writers_from_one_state_one_fails(spark, store):
    old = store.manifest()
    store.merge(graph(spark, ["x"]))
    after = content(store)
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(old)
    assert content(store) == after


def test_store_as_a_sink(spark, store, tmp_path):
    spark.createDataFrame([(i, f"d{i % 2}") for i in range(6)], "i int, document string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, document string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = lambda b: {"chunks": b.select(F.concat(F.lit("c"), F.col("i").cast("string")).alias("chunk_id"), "document", F.lit("t").alias("text"))}
    for _ in range(2):
        stream.writeStream.foreachBatch(store.sink("s", updates)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.chunk_id for r in store.read("chunks").collect()) == [f"c{i}" for i in range(6)]
    assert store.manifest()["batches"]["s"] >= 0
