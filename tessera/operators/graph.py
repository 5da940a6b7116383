"""Traversal, ranking and communities over edge tables (a, b, and a weight)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import in_blocks, reached, unpacked
from tessera.sources.shared import cut, dealt

#: Rounds of an iterative plan between two cuts of its lineage.
CUT_EVERY = 5
#: Nodes up to which they are sent to all tasks that look them up.
SENT_NODES = 500_000


def _at(rows: DataFrame, n: int, nodes: DataFrame, column: str) -> DataFrame:
    """Those of about n rows whose column is among the nodes (column node). Few nodes are sent; more meet the rows by shuffle, in tasks of known size."""
    nodes = nodes.select(F.col("node").alias(column))
    if nodes.count() <= SENT_NODES:
        return rows.join(F.broadcast(nodes), column, "left_semi")
    return dealt(rows, n, column).join(nodes, column, "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, weight: every edge both ways."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    rows = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce(weight, F.lit(1)).alias("weight"))
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _numbered(seeds: DataFrame) -> DataFrame:
    """seed, flock, bit: seeds dealt by rising id into flocks of 64, each a bit of its flock. Neighbouring ids tend to reach the same nodes, so a node meets few flocks."""
    each = seeds.select("seed").where("seed is not null").distinct()
    runs = each.repartitionByRange(max(1, each.count() // 100_000), "seed").sortWithinPartitions("seed").withColumn("at", F.monotonically_increasing_id())
    return cut(runs.select("seed", F.expr("shiftright(at, 6)").alias("flock"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")))


def _waves(arcs: DataFrame, numbered: DataFrame, hops: int, ends: DataFrame | None = None) -> list[DataFrame]:
    """For each round node, flock, bits: which seeds of the flock come to the node in it first. Of a round, a row for each node and flock meets, not one for each seed.

    The arcs stay in their blocks: a round moves what it says to them, and of what they say a row for each block, node and flock.
    With `ends` (column node) the last round looks at these nodes only.
    """
    packed, places = in_blocks(arcs.select("src", "dst"), "src", "dst")
    n = places.count()
    none = F.lit(0).cast("long")
    waves = [numbered.select(F.col("seed").alias("node"), "flock", F.col("bit").alias("bits"))]
    seen = waves[0]
    for h in range(1, hops + 1):
        step = reached(packed, places, waves[-1]).withColumn("old", none)
        if ends is not None and h == hops:
            step = step.join(ends.select("node").distinct(), "node", "left_semi")
        # a node without a name equals none, so it is new each time
        both = step.unionByName(seen.where("node is not null").select("node", "flock", none.alias("bits"), F.col("bits").alias("old")))
        met = dealt(both, 2 * n, "node", "flock").groupBy("node", "flock").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        wave = cut(met.select("node", "flock", F.expr("bits & ~old").alias("bits")).where("bits != 0"))
        if wave.isEmpty():
            break
        waves.append(wave)
        seen = seen.unionByName(wave)
    return waves


def _apart(waves: list[DataFrame], numbered: DataFrame) -> DataFrame:
    """seed, node, distance: the waves behind the first, a row for each seed."""
    rows = None
    for h, wave in enumerate(waves[1:], 1):
        wave = wave.withColumn("distance", F.lit(h).cast("long"))
        rows = wave if rows is None else rows.unionByName(wave)
    rows = waves[0].limit(0).withColumn("distance", F.lit(0).cast("long")) if rows is None else rows
    return rows.join(numbered, "flock").where("bits & bit != 0").select("seed", "node", "distance")


def traverse(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, node, distance: all nodes within `hops` of each seed (column seed), by breadth-first rounds; the seed itself at 0."""
    numbered = _numbered(seeds)
    waves = _waves(adj, numbered, hops)
    return seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("distance")).unionByName(_apart(waves, numbered))


def reachable(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node: all nodes within `hops` of any seed."""
    arcs = cut(adj.select("src", "dst"))
    n = arcs.count()
    out = frontier = cut(seeds.select(F.col("seed").alias("node")).distinct())
    for _ in range(hops):
        step = dealt(_at(arcs, n, frontier, "src").select(F.col("dst").alias("node")), n, "node").distinct()
        frontier = cut(step.join(out, "node", "left_anti"))
        out = out.unionByName(frontier)
    return out.distinct()


def _pair_lengths(arcs: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """a, b, length for each pair of seeds a < b within `hops`, with the flocks and the waves, which run from b against the arcs."""
    numbered, ends = _numbered(seeds), seeds.select(F.col("seed").alias("node")).distinct()
    waves = _waves(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), numbered, hops, ends)
    rows = _apart([w.join(ends, "node", "left_semi") for w in waves], numbered)
    return rows.where("node < seed").select(F.col("node").alias("a"), F.col("seed").alias("b"), F.col("distance").alias("length")), numbered, waves


def path_lengths(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """a, b, length for each pair of seeds a < b within `hops`."""
    return _pair_lengths(adj, seeds, hops)[0]


def shortest_paths(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """a, b, length, path for each pair of seeds a < b within `hops`; of several shortest paths the least, node by node.

    Each pair walks from a, step by step to the least neighbour that is nearer to b; what is near to b is known from the rounds that ran from b.
    """
    arcs = cut(adj.select("src", "dst").distinct())
    pairs, numbered, waves = _pair_lengths(arcs, seeds, hops)
    walks = cut(pairs.join(numbered, F.col("seed") == F.col("b")).select("a", "b", "length", "flock", "bit", F.col("a").alias("at"), F.array("a").alias("path")))
    done = walks.limit(0)
    for h in range(1, hops + 1):
        near = None
        for left, wave in enumerate(waves):
            wave = wave.select(F.col("node").alias("dst"), "flock", "bits", F.lit(left).cast("long").alias("left"))
            near = wave if near is None else near.unionByName(wave)
        steps = walks.join(arcs, F.col("at") == F.col("src")).withColumn("left", F.col("length") - h).join(near, ["dst", "flock", "left"]).where("bits & bit != 0")
        least = steps.groupBy("a", "b").agg(F.min("dst").alias("next"))
        walks = cut(walks.join(least, ["a", "b"]).select("a", "b", "length", "flock", "bit", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")))
        done = done.unionByName(walks.where(F.col("length") == h))
        walks = walks.where(F.col("length") > h)
    return done.select("a", "b", "length", "path")


def induced(edges: DataFrame, nodes: DataFrame, rows: int = 0) -> DataFrame:
    """Edges with both ends among the nodes (column node). `rows`: about how many edges there are, by which they are dealt to tasks."""
    return _at(_at(edges, rows, nodes, "a"), rows, nodes, "b")


def pagerank(adj: DataFrame, start: DataFrame, rounds: int, damping: float = 0.85, tolerance: float = 0.0) -> DataFrame:
    """node, rank after at most `rounds` rounds of personalised PageRank: restart by `start` (node, p), equal ranks at first, and what reaches a node without edges is lost.

    With a tolerance it ends, at a cut of the lineage, when the last round changed the ranks by no more than that in sum.
    """
    adj = cut(adj.select("src", "dst", "weight").repartition("src"))
    degree = adj.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = cut(adj.join(degree, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    nodes = degree.select(F.col("src").alias("node"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    restart = cut(nodes.join(start, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p")))
    for i in range(1, rounds + 1):
        flow = ranks.join(moves, ranks.node == moves.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        before = ranks
        ranks = restart.join(flow, "node", "left").select("node", ((1 - damping) * F.col("p") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if i % CUT_EVERY == 0:
            ranks = cut(ranks)
            if tolerance:
                moved = ranks.join(before.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if (moved or 0) <= tolerance:
                    break
    return ranks


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), by least labels and doubling; ends when a round changes nothing."""
    adj = adjacency(edges).select("src", "dst").distinct()
    labels = adj.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("label"))
    before = None
    while True:
        near = adj.join(labels, adj.dst == labels.node).groupBy("src").agg(F.min("label").alias("least"))
        step = labels.join(near, labels.node == near.src).select("node", F.least("label", "least").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = cut(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select("node", F.col("label").alias("component"))
        before = now


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row, the modularity of the partition members (node, community) of an undirected graph."""
    a, b = (members.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}")) for x in "ab")
    rows = edges.join(a, "a").join(b, "b")
    inside = rows.where("c_a = c_b").groupBy(F.col("c_a").alias("community")).agg(F.sum("weight").alias("inside"))
    ends = rows.select(F.explode(F.array("c_a", "c_b")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("degree"))
    total = rows.agg(F.sum("weight").alias("m"))
    per = ends.join(inside, "community", "left").crossJoin(F.broadcast(total))  # one row
    q = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    return per.agg(F.round(F.sum(q), 6).alias("modularity"))


def contracted(edges: DataFrame, members: DataFrame, loops: bool = False) -> DataFrame:
    """The graph of communities: pairs a < b and the weights between them; with `loops`, also each community with itself and the weight inside."""
    a, b = (members.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}")) for x in "ab")
    rows = edges.join(a, "a").join(b, "b")
    rows = rows if loops else rows.where("c_a != c_b")
    return rows.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("weight").alias("weight"))


def _moves(known: pa.Table, row: pa.Table, resolutions: list[float], two_m: float, whole: bool) -> pa.Table:
    """at, node, next: which of a block's nodes whose turn it is go to another community. known: at (the place of a resolution), node, community, degree, volume, turn of the nodes of the block."""
    out = []
    if known.num_rows and row.num_rows:
        nodes, src, dst, weight = unpacked(row, whole)
        mine, own_rows = (dst >= 0) & (src != dst), known.column("at").to_numpy()
        src, dst, weight = src[mine], dst[mine], weight[mine]
        for r in np.unique(own_rows).tolist():
            part = known.filter(pa.array(own_rows == r))
            # nodes whose community is not known (those without arcs of their own) take no part
            has, community, degree, volume, turn = (np.zeros(len(nodes), dtype=t) for t in (bool, np.int64, weight.dtype, weight.dtype, bool))
            at = np.searchsorted(nodes, part.column("node").to_numpy())
            has[at] = True
            for into, c in ((community, "community"), (degree, "degree"), (volume, "volume"), (turn, "turn")):
                into[at] = part.column(c).to_numpy()
            names, code = np.unique(community, return_inverse=True)
            of = np.zeros(len(names), dtype=weight.dtype)
            of[code[has]] = volume[has]
            asked = turn[src] & has[src] & has[dst]
            key = src[asked].astype(np.int64) * len(names) + code[dst[asked]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            links, node, to = np.add.reduceat(weight[asked][order], first), key[first] // len(names), key[first] % len(names)
            gain = lambda links, node, rest: links - resolutions[r] * degree[node] * rest / two_m
            loss = -np.round(gain(links, node, of[to] - np.where(to == code[node], degree[node], 0)), 9)
            # a node without neighbours in its own community may stay there none the less
            alone = np.setdiff1d(node, node[to == code[node]])
            node, to = np.concatenate([node, alone]), np.concatenate([to, code[alone]])
            loss = np.concatenate([loss, -np.round(gain(0, alone, volume[alone] - degree[alone]), 9)])
            by = np.lexsort((to, loss, node))
            node, to = node[by], to[by]
            best = np.concatenate(([True], node[1:] != node[:-1])) & (to != code[node])
            out.append(pa.table({"at": np.full(best.sum(), r), "node": nodes[node[best]], "next": names[to[best]]}))
    schema = pa.schema([("at", pa.int64()), ("node", pa.int64()), ("next", pa.int64())])
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def louvain_levels(edges: DataFrame, resolutions: list[float], rounds: int = 8) -> DataFrame:
    """at, node, community for each resolution (its place in the list) by synchronous local moving: in turn, half of the nodes (by hash) go to the neighbouring community of the greatest gain, ties to the least name.

    Arcs stay in blocks, all arcs of a node in one. A round moves to each block what is known of its nodes, for all resolutions at once, and
    of what the block decides the nodes that move; neither grows with the arcs where neighbours share their neighbours.
    """
    edges = cut(edges)
    adj = adjacency(edges)
    packed, places = in_blocks(adj, "src")
    places = places.select("node", "block")
    whole = dict(adj.dtypes)["weight"] in ("tinyint", "smallint", "int", "bigint")
    degree = cut(dealt(adj, 2 * edges.count(), "src").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree")))
    two_m = degree.agg(F.sum("degree")).first()[0] or 1
    members = degree.where("node is not null").select(F.explode(F.array(*(F.lit(i).cast("long") for i in range(len(resolutions))))).alias("at"), "node", F.col("node").cast("long").alias("community"), "degree")

    def decide(known: pa.Table, row: pa.Table) -> pa.Table:
        return _moves(known, row, resolutions, two_m, whole)

    still = 0
    for i in range(rounds):
        volume = members.groupBy("at", "community").agg(F.sum("degree").alias("volume"))
        known = cut(members.join(volume, ["at", "community"]))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        sent = known.select("at", F.col("node").cast("long").alias("node"), "community", "degree", "volume", turn.alias("turn")).join(places, "node")
        moved = cut(sent.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(decide, "at long, node long, next long"))
        still = 0 if moved.count() else still + 1
        members = known.join(moved, ["at", "node"], "left").select("at", "node", F.coalesce("next", "community").alias("community"), "degree")
        if still == 2:  # neither half moves any more
            break
    return cut(members.select("at", "node", "community"))


def louvain_level(edges: DataFrame, resolution: float = 1.0, rounds: int = 8) -> DataFrame:
    """node, community: louvain_levels() of one resolution."""
    return louvain_levels(edges, [resolution], rounds).select("node", "community")


def louvain(edges: DataFrame, levels: int = 2, resolution: float = 1.0) -> DataFrame:
    """level, node, community: each level moves the communities of the one before, at a resolution 1.5 times lower."""
    out, at = None, None
    graph = edges = cut(edges)
    for level in range(levels):
        found = louvain_level(graph, resolution * 1.5 ** (levels - level - 1))
        at = found if at is None else at.join(found.select(F.col("node").alias("community"), F.col("community").alias("up")), "community", "left").select("node", F.coalesce("up", "community").alias("community"))
        rows = at.select(F.lit(level).cast("long").alias("level"), "node", "community")
        out = rows if out is None else out.unionByName(rows)
        graph = cut(contracted(edges, at, loops=True))  # weights inside count to a community's degree on the next level
        if graph.where("a != b").isEmpty():
            break
    return out


def best_parents(child: DataFrame, parent: DataFrame) -> DataFrame:
    """child, parent, shared: for each community of child (node, community) that of parent with most nodes in common, ties by name."""
    rows = child.withColumnRenamed("community", "child").join(parent.withColumnRenamed("community", "parent"), "node").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("child").orderBy(F.desc("shared"), "parent")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
