"""Sub-queries that depend on each other: their order, what can be asked side by side, and questions fed with answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """plan, node, level for nodes (plan, node) of which some need others (plan, node, needed): 0 where nothing is needed, else one more than the
    greatest level needed; null on cycles and behind them, so these are told.

    A round takes every node of every plan whose needs are all placed, and ends when there is none; so rounds are as many as levels, whatever the
    number and size of plans. Needs of nodes that the plan lacks don't count.
    """
    nodes = cut(nodes.select("plan", "node").distinct())
    known = nodes.withColumnRenamed("node", "needed")
    left = cut(needs.select("plan", "node", "needed").distinct().join(known, ["plan", "needed"], "left_semi").join(nodes, ["plan", "node"], "left_semi"))
    waiting, out, level = nodes, None, 0
    while True:
        free = cut(waiting.join(left.select("plan", "node").distinct(), ["plan", "node"], "left_anti").withColumn("level", F.lit(level).cast("long")))
        out = free if out is None else out.unionByName(free)
        if free.isEmpty():
            return out.unionByName(waiting.withColumn("level", F.lit(None).cast("long")))
        placed = free.select("plan", "node")
        waiting = cut(waiting.join(placed, ["plan", "node"], "left_anti"))
        left = cut(left.join(placed.withColumnRenamed("node", "needed"), ["plan", "needed"], "left_anti"))
        level += 1


def visited(needs: list[list[int]]) -> list[int]:
    """Nodes 0 to n - 1 in the order in which a visit of each in turn leaves them, when it first visits what each needs, in the order it is listed, and
    none twice. On a cycle the node that is met again is not waited for."""
    order, seen = [], set()
    for root in range(len(needs)):
        stack = [(root, iter(needs[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            step = next((d for d in rest if 0 <= d < len(needs) and d not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(needs[step])))
    return order


def visit_order(plans: DataFrame) -> DataFrame:
    """plan, position, node: visited() of each plan (plan, needs: an array of the lists of what its nodes need); null plans have no rows. A plan is a few sub-queries."""

    def run(frames):
        for f in frames:
            out = [(p, i, n) for p, needs in zip(f["plan"], f["needs"], strict=True) if needs is not None for i, n in enumerate(visited([[] if x is None else [int(d) for d in x if not pd.isna(d)] for x in needs]))]
            yield pd.DataFrame(out, columns=["plan", "position", "node"])

    return plans.select("plan", "needs").mapInPandas(run, "plan long, position long, node long")


def longest_word(text: Column) -> Column:
    """The deterministic stand-in for an answer: the longest word, the first by name of those; empty without words."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    best = F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.coalesce(best.w, F.lit(""))


def answered(sub_queries: DataFrame, needs: DataFrame, answer: Callable[[Column], Column] = longest_word) -> DataFrame:
    """plan, node, level, question, answer: each sub-query (plan, node, text) asked when what it needs is answered, with those answers behind it, by
    rising node. Sub-queries on or behind a cycle are not asked: question and answer are null. `answer` is the hook that answers a text."""
    placed = cut(levels(sub_queries, needs).join(sub_queries.select("plan", "node", "text"), ["plan", "node"]))
    out = placed.where("level is null").select("plan", "node", "level", F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"))
    deepest = placed.agg(F.max("level")).first()[0]
    done = None
    for level in range(-1 if deepest is None else deepest + 1):
        now = placed.where(F.col("level") == level)
        if done is None:
            asked = now.withColumn("given", F.lit(""))
        else:
            fed = needs.select("plan", "node", "needed").distinct().join(done.select("plan", F.col("node").alias("needed"), "answer"), ["plan", "needed"])
            given = fed.groupBy("plan", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("needed", "answer"))), lambda x: x.answer), ", ").alias("given"))
            asked = now.join(given, ["plan", "node"], "left")
        question = F.when(F.coalesce("given", F.lit("")) == "", F.col("text")).otherwise(F.concat("text", F.lit(" ["), "given", F.lit("]")))
        rows = cut(asked.select("plan", "node", "level", question.alias("question")).withColumn("answer", answer(F.col("question"))))
        done = rows if done is None else done.unionByName(rows)
    return out if done is None else out.unionByName(done)
