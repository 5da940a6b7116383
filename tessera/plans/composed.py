"""Dispatched and composed modes, set operations, and scores of answers, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed, text
from tessera.operators import fusion, graph, metrics, modes
from tessera.operators import vectors as vec
from tessera.plans.texts import _CLASS, _MODE, _SENTENCES, _inter, _list, _share, _union
from tessera.plans.texts import _terms as _key_terms
from tessera.plans.vectors import _COS, QUERIES_ARE, _queries, _top_sql
from tessera.sources.tables import chunk_documents, edges, entities, mentions, ranked_lists, table, vectors, with_

ASKED = ["vector", "semantic", "drift", "bypass"]
RESOLUTIONS = [2.0, 1.0, 0.5, 0.1]
LOW, HIGH = 0.8, 0.2


def _near(spark, sf, k):
    index = vectors(spark, sf)
    return vec.nearest(_queries(index), index, k).select("query_id", F.col("vec_id").alias("chunk_id"), "score")


def _semantic(spark, sf, k):
    docs = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    near = _near(spark, sf, 3 * k)
    # few documents are candidates: only their words are moved
    both = near.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("w").alias("b")), "chunk_id", "left").join(docs.select(F.col("doc_id").alias("query_id"), F.col("w").alias("a")), "query_id", "left")
    alike = F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6)
    return modes.semantic(both, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), alike), k)


def _modes(spark, sf):
    return {"vector": lambda k: _near(spark, sf, k), "semantic": lambda k: _semantic(spark, sf, k).drop("rank_change")}


def semantic_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty vector neighbours of each query, the ten whose texts share most words with the query's."""
    return _semantic(spark, sf, 10)


def mode_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Each mode asked of all queries; drift isn't dispatched and gives way to vector, bypass to nothing."""
    parts = [modes.dispatch(_modes(spark, sf), name, 60 if name == "drift" else None).withColumn("asked", F.lit(name)) for name in ASKED]
    return reduce(DataFrame.unionByName, parts).groupBy("asked", "used", "query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"), F.min("chunk_id").alias("least"))


def _terms(spark, sf):
    """The queries: every word of the entities' names, numbered by the least entity that has it."""
    words = entities(spark, sf).select("entity", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("term"))
    return words.groupBy("term").agg(F.min("entity").alias("first")).select(F.col("term").alias("query_id"), "term")


def _levels(spark, sf):
    terms, m = _terms(spark, sf), mentions(spark, sf)
    low = modes.low_level(terms, entities(spark, sf), m)
    # a community is the customers of a nation; it bears on a term as often as its chunks mention it, against the community that does most
    nation = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("long").alias("community"))
    chunks = chunk_documents(spark, sf).join(nation, "document_id").select("chunk_id", "community")
    words = entities(spark, sf).select("entity", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("query_id"))
    told = m.join(chunks, "chunk_id").groupBy("community", "entity").agg(F.count(F.lit(1)).alias("n")).join(words, "entity").groupBy("query_id", "community").agg(F.sum("n").alias("n"))
    relevance = told.withColumn("relevance", F.round(F.col("n") / F.max("n").over(Window.partitionBy("query_id")), 6))
    weight = m.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("weight"))
    return low, modes.high_level(relevance.select("query_id", "community", "relevance"), chunks.join(weight, "chunk_id"))


def dual_level(spark: SparkSession, sf: str) -> DataFrame:
    """Entities' chunks and communities' chunks of each term, fused by the weights of a factual question."""
    low, high = _levels(spark, sf)
    return fusion.dual(low, high, LOW, HIGH)


def unified_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Dual-level chunks and each level's own united: the best score of a chunk, where it came from, and the query's confidence, their mean."""
    low, high = _levels(spark, sf)
    both = fusion.dual(low, high, LOW, HIGH).withColumnRenamed("fused", "score")
    lists = low.withColumn("list", F.lit("low")).unionByName(high.withColumn("list", F.lit("high"))).unionByName(both.withColumn("list", F.lit("dual")))
    top = vec.top_k(fusion.unified(lists), 10, tie="chunk_id").drop("rank")
    return top.withColumn("confidence", F.round(F.avg("score").over(Window.partitionBy("query_id")), 6))


def community_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Communities at four resolutions, from subtopics to the broadest: their sizes, and the least member."""
    found = graph.louvain_levels(edges(spark, sf), RESOLUTIONS).groupBy("at", "community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    return found.select("community", "size", "first", F.element_at(F.array(*map(F.lit, RESOLUTIONS)), F.col("at").cast("int") + 1).alias("resolution"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of finished and of open orders: in both, only in the first, and the surplus of the first's rows over the second's."""
    rows = mentions(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("status")), "chunk_id")
    done, open_ = (rows.where(F.col("status") == s).select("entity") for s in "FO")
    parts = {"intersect": done.intersect(open_), "except": done.subtract(open_), "except_all": done.exceptAll(open_)}
    return reduce(DataFrame.unionByName, (p.select(F.lit(name).alias("kind"), "entity") for name, p in parts.items()))


def undirected_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by their two ends in either order and type: the first stays, as it was written."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), "l_orderkey", "l_linenumber")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "source", "target")).alias("r")
    return li.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "type").agg(first, F.count(F.lit(1)).alias("n")).select("r.source", "r.target", "type", "n")


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.select("conv_id", "turn", F.col("text").alias("question")).join(after, ["conv_id", "turn"])


def case_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a test case that the next one answers: three sentences at least, the question's capitalised words and longer terms in it, its first three terms, and a likeness of 0.3; local and hybrid are the recommended modes."""
    rows = _turns(spark, sf)
    low, terms = F.lower("answer"), text.key_terms("question")
    expected = F.array_distinct(F.regexp_extract_all("question", F.lit("([A-Z][a-z]+)"), 1))
    share = lambda xs: F.when(F.size(xs) == 0, 1.0).otherwise(F.size(F.filter(xs, lambda x: F.contains(low, F.lower(x)))) / F.size(xs))
    longer = F.filter(terms, lambda x: F.length(x) > 4)
    alike = text.key_terms("answer"), terms
    likeness = F.bround(0.4 * text.jaccard(*alike) + 0.6 * text.share(text.overlap(*alike), F.size(terms)), 3)
    checks = {"chunk_count": F.size(text.sentences("answer")) >= 3, "entity_match": (share(expected) >= 0.5) | F.exists(expected, lambda x: F.contains(low, F.lower(x))), "chunk_content": F.when(F.size(longer) == 0, True).otherwise(share(longer) > 0.5), "answer_keywords": share(F.slice(terms, 1, 3)) >= 0.5, "similarity": likeness >= 0.3}
    rows = rows.select("conv_id", "turn", *(c.alias(n) for n, c in checks.items()), text.retrieval_mode("question").isin("local", "hybrid").alias("recommended"))
    score = metrics.case_score(F.col("recommended"))
    return rows.select("conv_id", "turn", *checks, "recommended", score.alias("score"), (score >= metrics.PASS).alias("passed"))


def benchmark_score(spark: SparkSession, sf: str) -> DataFrame:
    """0.4 relevance, 0.3 completeness and 0.3 accuracy of each turn as the answer to the one before, whose capitalised words are expected; answers under 10 characters score 0."""
    q, a = F.lower("question"), F.lower("answer")
    words = lambda x: F.array_except(F.filter(F.split(x, r"\s+"), lambda w: w != ""), F.array(*map(F.lit, fixed.QUESTION_STOP_WORDS)))
    rows = _turns(spark, sf).withColumn("q", words(q)).withColumn("a", words(a)).withColumn("expected", F.array_distinct(F.regexp_extract_all("question", F.lit("([A-Z][a-z]+)"), 1)))
    overlap = F.when(F.size("q") > 0, F.least(F.size(F.array_intersect("q", "a")) / F.size("q") * 1.5, F.lit(1.0))).otherwise(0.0)
    length = F.least(F.length("answer") / 500, F.lit(1.0))
    complete = F.when(F.size("expected") > 0, F.size(F.filter("expected", lambda e: F.contains(a, F.lower(e)))) / F.size("expected")).otherwise(length)
    specific = F.size(F.filter(F.array(*map(F.lit, fixed.SPECIFIC_MARKS)), lambda m: F.contains(F.col("answer"), m))) / len(fixed.SPECIFIC_MARKS)
    said = F.length(F.regexp_replace("answer", r"^\s+|\s+$", "")) >= 10
    zero = lambda x: F.when(said, x).otherwise(0.0)
    rows = rows.select("conv_id", "turn", zero((overlap + length) / 2).alias("r"), zero(complete).alias("c"), zero(F.greatest(complete, specific)).alias("s"))
    return rows.select("conv_id", "turn", F.round("r", 6).alias("relevance"), F.round("c", 6).alias("completeness"), F.round("s", 6).alias("accuracy"), F.round(0.4 * F.col("r") + 0.3 * F.col("c") + 0.3 * F.col("s"), 6).alias("total"))


def plain_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The processor without a model: words at white space, and which hold an Arabic letter; confidence 1 where any does."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.filter("w", lambda x: x.rlike(fixed.ARABIC_BLOCKS))).cast("long").alias("arabic"))
    return rows.select("doc_id", "tokens", "arabic", F.when(F.col("arabic") > 0, 1.0).otherwise(0.0).alias("confidence"))


def claim_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's five surest claims as numbered lines of a context."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey", "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") / 1000000, 8).alias("c"))
    w = Window.partitionBy("customer").orderBy(F.desc("c"), "o_orderkey")
    rows = o.withColumn("n", F.row_number().over(w)).where("n <= 5")
    line = F.concat(F.col("n").cast("string"), F.lit(". **"), "o_orderpriority", F.lit("** is **"), "o_orderstatus", F.lit("** (order "), F.col("o_orderkey").cast("string"), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda s: s.line)
    return rows.groupBy("customer").agg(F.count(F.lit(1)).alias("claims"), F.array_join(lines, "\n").alias("context"))


def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's sources for an answer: the ten best chunks, once each, and the cache key of the query with the first five."""
    best = vec.top_k(fusion.best_per_chunk(ranked_lists(spark, sf)), 10, tie="chunk_id")
    rows = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s.chunk_id.cast("string")).alias("ids"))
    key = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.array_join(F.slice("ids", 1, 5), "|")).cast("binary"))
    return rows.select("query_id", F.array_join("ids", ",").alias("sources"), F.substring(key, 1, 12).alias("key"))


def fallback_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Of each community (source) the four longest partial answers over 20 characters, 200 characters of each, joined, 600 at most: what is said without a model."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    # the texts that are not said are left behind before the window
    rows = table(spark, sf, "documents").where(F.length("text") > 20).select("source", "doc_id", "n_chars", F.trim(F.substring("text", 1, 200)).alias("said"))
    rows = rows.withColumn("n", F.row_number().over(w)).where("n <= 4")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda s: s.said)
    joined = rows.groupBy("source").agg(F.count(F.lit(1)).alias("answers"), F.substring(F.array_join(parts, " | "), 1, 600).alias("said"))
    return joined.select("source", "answers", F.md5(F.col("said").cast("binary")).alias("digest"))


def deleted_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points left of each document (label) after one is deleted with all its points and those without a document go."""
    index = vectors(spark, sf).withColumn("document", F.when(F.col("vec_id") % 7 != 0, F.col("label")))
    gone = index.agg(F.min("document").alias("document"))
    left = index.where("document is not null").join(F.broadcast(gone), "document", "left_anti")
    return left.groupBy("document").agg(F.count(F.lit(1)).alias("points"))


QUERIES = {f.__name__: f for f in (case_scores, semantic_mode, mode_dispatch, dual_level, unified_pipeline, community_levels, set_operations, undirected_relations, benchmark_score, plain_tokens, claim_context, answer_sources, fallback_reduce, deleted_points)}

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: NOT list_contains({1}, x)))"
_SET = "list_distinct(regexp_split_to_array(lower(text), '\\s+'))"
_NEAR = f"SELECT query_id, vec_id AS chunk_id, score, rank FROM ({_top_sql(_COS, k=30)})"
_SEMANTIC = f"""n AS ({_NEAR}), d AS (SELECT doc_id, {_SET} AS w FROM documents),
  s AS (SELECT query_id, chunk_id, rank AS old_rank, coalesce(round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6), score) AS score FROM n LEFT JOIN d a ON a.doc_id = query_id LEFT JOIN d b ON b.doc_id = chunk_id),
  m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS new_rank FROM s)"""
_NAMES = "w AS (SELECT entity, confidence, unnest(list_distinct(regexp_split_to_array(lower(name), '\\s+'))) AS query_id FROM entities)"
_LEVELS = f"""{with_("mentions", "entities", "chunk_documents")}, {_NAMES},
  f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, entity) <= 3),
  o AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, chunk_id) <= 3),
  low AS (SELECT f.query_id, o.chunk_id, max(o.confidence) AS score FROM f JOIN o USING (entity) GROUP BY ALL),
  c AS (SELECT chunk_id, CAST(c_nationkey AS BIGINT) AS community FROM chunk_documents JOIN customer ON c_custkey = document_id),
  t AS (SELECT query_id, community, count(*) AS n FROM mentions JOIN c USING (chunk_id) JOIN w USING (entity) GROUP BY ALL),
  r AS (SELECT query_id, community, round(n / max(n) OVER (PARTITION BY query_id), 6) AS relevance FROM t),
  b AS (SELECT * FROM r WHERE relevance > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, community) <= 5),
  k AS (SELECT community, chunk_id, count(*) AS weight FROM mentions JOIN c USING (chunk_id) GROUP BY community, chunk_id QUALIFY row_number() OVER (PARTITION BY community ORDER BY weight DESC, chunk_id) <= 3),
  high AS (SELECT query_id, chunk_id, max(relevance) AS score FROM b JOIN k USING (community) GROUP BY ALL),
  dual AS (SELECT query_id, chunk_id, round(CASE WHEN l.chunk_id IS NOT NULL THEN l.score * {LOW} ELSE h.score * {HIGH} END, 6) AS fused FROM low l FULL JOIN high h USING (query_id, chunk_id))"""
_BENCH = _WORDS.format("{0}", _list([*fixed.QUESTION_STOP_WORDS, ""]))
ORACLE_SQL = {
    "semantic_mode": f"WITH {_SEMANTIC} SELECT query_id, chunk_id, score, old_rank - new_rank AS rank_change FROM m WHERE new_rank <= 10",
    "mode_dispatch": f"""WITH {_SEMANTIC}, u AS (SELECT 'vector' AS asked, 'vector' AS used, query_id, chunk_id, score FROM n WHERE rank <= 10
      UNION ALL SELECT 'semantic', 'semantic', query_id, chunk_id, score FROM m WHERE new_rank <= 10 UNION ALL SELECT 'drift', 'vector', query_id, vec_id, score FROM ({_top_sql(_COS, k=50)}))
      SELECT asked, used, query_id, count(*) AS n, round(max(score), 6) AS best, min(chunk_id) AS least FROM u GROUP BY ALL""",
    "dual_level": f"{_LEVELS} SELECT * FROM dual",
    "unified_pipeline": f"""{_LEVELS}, u AS (SELECT query_id, chunk_id, score, 'low' AS list FROM low UNION ALL SELECT query_id, chunk_id, score, 'high' FROM high UNION ALL SELECT query_id, chunk_id, fused, 'dual' FROM dual),
      g AS (SELECT query_id, chunk_id, max(score) AS score, string_agg(DISTINCT list, '+' ORDER BY list) AS sources FROM u GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, chunk_id) <= 10)
      SELECT *, round(avg(score) OVER (PARTITION BY query_id), 6) AS confidence FROM g""",
    "set_operations": f"""{with_("mentions")}, r AS (SELECT entity, o_orderstatus AS s FROM mentions JOIN orders ON o_orderkey = chunk_id), f AS (SELECT entity FROM r WHERE s = 'F'), o AS (SELECT entity FROM r WHERE s = 'O')
      SELECT 'intersect' AS kind, entity FROM (FROM f INTERSECT FROM o) UNION ALL SELECT 'except', entity FROM (FROM f EXCEPT FROM o) UNION ALL SELECT 'except_all', entity FROM (FROM f EXCEPT ALL FROM o)""",
    "undirected_relations": "WITH r AS (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, l_orderkey AS o, l_linenumber AS l FROM lineitem) SELECT arg_min(source, (o, l, source, target)) AS source, arg_min(target, (o, l, source, target)) AS target, type, count(*) AS n FROM r GROUP BY least(source, target), greatest(source, target), type",
    "case_scores": f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
      t AS (SELECT *, lower(answer) AS low, {_key_terms("question")} AS x, {_key_terms("answer")} AS y, list_distinct(regexp_extract_all(question, '[A-Z][a-z]+')) AS e, {_CLASS.format("question")} AS class FROM p),
      c AS (SELECT conv_id, turn, len({_SENTENCES.format("answer")}) >= 3 AS chunk_count, len(e) = 0 OR len(list_filter(e, lambda w: contains(low, lower(w)))) > 0 AS entity_match, CASE WHEN len(list_filter(x, lambda w: length(w) > 4)) = 0 THEN true ELSE len(list_filter(x, lambda w: length(w) > 4 AND contains(low, w))) / len(list_filter(x, lambda w: length(w) > 4)) > 0.5 END AS chunk_content,
      CASE WHEN len(x) = 0 THEN true ELSE len(list_filter(x[1:3], lambda w: contains(low, w))) / len(x[1:3]) >= 0.5 END AS answer_keywords, round_even(0.4 * {_share(_inter("y", "x"), _union("y", "x"))} + 0.6 * {_share(_inter("y", "x"), "len(x)")}, 3) >= 0.3 AS similarity, {_MODE.format("question", "class")} IN ('local', 'hybrid') AS recommended FROM t),
      s AS (SELECT *, 0.10 * CAST(chunk_count AS INTEGER) + 0.15 * CAST(entity_match AS INTEGER) + 0.20 * CAST(chunk_content AS INTEGER) + 0.20 * CAST(answer_keywords AS INTEGER) + 0.35 * CAST(similarity AS INTEGER) AS sum FROM c),
      z AS (SELECT *, CAST(round(CASE WHEN recommended AND sum > 0.5 THEN least(sum + 0.1, 1) ELSE sum END, 6) AS DOUBLE) AS score FROM s) SELECT * EXCLUDE (sum), score >= 0.6 AS passed FROM z""",
    "benchmark_score": f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
      w AS (SELECT *, {_BENCH.format("question")} AS q, {_BENCH.format("answer")} AS a, list_distinct(regexp_extract_all(question, '[A-Z][a-z]+')) AS e, least(length(answer) / 500, 1) AS l FROM p),
      s AS (SELECT *, CASE WHEN len(q) > 0 THEN least(len(list_intersect(q, a)) / len(q) * 1.5, 1) ELSE 0 END AS o, CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: contains(lower(answer), lower(x)))) / len(e) ELSE l END AS c, len(list_filter({_list(fixed.SPECIFIC_MARKS)}, lambda x: contains(answer, x))) / {len(fixed.SPECIFIC_MARKS)} AS i FROM w),
      z AS (SELECT conv_id, turn, CASE WHEN length(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) >= 10 THEN 1.0::DOUBLE ELSE 0 END AS y, (o + l) / 2 * y AS r, c * y AS c, greatest(c, i) * y AS s FROM s)
      SELECT conv_id, turn, round(r, 6) AS relevance, round(z.c, 6) AS completeness, round(z.s, 6) AS accuracy, round(0.4 * r + 0.3 * z.c + 0.3 * z.s, 6) AS total FROM z""",
    "plain_tokens": f"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), a AS (SELECT doc_id, len(w) AS tokens, len(list_filter(w, lambda x: regexp_matches(x, '{fixed.ARABIC_BLOCKS}'))) AS arabic FROM t) SELECT *, CASE WHEN arabic > 0 THEN 1.0::DOUBLE ELSE 0 END AS confidence FROM a",
    "claim_context": "WITH r AS (SELECT o_custkey AS customer, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 1000000, 8) DESC, o_orderkey) AS n FROM orders) SELECT customer, count(*) AS claims, string_agg(n || '. **' || o_orderpriority || '** is **' || o_orderstatus || '** (order ' || o_orderkey || ')', chr(10) ORDER BY n) AS context FROM r WHERE n <= 5 GROUP BY customer",
    "answer_sources": f"{with_('ranked_lists')}, b AS (SELECT query_id, chunk_id, max(score) AS score FROM ranked_lists GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM b) SELECT query_id, string_agg(chunk_id, ',' ORDER BY n) AS sources, substr(md5(query_id || '|' || string_agg(chunk_id, '|' ORDER BY n) FILTER (n <= 5)), 1, 12) AS key FROM r WHERE n <= 10 GROUP BY query_id",
    "fallback_reduce": "WITH r AS (SELECT source, trim(substr(text, 1, 200), ' ') AS said, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE length(text) > 20) SELECT source, count(*) AS answers, md5(substr(string_agg(said, ' | ' ORDER BY n), 1, 600)) AS digest FROM r WHERE n <= 4 GROUP BY source",
    "deleted_points": f"{with_('vectors')}, d AS (SELECT CASE WHEN vec_id % 7 != 0 THEN label END AS document FROM vectors) SELECT document, count(*) AS points FROM d WHERE document != (SELECT min(document) FROM d) GROUP BY document",
}
