"""Queries that fuse, rerank and judge ranked lists. Users stand for queries, event types for retrievers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import fusion as op
from tessera.operators import metrics
from tessera.sources.tables import ranked_lists, table, with_

WEIGHTS = {"view": 0.7, "click": 0.95, "purchase": 1.0}
ORDER = ["purchase", "click", "signup", "view", "error"]
_L = with_("ranked_lists")
_RANKED = f"{_L}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id) AS rank FROM ranked_lists)"
_BEST = f"{_L}, best AS (SELECT query_id, chunk_id, document_id, max(score) AS score FROM ranked_lists GROUP BY ALL)"


def _weight(values: dict[str, float], other: str = "0.0") -> str:
    return "CASE list " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _best(spark, sf):
    return ranked_lists(spark, sf).groupBy("query_id", "chunk_id", "document_id").agg(F.max("score").alias("score"))


def rrf_two_lists(spark: SparkSession, sf: str) -> DataFrame:
    return op.rrf(ranked_lists(spark, sf).where("list in ('view', 'click')")).drop("lists")


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return op.rrf(ranked_lists(spark, sf).where(F.col("list").isin(*WEIGHTS)), WEIGHTS)


def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return op.weighted(ranked_lists(spark, sf).where(F.col("list").isin(*WEIGHTS)), WEIGHTS)


def interleave(spark: SparkSession, sf: str) -> DataFrame:
    return op.interleaved(ranked_lists(spark, sf), ORDER)


def mix_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranked_lists(spark, sf).drop("document_id")
    return op.mixed(rows.where("list = 'purchase'"), rows.where("list = 'click'"), 0.75)


def dual_fuse(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranked_lists(spark, sf)
    return op.dual(rows.where("list = 'view'"), rows.where("list = 'click'"), 0.8, 0.2)


def unified_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return op.unified(ranked_lists(spark, sf))


def dedupe_max(spark: SparkSession, sf: str) -> DataFrame:
    return op.best_per_chunk(ranked_lists(spark, sf))


def source_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return op.round_robin_sources(_best(spark, sf), 12)


def fused_responses(spark: SparkSession, sf: str) -> DataFrame:
    """What the dispatcher adds up over the fused responses: candidates, and the lists' times (here counts)."""
    rows = ranked_lists(spark, sf)
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("list").alias("responses"), F.countDistinct("chunk_id").alias("unique_chunks"))


def term_boost(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    score = F.round((F.col("doc_id") % 100) / 100, 6)
    return docs.select("doc_id", F.round(op.term_boost(score, F.col("text"), ["the", "und", "que"]), 6).alias("score"))


def keyword_rerank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    score = F.round((F.col("doc_id") % 100) / 100, 6)
    rows = docs.select("doc_id", score.alias("score"), F.round(op.keyword_order(score, F.col("text"), ["the", "und", "que"]), 6).alias("key"))
    return rows.orderBy(F.desc("key"), "doc_id").limit(50).select("doc_id", "score", "key")


def rerank_change(spark: SparkSession, sf: str) -> DataFrame:
    rows = _best(spark, sf)
    new = F.when(F.col("chunk_id") % 5 != 0, F.round(1 - F.col("score") / 2, 6))
    return op.reranked(rows, new, 10).select("query_id", "chunk_id", "score", "new_score", "old_rank", "new_rank", "rank_change")


def hybrid_entity_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranked_lists(spark, sf).withColumnRenamed("chunk_id", "entity")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")
    keyword = rows.where("list = 'view'").select("query_id", "entity", (F.row_number().over(w) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("n"))
    return op.hybrid_entities(keyword, rows.where("list = 'click'").select("query_id", "entity", "score"))


def validation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return op.validation(_best(spark, sf))


def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The first k of each query at or above a threshold."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = _best(spark, sf).where("score >= 0.3").withColumn("rank", F.row_number().over(w).cast("long"))
    return rows.where("rank <= 5").select("query_id", "chunk_id", "score", "rank")


def combined_subresults(spark: SparkSession, sf: str) -> DataFrame:
    """Results of sub-queries combined: the first three of each in sequence, weighted by their order."""
    ranked = op.ranks(ranked_lists(spark, sf)).where("rank <= 3")
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("list"))
    rows = ranked.withColumn("weighted", F.round(F.col("score") * F.greatest(F.lit(1), F.lit(4) - place), 6))
    return rows.groupBy("query_id", "chunk_id").agg(F.max("weighted").alias("weighted"), F.min(place).cast("long").alias("first_list"))


def _judged(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    results = _best(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20").select("query_id", "chunk_id", "rank")
    qrels = ranked_lists(spark, sf).where("list = 'purchase'").select("query_id", "chunk_id", F.ceil(F.col("score") * 3).cast("double").alias("relevance"))
    return results, qrels, metrics.judged(results, qrels)


def prf_hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_query(_judged(spark, sf)[2])


def mrr_map(spark: SparkSession, sf: str) -> DataFrame:
    """Macro means over all queries."""
    per = metrics.per_query(_judged(spark, sf)[2])
    return per.agg(F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("ap"), 5).alias("map"), F.round(F.avg("precision_5"), 5).alias("precision_5"), F.round(F.avg("recall_10"), 5).alias("recall_10"))


def ndcg10(spark: SparkSession, sf: str) -> DataFrame:
    _, qrels, rows = _judged(spark, sf)
    return metrics.ndcg(rows, qrels)


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summary(table(spark, sf, "events"), ["event_type"], "value")


def mode_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Metric by mode: a column for each event type."""
    rows = table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("long"))
    out = rows.groupBy("hour").pivot("event_type", ORDER).agg(F.round(F.avg("value"), 9))
    return out.select("hour", *(F.col(c).alias(f"avg_{c}") for c in ORDER))


def best_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The mode with the best mean for each query, and its mean."""
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("mean"))
    return per.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("mean"), "event_type")).alias("best_mode"), F.max("mean").alias("mean"))


def grouped_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and means by mode, by hour, and over all."""
    rows = table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("long"))
    return rows.groupingSets([["event_type"], ["hour"], []], "event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))


def hop_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Results by hop distance 0, 1, 2 or more, and distinct documents, of each query."""
    rows = op.ranks(ranked_lists(spark, sf))
    hop = F.col("rank") - 1
    return rows.groupBy("query_id").agg(F.count_if(hop == 0).alias("hop_0"), F.count_if(hop == 1).alias("hop_1"), F.count_if(hop >= 2).alias("hop_2_plus"), F.countDistinct("document_id").alias("documents"))


def first_relevant(spark: SparkSession, sf: str) -> DataFrame:
    rows = _judged(spark, sf)[2]
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"), F.round(F.avg((F.col("relevance") > 0).cast("double")), 6).alias("coverage"))


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Precision over the retrieved, recall and NDCG at 10 with relevance 0 or 1."""
    return metrics.of_retrieved(_judged(spark, sf)[2])


QUERIES = {f.__name__: f for f in (rrf_two_lists, rrf_weighted, weighted_fusion, interleave, mix_union, dual_fuse, unified_fuse, dedupe_max, source_round_robin, fused_responses, term_boost, keyword_rerank, rerank_change, hybrid_entity_rank, validation_ratio, score_threshold, combined_subresults, prf_hit_at_k, mrr_map, ndcg10, metric_summary, mode_pivot, best_mode, grouped_modes, hop_buckets, first_relevant, binary_metrics)}

_TOTAL = sum(WEIGHTS.values())
_IN = ", ".join(f"'{w}'" for w in WEIGHTS)
_TERMS = "len(list_filter(['the', 'und', 'que'], lambda t: contains(lower(text), t)))"
_RESULTS = """results AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best) WHERE rank <= 20),
  qrels AS (SELECT query_id, chunk_id, CAST(ceil(score * 3) AS DOUBLE) AS relevance FROM ranked_lists WHERE list = 'purchase'),
  totals AS (SELECT query_id, count(*) AS n_relevant FROM qrels WHERE relevance > 0 GROUP BY query_id),
  judged AS (SELECT query_id, chunk_id, rank, coalesce(relevance, 0) AS relevance, coalesce(n_relevant, 0) AS n FROM results LEFT JOIN qrels USING (query_id, chunk_id) LEFT JOIN totals USING (query_id)),
  seen AS (SELECT *, CAST(relevance > 0 AS INTEGER) AS hit, sum(CAST(relevance > 0 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM judged)"""
_CUT = "sum(CASE WHEN rank <= {0} THEN hit ELSE 0 END) AS h{0}"
_PER = f"""{_BEST}, {_RESULTS}, per AS (SELECT query_id, max(n) AS n, coalesce(max(CASE WHEN hit = 1 THEN 1.0 / rank END), 0) AS rr, sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) AS ap, {", ".join(_CUT.format(k) for k in metrics.CUTS)} FROM seen GROUP BY query_id),
  m AS (SELECT query_id, round(rr, 6) AS mrr, round(CASE WHEN n > 0 THEN ap / n ELSE 0 END, 6) AS ap, """ + ", ".join(
    f"round(h{k} / {k}, 6) AS precision_{k}, round(CASE WHEN n > 0 THEN h{k} / n ELSE 0 END, 6) AS recall_{k}, round(CASE WHEN h{k} > 0 THEN 2 * (h{k} / {k}) * (h{k} / n) / (h{k} / {k} + h{k} / n) ELSE 0 END, 6) AS f1_{k}, CAST(h{k} > 0 AS BIGINT) AS hit_{k}" for k in metrics.CUTS
) + " FROM per)"

ORACLE_SQL = {
    "binary_metrics": f"{_BEST}, {_RESULTS}, h AS (SELECT query_id, sum(hit) AS hits, count(*) AS found, max(n) AS n, sum(hit / log2(rank + 1)) AS gain FROM seen WHERE rank <= 10 GROUP BY query_id) SELECT query_id, round(hits / found, 6) AS precision, round(CASE WHEN n > 0 THEN hits / n ELSE 0 END, 6) AS recall, round(CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM h",
    "rrf_two_lists": f"{_RANKED} SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS fused, max(score) AS best FROM ranked WHERE list IN ('view', 'click') GROUP BY ALL",
    "rrf_weighted": f"{_RANKED} SELECT query_id, chunk_id, round(sum({_weight({k: v / _TOTAL for k, v in WEIGHTS.items()})} / (60 + rank)), 9) AS fused, max(score) AS best, count(*) AS lists FROM ranked WHERE list IN ({_IN}) GROUP BY query_id, chunk_id",
    "weighted_fusion": f"{_L} SELECT query_id, chunk_id, round(sum({_weight(WEIGHTS)} * score) * (1 + 0.1 * (count(*) - 1)), 6) AS fused, count(*) AS lists FROM ranked_lists WHERE list IN ({_IN}) GROUP BY query_id, chunk_id",
    "interleave": f"""{_RANKED}, t AS (SELECT *, list_position({ORDER}, list) AS turn FROM ranked), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, turn) AS n FROM t)
      SELECT query_id, chunk_id, list, row_number() OVER (PARTITION BY query_id ORDER BY rank, turn) AS position FROM o WHERE n = 1""",
    "mix_union": f"""{_L}, u AS (SELECT *, 0 AS turn FROM ranked_lists WHERE list = 'purchase' UNION ALL SELECT *, 1 FROM ranked_lists WHERE list = 'click' AND score >= 0.75)
      SELECT query_id, chunk_id, list, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, score DESC) AS n FROM u) WHERE n = 1""",
    "dual_fuse": f"""{_L}, u AS (SELECT *, 0 AS turn, score * 0.8 AS fused FROM ranked_lists WHERE list = 'view' UNION ALL SELECT *, 1, score * 0.2 FROM ranked_lists WHERE list = 'click')
      SELECT query_id, chunk_id, round(fused, 6) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, fused DESC) AS n FROM u) WHERE n = 1""",
    "unified_fuse": f"{_L} SELECT query_id, chunk_id, max(score) AS score, string_agg(DISTINCT list, '+' ORDER BY list) AS sources FROM ranked_lists GROUP BY query_id, chunk_id",
    "dedupe_max": f"{_L} SELECT query_id, chunk_id, score, list FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, list) AS n FROM ranked_lists) WHERE n = 1",
    "source_round_robin": f"""{_BEST}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM best),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY query_id, document_id) AS first FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS position FROM t) SELECT query_id, document_id, chunk_id, position FROM r WHERE position <= 12""",
    "fused_responses": f"{_L} SELECT query_id, count(*) AS candidates, count(DISTINCT list) AS responses, count(DISTINCT chunk_id) AS unique_chunks FROM ranked_lists GROUP BY query_id",
    "term_boost": f"SELECT doc_id, round(least(0.98, round((doc_id % 100) / 100, 6) + 0.05 * least({_TERMS}, 2)), 6) AS score FROM documents",
    "keyword_rerank": f"SELECT doc_id, round((doc_id % 100) / 100, 6) AS score, round(round((doc_id % 100) / 100, 6) + least(0.3 * {_TERMS}, 0.5), 6) AS key FROM documents ORDER BY key DESC, doc_id LIMIT 50",
    "rerank_change": f"""{_BEST}, s AS (SELECT *, CASE WHEN chunk_id % 5 != 0 THEN round(1 - score / 2, 6) ELSE score END AS new_score FROM best),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS old_rank, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, chunk_id) AS new_rank FROM s)
      SELECT query_id, chunk_id, score, new_score, old_rank, new_rank, old_rank - new_rank AS rank_change FROM r WHERE new_rank <= 10""",
    "hybrid_entity_rank": f"""{_RANKED}, k AS (SELECT query_id, chunk_id AS entity, rank - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM ranked WHERE list = 'view'), v AS (SELECT query_id, chunk_id AS entity, score FROM ranked WHERE list = 'click')
      SELECT query_id, entity, round(0.3 * coalesce((n - place) / n, 0) + 0.7 * coalesce(score, 0), 6) AS score FROM k FULL OUTER JOIN v USING (query_id, entity)""",
    "validation_ratio": f"""{_BEST}, p AS (SELECT query_id, count(*) AS results, count(*) FILTER (score >= 0.5) AS relevant FROM best GROUP BY query_id)
      SELECT query_id, results, relevant, round(relevant / results, 6) AS ratio, CASE WHEN relevant / results >= 0.4 THEN 'VALIDATED' WHEN relevant / results >= 0.2 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM p""",
    "score_threshold": f"{_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best WHERE score >= 0.3) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 5",
    "combined_subresults": f"""{_RANKED}, p AS (SELECT *, list_position({ORDER}, list) AS place FROM ranked WHERE rank <= 3)
      SELECT query_id, chunk_id, max(round(score * greatest(1, 4 - place), 6)) AS weighted, CAST(min(place) AS BIGINT) AS first_list FROM p GROUP BY query_id, chunk_id""",
    "prf_hit_at_k": f"{_PER} SELECT * FROM m",
    "mrr_map": f"{_PER} SELECT round(avg(mrr), 5) AS mrr, round(avg(ap), 5) AS map, round(avg(precision_5), 5) AS precision_5, round(avg(recall_10), 5) AS recall_10 FROM m",
    "ndcg10": f"""{_BEST}, {_RESULTS}, g AS (SELECT query_id, sum(relevance / log2(rank + 1)) AS dcg FROM judged WHERE rank <= 10 GROUP BY query_id),
      i AS (SELECT query_id, sum(relevance / log2(i + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS i FROM qrels) WHERE i <= 10 GROUP BY query_id)
      SELECT query_id, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg FROM g LEFT JOIN i USING (query_id)""",
    "metric_summary": "SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS greatest, count(value) AS n FROM events GROUP BY event_type",
    "mode_pivot": "SELECT hour(ts) AS hour, " + ", ".join(f"round(avg(value) FILTER (event_type = '{c}'), 9) AS avg_{c}" for c in ORDER) + " FROM events GROUP BY 1",
    "best_mode": "WITH p AS (SELECT user_id, event_type, round(avg(value), 9) AS mean FROM events GROUP BY ALL) SELECT user_id, event_type AS best_mode, mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, event_type) AS n FROM p) WHERE n = 1",
    "grouped_modes": "SELECT event_type, hour, count(*) AS n, round(avg(value), 9) AS mean FROM (SELECT *, hour(ts) AS hour FROM events) GROUP BY GROUPING SETS ((event_type), (hour), ())",
    "hop_buckets": f"{_RANKED} SELECT query_id, count(*) FILTER (rank = 1) AS hop_0, count(*) FILTER (rank = 2) AS hop_1, count(*) FILTER (rank > 2) AS hop_2_plus, count(DISTINCT document_id) AS documents FROM ranked GROUP BY query_id",
    "first_relevant": f"{_BEST}, {_RESULTS} SELECT query_id, min(rank) FILTER (relevance > 0) AS first, round(avg(CAST(relevance > 0 AS DOUBLE)), 6) AS coverage FROM judged GROUP BY query_id",
}
