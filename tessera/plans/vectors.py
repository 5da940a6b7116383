"""Queries over the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import enhancement
from tessera.operators import vectors as op
from tessera.operators.vector_index import VectorIndex
from tessera.sources.tables import table, vectors, with_

#: The stated query set: these rows' vectors are asked of all rows.
QUERIES_ARE = "vec_id % 20 = 0"
K = 10
_Q = f"q AS (SELECT vec_id AS query_id, v AS q, label AS q_label FROM vectors WHERE {QUERIES_ARE})"
_V = with_("vectors") + ", " + _Q


def _queries(index: DataFrame) -> DataFrame:
    return index.where(QUERIES_ARE)


def _top(spark, sf, measure, threshold=None, k=K, same_label=False):
    index = vectors(spark, sf)
    return op.nearest(_queries(index), index, k, measure, threshold, same_label)


def _with_vectors(found: DataFrame, index: DataFrame) -> DataFrame:
    return found.join(index.select("vec_id", "v"), "vec_id")


def _top_sql(score: str, where: str = "vec_id != query_id", threshold: float | None = None, k: int = K) -> str:
    cut = f" AND round({score}, 6) >= {threshold}" if threshold is not None else ""
    return f"""{_V}, s AS (SELECT query_id, vec_id, v, label, round({score}, 6) AS score FROM vectors, q WHERE {where}{cut}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= {k}"""


_COS = "list_cosine_similarity(v, q)"
_KEEP = ["query_id", "vec_id", "score", "rank"]
_PICK = "SELECT query_id, vec_id, score, rank FROM ("


def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "cosine").select(*_KEEP)


def vec_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "cosine", 0.1, same_label=True).select(*_KEEP)


def vec_dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "dot").select(*_KEEP)


def vec_euclid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "euclid").select(*_KEEP)


def entity_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of 0.2 or more, a vector without length left out."""
    return _top(spark, sf, "cosine", 0.2, 5).select(*_KEEP)


def sim_join_topk(spark: SparkSession, sf: str) -> DataFrame:
    return op.similar_pairs(vectors(spark, sf), 5, 0.3)


def emb_normalized(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).select("vec_id", vector.normalized(F.transform("v", lambda x: x * 3)).alias("n"))
    return rows.select("vec_id", F.round(vector.norm("n"), 6).alias("length"), F.round(F.get("n", F.lit(0)), 6).alias("first"))


def emb_combine(spark: SparkSession, sf: str) -> DataFrame:
    index = vectors(spark, sf)
    pairs = index.alias("a").join(index.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    rows = pairs.select(F.col("a.vec_id").alias("vec_id"), vector.blended(F.col("a.v"), F.col("b.v"), 0.7).alias("c"))
    return rows.select("vec_id", F.round(F.get("c", F.lit(0)), 6).alias("c0"), F.round(F.get("c", F.lit(63)), 6).alias("c63"), F.round(vector.norm("c"), 6).alias("length"))


def emb_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.mean_vectors(vectors(spark, sf), "label")
    return rows.select("label", F.round(F.get("mean", F.lit(0)), 6).alias("c0"), F.round(F.get("mean", F.lit(63)), 6).alias("c63"))


def emb_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return op.diversity(_with_vectors(_top(spark, sf, "cosine"), vectors(spark, sf)))


def relevance_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    """The most and the least relevant vector of each query: the nearest and the farthest."""
    best, worst = (_top(spark, sf, m, k=1).select("query_id", F.col("score").alias(m)) for m in ("cosine", "opposite"))
    return best.join(worst, "query_id").select("query_id", F.round(vector.relevance(F.col("cosine")), 6).alias("best"), F.round(vector.relevance(-F.col("opposite")), 6).alias("worst"))


def mmr(spark: SparkSession, sf: str) -> DataFrame:
    return op.mmr(_with_vectors(_top(spark, sf, "cosine", k=30), vectors(spark, sf)), 10)


def vec_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """vec_topk through the inverted lists, exactly."""
    index = vectors(spark, sf)
    return VectorIndex(index).search(_queries(index), K, exact=True).withColumnsRenamed({"source": "query_id", "target": "vec_id"}).select(*_KEEP)


def hyde_topk(spark: SparkSession, sf: str) -> DataFrame:
    """vec_topk of queries enhanced by three hypothetical answers: the vectors of the next three numbers stand for them."""
    index = vectors(spark, sf)
    queries = _queries(index)
    next_ids = queries.select("vec_id", F.explode(F.array(*(F.col("vec_id") + i for i in (1, 2, 3)))).alias("answer"))
    answers = next_ids.join(index.select(F.col("vec_id").alias("answer"), "v"), "answer")
    return op.nearest(enhancement.enhanced(queries, answers), index, K).select(*_KEEP)


def hype_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunks of each query by hypothetical questions: four neighbouring vectors are one chunk's."""
    index = vectors(spark, sf)
    return enhancement.by_questions(_queries(index), index.withColumn("chunk_id", F.floor(F.col("vec_id") / 4)), K, 4)


def hashed_embed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For every benchmark item the twenty documents of highest cosine of hashed words."""
    # words as rows of their own, so that the key beside them is the id and not the text
    words = lambda t, key: table(spark, sf, t).select(key.alias("id"), F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word")).where("word != ''")
    # items get negative numbers, as equal ids count as one vector
    items, docs = (op.hashed_vectors(words(t, key), "word", "id") for t, key in (("benchmark", -F.col("item_id") - 1), ("documents", F.col("doc_id"))))
    return op.nearest(items, docs, 20).select((-F.col("query_id") - 1).alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


def vector_scroll(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the scroll scan."""
    return vectors(spark, sf).orderBy("vec_id").offset(100).limit(100).select("vec_id", "label")


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Points from two writes: the newer of each id stays, those without a vector are skipped."""
    index = vectors(spark, sf)
    second = index.where("vec_id % 3 = 0").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.transform("v", lambda x: -x)).alias("v"), "label").withColumn("version", F.lit(2))
    rows = op.latest_points(index.withColumn("version", F.lit(1)).unionByName(second), "vec_id", "version")
    return rows.select("vec_id", F.col("version").cast("long").alias("version"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("documents"), F.round(F.avg("n_chars"), 4).alias("avg_size"))


QUERIES = {f.__name__: f for f in (vec_topk, vec_topk_filtered, vec_dot_topk, vec_euclid_topk, entity_knn, sim_join_topk, emb_normalized, emb_combine, emb_mean, emb_diversity, relevance_rescaled, mmr, vec_index_topk, hyde_topk, hype_topk, hashed_embed_topk, vector_scroll, vector_upsert, collection_stats)}

_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_BLEND = "list_transform(list_zip(a.v, b.v), lambda p: p[1] * 0.7 + p[2] * 0.3)"
_HASHED = "list_transform(range(64), lambda i: CAST(len(list_filter({0}, lambda w: CAST(concat('0x', substr(md5(w), 1, 4)) AS INTEGER) % 64 = i)) AS DOUBLE))"

ORACLE_SQL = {
    "vec_topk": f"{_PICK}{_top_sql(_COS)})",
    "vec_index_topk": f"{_PICK}{_top_sql(_COS)})",
    "hyde_topk": f"""{_V}, p AS (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM q JOIN vectors ON vec_id - query_id BETWEEN 1 AND 3), m AS (SELECT query_id, i, avg(x) AS x FROM p GROUP BY ALL),
      h AS (SELECT query_id, list(x ORDER BY i) AS m FROM m GROUP BY query_id), u AS (SELECT query_id, list_transform(m, lambda x: x / ({_NORM.format("m")} + 1e-8)) AS m FROM h),
      e AS (SELECT query_id, CASE WHEN m IS NULL THEN q ELSE list_transform(list_zip(q, m), lambda z: z[1] * 0.5 + z[2] * 0.5) END AS q FROM q LEFT JOIN u USING (query_id)),
      s AS (SELECT query_id, vec_id, round({_COS}, 6) AS score FROM vectors, e WHERE vec_id != query_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K}""",
    "hype_topk": f"""{_V}, s AS (SELECT query_id, vec_id // 4 AS chunk_id, max(round({_COS}, 6)) AS score FROM vectors, q WHERE vec_id != query_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= {K}""",
    "vec_topk_filtered": f"{_PICK}{_top_sql(_COS, 'vec_id != query_id AND label = q_label', 0.1)})",
    "vec_dot_topk": f"{_PICK}{_top_sql('list_inner_product(v, q)')})",
    "vec_euclid_topk": f"{_PICK}{_top_sql('-list_distance(v, q)')})",
    "entity_knn": f"{_PICK}{_top_sql(_COS, threshold=0.2, k=5)})",
    "sim_join_topk": f"""{with_("vectors")}, s AS (SELECT a.vec_id AS source, b.vec_id AS target, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 6) AS score FROM vectors a, vectors b WHERE a.vec_id != b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM s WHERE score >= 0.3) SELECT source, target, score, rank FROM r WHERE rank <= 5""",
    "emb_normalized": f"""{with_("vectors")}, n AS (SELECT vec_id, list_transform(v, lambda x: x * 3) AS w FROM vectors), m AS (SELECT vec_id, w, {_NORM.format("w")} + 1e-8 AS l FROM n)
      SELECT vec_id, round({_NORM.format("w")} / l, 6) AS length, round(w[1] / l, 6) AS first FROM m""",
    "emb_combine": f"""{with_("vectors")}, c AS (SELECT a.vec_id, {_BLEND} AS c FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1), m AS (SELECT vec_id, c, {_NORM.format("c")} AS n FROM c)
      SELECT vec_id, round(c[1] / (n + 1e-8), 6) AS c0, round(c[64] / (n + 1e-8), 6) AS c63, round(n / (n + 1e-8), 6) AS length FROM m""",
    "emb_mean": f"""{with_("vectors")}, p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL),
      n AS (SELECT label, sqrt(sum(x * x)) + 1e-8 AS n, max(x) FILTER (i = 1) AS a, max(x) FILTER (i = 64) AS b FROM m GROUP BY label) SELECT label, round(a / n, 6) AS c0, round(b / n, 6) AS c63 FROM n""",
    "emb_diversity": f"WITH t AS ({_PICK.replace('score, rank', 'v')}{_top_sql(_COS)})) SELECT a.query_id, round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM t a JOIN t b ON a.query_id = b.query_id AND a.vec_id < b.vec_id GROUP BY a.query_id",
    "relevance_rescaled": f"{_V} SELECT query_id, round(max(greatest(0, least(1, (round({_COS}, 6) + 1) / 2))), 6) AS best, round(min(greatest(0, least(1, (round({_COS}, 6) + 1) / 2))), 6) AS worst FROM vectors, q WHERE vec_id != query_id GROUP BY query_id",
    "hashed_embed_topk": f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark), w AS (SELECT id, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '') AS words FROM t),
      h AS (SELECT id, {_HASHED.format("words")} AS v FROM w WHERE len(words) > 0), s AS (SELECT -a.id - 1 AS item_id, b.id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM h a, h b WHERE a.id < 0 AND b.id >= 0)
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20""",
    "vector_scroll": f"{with_('vectors')} SELECT vec_id, label FROM vectors ORDER BY vec_id LIMIT 100 OFFSET 100",
    "vector_upsert": f"{with_('vectors')} SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 2 ELSE 1 END AS version, round(CASE WHEN vec_id % 6 = 0 THEN -v[1] ELSE v[1] END, 6) AS first FROM vectors",
    "collection_stats": "SELECT count(*) AS chunks, count(DISTINCT source) AS documents, round(avg(n_chars), 4) AS avg_size FROM documents",
}
