"""Composite retrieval modes and smaller operators around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text, vector
from tessera.operators import fusion, matching, modes
from tessera.operators import vectors as vec
from tessera.plans.graphs import _LINKED, _QUERY, LOW_SQL, NEAR_SQL, QUERIES_ARE, near_chunks, query_terms
from tessera.plans.texts import NAMES_SQL, _list, _Q, _terms, names, questions
from tessera.sources.tables import SQL, entities, gazetteer, mentions, ranked_lists, table, vectors, with_

SYNONYMS = {"company": "firm", "project": "programme", "sales": "revenue", "president": "chair"}
PASSAGES = {"definition": ["is a", "means", "what is"], "procedure": ["how to", "step", "how does"], "comparison": ["compare", "difference", "versus"], "enumeration": ["list", "all", "overview"]}
MODE_WEIGHTS = {"vector": 0.7, "local": 0.95, "global": 1.0}
TERMS = ["the", "und", "que"]


def theme_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Communities (sources) of which any theme (language) holds a text."""
    themes = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("themes"))
    return themes.where(F.exists("themes", lambda t: F.contains(t, F.lit("e")))).select("source", F.size("themes").cast("long").alias("n"))


def community_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The two largest nations of each region."""
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("size"), "n_nationkey")
    ranked = n.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2")
    return ranked.select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation"), "size", "rank")


def multi_level_search(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of two levels with a share each of ten places; those of 0.3 or more; the best six."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    score = F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 9)
    both = c.groupBy(F.col("n_nationkey").cast("long").alias("id")).agg(score.alias("score")).withColumn("level", F.lit(0).cast("long"))
    both = both.unionByName(c.groupBy(F.col("n_regionkey").cast("long").alias("id")).agg(score.alias("score")).withColumn("level", F.lit(1).cast("long")))
    w = Window.partitionBy("level").orderBy(F.desc("score"), "id")
    kept = both.withColumn("n", F.row_number().over(w)).where("n <= 5 and score >= 0.3")
    return kept.orderBy(F.desc("score"), "level", "id").limit(6).select("level", "id", "score")


def alias_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name as it is written against the names of the entities: as they are at 1.0, with words in order and without punctuation at 0.95, else unresolved."""
    known = entities(spark, sf).groupBy("name").agg(F.min("entity").alias("entity")).withColumn("key", text.ensemble_key("name"))
    rows = names(spark, sf).withColumn("trimmed", F.trim(F.regexp_replace("name", r"\s+", " "))).withColumn("name_key", text.ensemble_key("name"))
    exact = known.select(F.col("name").alias("trimmed"), F.col("entity").alias("exact"))
    close = known.groupBy(F.col("key").alias("name_key")).agg(F.min("entity").alias("close"))
    rows = rows.join(exact, "trimmed", "left").join(close, "name_key", "left")
    return rows.select("id", F.coalesce("exact", "close").alias("entity"), F.when(F.col("exact").isNotNull(), 1.0).when(F.col("close").isNotNull(), 0.95).otherwise(0.0).alias("score"))


def entity_type_detect(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("query")
    kind = F.when(low.rlike("who|من "), "Person").when(low.rlike("company|organi|شركة"), "Organization").when(low.rlike("where|city|country"), "Location").when(low.rlike("when|year|date|march"), "Date").otherwise("Any")
    return questions(spark, sf).select("id", kind.alias("type"))


def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """0.5, raised by sources up to 0.3 and by the mean score up to 0.2, of each query's fused results."""
    per = ranked_lists(spark, sf).groupBy("query_id").agg(F.countDistinct("document_id").alias("sources"), F.avg("score").alias("mean"))
    return per.select("query_id", "sources", F.round(0.5 + F.least(F.col("sources") / 10, F.lit(0.3)) + F.least(F.col("mean") / 5, F.lit(0.2)), 7).alias("confidence"))


def vector_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty vector neighbours of each query, raised for keywords in the document of the same id; documents that share a name of three words with the query's own score 0.88."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    near = near_chunks(spark, sf, 30).withColumnRenamed("chunk_id", "doc_id").join(docs, "doc_id")
    boosted = near.select("query_id", "doc_id", F.round(fusion.term_boost(F.col("score"), F.col("text"), TERMS), 6).alias("score"))
    phrases = gazetteer(spark, sf).where(F.contains("name", F.lit(" ")))
    held = matching.linked(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("text_id"), "text"), phrases).select("name", F.col("text_id").alias("doc_id"))
    # all score alike, so of a name its first documents are enough
    first = held.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))).where("n <= 11").drop("n")
    queries = vectors(spark, sf).where(QUERIES_ARE).select(F.col("vec_id").alias("query_id"))
    own = held.join(queries, F.col("doc_id") == F.col("query_id")).select("query_id", "name")
    shared = own.join(first, "name").where("doc_id != query_id").select("query_id", "doc_id", F.lit(0.88).alias("score"))
    best = boosted.unionByName(shared).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return vec.top_k(best, 10, tie="doc_id").drop("rank")


def _related(spark, sf):
    return modes.related_chunks(modes.seeds(query_terms(spark, sf), entities(spark, sf)), mentions(spark, sf))


def global_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of each query's terms, related ones by common chunks, and the chunks that mention most of them."""
    return _related(spark, sf).withColumn("score", F.lit(0.9))


def global_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item asked of all communities (sources). Map: the share of a community's documents with one of the item's terms; keep 0.3 or more, the best six; reduce to a confidence."""
    docs = table(spark, sf, "documents").select("doc_id", "source", text.key_terms("text", 6).alias("terms"))
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(text.key_terms("text", 6)).alias("term"))
    held = docs.select("doc_id", "source", F.explode("terms").alias("term")).join(asked, "term").select("item_id", "source", "doc_id").distinct()
    mapped = held.groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("hits")).join(sizes, "source").select("item_id", "source", F.round(F.col("hits") / F.col("n"), 9).alias("score"))
    best = modes.first_rows(mapped.where("score >= 0.3"), ["item_id"], [F.desc("score"), "source"], 6)
    return best.groupBy("item_id").agg(F.count(F.lit(1)).alias("answers"), F.round(0.7 * F.avg("score") + 0.3 * F.least(F.count(F.lit(1)) / 10, F.lit(1.0)), 6).alias("confidence"))


def hybrid_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of each query's vector, local and global lists of chunks."""
    part = lambda df, name, score: df.select("query_id", F.lit(name).alias("list"), "chunk_id", F.col(score).cast("double").alias("score"))
    low = vec.top_k(modes.low_level(query_terms(spark, sf), entities(spark, sf), mentions(spark, sf), chunks=10), 20, tie="chunk_id")
    lists = part(near_chunks(spark, sf, 20), "vector", "score").unionByName(part(low, "local", "score")).unionByName(part(_related(spark, sf), "global", "n"))
    fused = fusion.rrf(lists, MODE_WEIGHTS).select("query_id", "chunk_id", "lists", F.col("fused").alias("score"))
    return vec.top_k(fused, 15, tie="chunk_id").select("query_id", "chunk_id", F.col("score").alias("fused"), "lists")


def extractive_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document the sentence with most of the query's terms, the first of those."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("place", "sentence"))
    hits = F.size(F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower("sentence"), t)))
    best = rows.withColumn("hits", hits.cast("long")).groupBy("doc_id").agg(F.min_by(F.struct("sentence", "hits"), F.struct(-F.col("hits"), F.col("place"))).alias("b"))
    return best.select("doc_id", "b.hits", F.md5(F.col("b.sentence").cast("binary")).alias("digest"))


def passage_types(spark: SparkSession, sf: str) -> DataFrame:
    """Three types at most of the passage that would answer each query; explanation where none fits."""
    low = F.lower("query")
    found = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(kind)) for kind, words in PASSAGES.items())))
    return questions(spark, sf).select("id", F.when(F.size(found) == 0, "explanation").otherwise(F.array_join(F.slice(found, 1, 3), "|")).alias("types"))


def corrected_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Each query with one synonym put in, two variants at most."""
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SYNONYMS.items())], "place long, word string, other string")
    rows = questions(spark, sf).withColumn("word", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("query"), r"[?!.,]", ""), " "))))
    rows = rows.join(F.broadcast(pairs), "word").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where("n <= 2")
    return rows.select("id", F.replace(F.lower("query"), F.col("word"), F.col("other")).alias("variant"))


def non_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike(r"[^\x00-\x7F]")).alias("non_ascii"), F.count(F.lit(1)).alias("n"))


def benchmark_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The fastest, slowest and most frequent mode of each day."""
    e = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("day"), "event_type").agg(F.round(F.avg("value"), 9).alias("mean"), F.count(F.lit(1)).alias("n"))
    return e.groupBy("day").agg(F.min_by("event_type", F.struct("mean", "event_type")).alias("fastest"), F.min_by("event_type", F.struct(-F.col("mean"), "event_type")).alias("slowest"), F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("most"))


def candidates_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates to disambiguate: of each type the six most mentioned."""
    n = mentions(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    w = Window.partitionBy("type").orderBy(F.desc("mentions"), "entity")
    return entities(spark, sf).join(n, "entity").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 6").select("type", "entity", "mentions", "rank")


def answer_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the hashed words of neighbouring turns: how an answer bears on its question."""
    c = table(spark, sf, "conversations")
    v = vector.hashed_words(text.words(F.lower("text")))
    rows = c.select("conv_id", "turn", v.alias("v"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("v").alias("w"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.coalesce(vector.cosine("v", "w"), F.lit(0.0)), 6).alias("relevance"))


QUERIES = {f.__name__: f for f in (theme_filter, community_ranking, multi_level_search, alias_cascade, entity_type_detect, answer_confidence, vector_mode, global_mode, global_search, hybrid_mode, extractive_answers, passage_types, corrected_queries, non_ascii, benchmark_comparison, candidates_by_type, answer_relevance)}

_C = "c AS (SELECT c.*, n_nationkey, n_regionkey FROM customer c JOIN nation ON c_nationkey = n_nationkey)"
_KEY = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_HITS = f"len(list_filter({_list(TERMS)}, lambda t: contains(lower({{0}}), t)))"
_GLOBAL = """gm AS (SELECT DISTINCT query_id, chunk_id FROM lf JOIN mentions USING (entity)), gs AS (SELECT query_id, entity, count(*) AS shared FROM gm JOIN mentions USING (chunk_id) ANTI JOIN lf USING (query_id, entity) GROUP BY ALL),
      ge AS (SELECT query_id, entity FROM lf UNION ALL SELECT query_id, entity FROM (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, entity) <= 5)),
      g AS (SELECT query_id, chunk_id, count(*) AS n FROM ge JOIN mentions USING (entity) GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) <= 10)"""
_MODES = f"{with_('mentions', 'entities', 'vectors')}, {_QUERY}, {LOW_SQL.format(chunks=10)}"
_SENT = "list_filter(string_split(regexp_replace(text, '([.!?؟])\\s+', '\\1\u241e', 'g'), '\u241e'), lambda s: trim(s, e' \\t\\n') <> '')"
_BAG = "list_transform(range(64), lambda i: CAST(len(list_filter(w, lambda x: CAST(concat('0x', substr(md5(x), 1, 4)) AS INTEGER) % 64 = i)) AS DOUBLE))"
_TYPES = ", ".join(f"CASE WHEN len(list_filter({_list(w)}, lambda w: contains(lower(query), w))) > 0 THEN '{k}' END" for k, w in PASSAGES.items())

ORACLE_SQL = {
    "theme_filter": "SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING bool_or(contains(lang, 'e'))",
    "community_ranking": f"WITH {_C}, s AS (SELECT n_regionkey, n_nationkey, count(*) AS size FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY size DESC, n_nationkey) AS rank FROM s) SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS nation, size, rank FROM r WHERE rank <= 2",
    "multi_level_search": f"WITH {_C}, b AS (SELECT 0::BIGINT AS level, n_nationkey::BIGINT AS id, round(avg(CAST(c_acctbal > 0 AS DOUBLE)), 9) AS score FROM c GROUP BY n_nationkey UNION ALL SELECT 1, n_regionkey, round(avg(CAST(c_acctbal > 0 AS DOUBLE)), 9) FROM c GROUP BY n_regionkey), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS n FROM b) SELECT level, id, score FROM r WHERE n <= 5 AND score >= 0.3 ORDER BY score DESC, level, id LIMIT 6",
    "alias_cascade": f"""{with_("entities")}, a AS (SELECT name, min(entity) AS entity FROM entities GROUP BY name), c AS (SELECT {_KEY.format("name")} AS k, min(entity) AS entity FROM a GROUP BY 1), n AS (SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS t, {_KEY.format("name")} AS k FROM {NAMES_SQL})
      SELECT id, coalesce(a.entity, c.entity) AS entity, CAST(CASE WHEN a.entity IS NOT NULL THEN 1.0 WHEN c.entity IS NOT NULL THEN 0.95 ELSE 0 END AS DOUBLE) AS score FROM n LEFT JOIN a ON a.name = t LEFT JOIN c USING (k)""",
    "entity_type_detect": f"SELECT id, CASE WHEN regexp_matches(lower(query), 'who|من ') THEN 'Person' WHEN regexp_matches(lower(query), 'company|organi|شركة') THEN 'Organization' WHEN regexp_matches(lower(query), 'where|city|country') THEN 'Location' WHEN regexp_matches(lower(query), 'when|year|date|march') THEN 'Date' ELSE 'Any' END AS type FROM {_Q}",
    "answer_confidence": f"{with_('ranked_lists')}, p AS (SELECT query_id, count(DISTINCT document_id) AS sources, avg(score) AS mean FROM ranked_lists GROUP BY query_id) SELECT query_id, sources, round(0.5 + least(sources / 10, 0.3) + least(mean / 5, 0.2), 7) AS confidence FROM p",
    "vector_mode": f"""{_LINKED}, vectors AS ({SQL["vectors"]}), {_QUERY}, {NEAR_SQL.format(k=30).replace("v AS (", "nv AS (", 1)}, h AS (SELECT name, text_id AS doc_id FROM l WHERE kind = 'document' AND contains(name, ' ')),
      u AS (SELECT query_id, doc_id, round(least(0.98, score + 0.05 * least({_HITS.format('text')}, 2)), 6) AS score FROM nv JOIN documents ON doc_id = chunk_id UNION ALL SELECT query_id, y.doc_id, 0.88 FROM q JOIN h x ON x.doc_id = query_id JOIN h y ON y.name = x.name AND y.doc_id != query_id),
      b AS (SELECT query_id, doc_id, max(score) AS score FROM u GROUP BY ALL) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
    "global_mode": f"{_MODES}, {_GLOBAL} SELECT query_id, chunk_id, n, 0.9::DOUBLE AS score FROM g",
    "global_search": f"""WITH d AS (SELECT doc_id, source, unnest({_terms("text", 6)}) AS term FROM documents), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), a AS (SELECT item_id, unnest({_terms("text", 6)}) AS term FROM benchmark),
      m AS (SELECT item_id, source, round(count(DISTINCT doc_id) / any_value(n), 9) AS score FROM d JOIN a USING (term) JOIN n USING (source) GROUP BY item_id, source), b AS (SELECT * FROM m WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) <= 6)
      SELECT item_id, count(*) AS answers, round(0.7 * avg(score) + 0.3 * least(count(*) / 10, 1), 6) AS confidence FROM b GROUP BY item_id""",
    "hybrid_mode": f"""{_MODES}, {_GLOBAL}, {NEAR_SQL.format(k=20)}, lists AS (SELECT query_id, chunk_id, 0.7 AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM v UNION ALL SELECT query_id, chunk_id, 0.95, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM low QUALIFY rank <= 20
      UNION ALL SELECT query_id, chunk_id, 1.0, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) FROM g), f AS (SELECT query_id, chunk_id, round(sum(CAST(w AS DOUBLE) / 2.65 / (60 + rank)), 9) AS fused, count(*) AS lists FROM lists GROUP BY ALL)
      SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) <= 15""",
    "extractive_answers": f"WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS p FROM documents), h AS (SELECT *, {_HITS.format('s')} AS hits FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, p) AS n FROM h) SELECT doc_id, hits, md5(s) AS digest FROM r WHERE n = 1",
    "passage_types": f"WITH t AS (SELECT id, list_filter([{_TYPES}], lambda x: x IS NOT NULL) AS t FROM {_Q}) SELECT id, CASE WHEN len(t) = 0 THEN 'explanation' ELSE array_to_string(t[1:3], '|') END AS types FROM t",
    "corrected_queries": f"WITH p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(SYNONYMS.items()))}) p(place, word, other)), w AS (SELECT id, query, unnest(list_distinct(string_split(regexp_replace(lower(query), '[?!.,]', '', 'g'), ' '))) AS word FROM {_Q}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM w JOIN p USING (word)) SELECT id, replace(lower(query), word, other) AS variant FROM r WHERE n <= 2",
    "non_ascii": "SELECT lang, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS non_ascii, count(*) AS n FROM documents GROUP BY lang",
    "benchmark_comparison": "WITH e AS (SELECT CAST(day(ts) AS BIGINT) AS day, event_type, round(avg(value), 9) AS mean, count(*) AS n FROM events GROUP BY ALL) SELECT day, arg_min(event_type, (mean, event_type)) AS fastest, arg_min(event_type, (-mean, event_type)) AS slowest, arg_min(event_type, (-n, event_type)) AS most FROM e GROUP BY day",
    "candidates_by_type": f"{with_('mentions', 'entities')}, n AS (SELECT entity, count(*) AS mentions FROM mentions GROUP BY entity), r AS (SELECT type, entity, n.mentions, row_number() OVER (PARTITION BY type ORDER BY n.mentions DESC, entity) AS rank FROM entities JOIN n USING (entity)) SELECT * FROM r WHERE rank <= 6",
    "answer_relevance": f"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> '') AS w FROM conversations), v AS (SELECT conv_id, turn, {_BAG} AS v FROM w) SELECT a.conv_id, a.turn, round(CASE WHEN list_sum(a.v) > 0 AND list_sum(b.v) > 0 THEN list_cosine_similarity(a.v, b.v) ELSE 0 END, 6) AS relevance FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
}
