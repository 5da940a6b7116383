"""The driver's tables, and the tables of the retrieval engine that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import dealt

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (array<double>), label: the vector index."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, list, chunk_id, document_id, score: ranked lists to fuse. A user is a query, an event type one retriever's list."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("list"), (F.col("event_id") % 40).alias("chunk_id"), (F.col("event_id") % 8).alias("document_id"), (F.col("value") / 500).alias("score"))
    return rows.groupBy("query_id", "list", "chunk_id", "document_id").agg(F.round(F.max("score"), 6).alias("score"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, entity, confidence: parts mentioned in orders."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity"), "l_discount")
    return dealt(rows, li.count(), "chunk_id").groupBy("chunk_id", "entity").agg(F.round(F.max(1 - F.col("l_discount")), 6).alias("confidence"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, name, type, confidence, importance: parts as entities."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.round(F.col("p_retailprice") / 2100, 6).alias("confidence"), F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 20, "medium").otherwise("low").alias("importance"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, weight: undirected simple graph of suppliers and parts that share a line; suppliers have negative ids."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((-F.col("l_suppkey") - 1).alias("a"), F.col("l_partkey").alias("b"))
    return dealt(rows, li.count(), "b", "a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id: an order is a chunk, its customer the document."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: what pages call the pages they link to, of four letters or more, and the first three words of each sentence of the benchmark."""
    label = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(LABEL), F.lit(1))).alias("name")).where("length(name) >= 4")
    opening = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(OPENING), F.lit(1))).alias("name"))
    return label.unionByName(opening).distinct()


def texts_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, text_id, text: all documents, turns of conversations (1,000 places each) and benchmark items."""
    d, c, b = (table(spark, sf_dir, t) for t in ("documents", "conversations", "benchmark"))
    rows = (d.select(F.lit("document").alias("kind"), F.col("doc_id").alias("text_id"), "text"), c.select(F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), "text"), b.select(F.lit("item"), "item_id", "text"))
    return rows[0].union(rows[1]).union(rows[2])


LABEL = r'<a href="[^"]*">([^<]+)</a>'
OPENING = r"(?:^|[.] )([A-Za-z]+ [a-z]+ [a-z]+)"
#: The same derivations in SQL, as common table expressions by name.
SQL = {
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings",
    "ranked_lists": "SELECT user_id AS query_id, event_type AS list, event_id % 40 AS chunk_id, event_id % 8 AS document_id, round(max(value / 500), 6) AS score FROM events GROUP BY ALL",
    "mentions": "SELECT l_orderkey AS chunk_id, l_partkey AS entity, round(max(1 - l_discount), 6) AS confidence FROM lineitem GROUP BY ALL",
    "entities": "SELECT p_partkey AS entity, p_name AS name, p_type AS type, round(p_retailprice / 2100, 6) AS confidence, CASE WHEN p_size > 40 THEN 'high' WHEN p_size > 20 THEN 'medium' ELSE 'low' END AS importance FROM part",
    "edges": "SELECT -l_suppkey - 1 AS a, l_partkey AS b, count(*) AS weight FROM lineitem GROUP BY ALL",
    "gazetteer": f"SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(html, '{LABEL}', 1)) AS name FROM pages) WHERE length(name) >= 4 UNION SELECT unnest(regexp_extract_all(text, '{OPENING}', 1)) FROM benchmark",
    "texts_asked": "SELECT 'document' AS kind, doc_id AS text_id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'item', item_id, text FROM benchmark",
    "chunk_documents": "SELECT o_orderkey AS chunk_id, o_custkey AS document_id FROM orders",
}


def with_(*names: str) -> str:
    """A WITH clause of the named derivations."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
