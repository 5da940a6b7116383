"""Queries over what is written or mended: the stored graph, and JSON cut off anywhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.json_repair import repair
from tessera.sources.shared import dealt, shared_dir
from tessera.sources.store import GraphStore
from tessera.sources.tables import table


def _batch(spark, sf, n):
    """Parts of an even or odd number are batch 0 or 1, with their lines' suppliers as relationships; turns are its chunks, those of batch 0 once more in batch 1 if their number is divisible by 3."""
    p = table(spark, sf, "part").where(F.col("p_partkey") % 2 == n)
    document = F.lit(f"d{n}")
    entities = p.select(
        F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.round(F.col("p_retailprice") / 2100, 6).alias("confidence"), F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 20, "medium").otherwise("low").alias("importance"),
        F.when(F.col("p_partkey") % 3 == 0, F.array(document)).otherwise(F.array(document, F.concat(F.lit("b"), (F.col("p_partkey") % 5).cast("string")))).alias("documents"),
    )
    li = table(spark, sf, "lineitem").where(F.col("l_partkey") % 2 == n)
    relationships = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), F.array(F.concat(F.lit("d"), (F.col("l_orderkey") % 4).cast("string"))).alias("documents"))
    c = table(spark, sf, "conversations").where((F.col("turn") % 2 == n) | (F.lit(n == 1) & (F.col("turn") % 3 == 0)))
    chunks = c.select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("document"), F.concat(F.lit(f"{n} "), "text").alias("text"))
    return {"entities": entities, "relationships": relationships, "chunks": chunks}


def graph_store(spark: SparkSession, sf: str) -> DataFrame:
    """The stored graph after two batches, the second written again (which changes nothing), and the deletion of document d1."""
    store = GraphStore(spark, f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}")
    for n in (0, 1, 1):
        store.merge(_batch(spark, sf, n), ("parts", n))
    store.delete_document("d1")
    documents = F.array_join("documents", ",").alias("documents")
    e = store.read("entities").select(F.lit("entity").alias("kind"), F.col("name").alias("key"), F.concat_ws("|", "type", "description", "importance").alias("detail"), F.col("confidence").alias("value"), documents)
    r = store.read("relationships").select(F.lit("relationship"), F.concat_ws("|", "source", "target", "type"), F.lit(""), "weight", documents)
    c = store.read("chunks").select(F.lit("chunk"), "chunk_id", F.md5(F.col("text").cast("binary")), F.lit(0.0), "document")
    return e.union(r).union(c)


def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The properties of every event cut off at every length and mended: what is left of them."""
    events = table(spark, sf, "events").select("event_id", "props")
    n = events.agg(F.sum(F.length("props") + 1)).first()[0] or 0
    e = dealt(events, n, "event_id").select("event_id", "props", F.explode(F.sequence(F.lit(0), F.length("props"))).alias("cut"))
    rows = e.select("event_id", F.col("cut").cast("long").alias("cut"), repair(F.substring("props", 1, F.col("cut"))).alias("json"))
    parsed = F.from_json("json", "k long", {"mode": "FAILFAST"})
    return rows.select("event_id", "cut", F.col("json").isNotNull().alias("mended"), parsed.k.alias("k"))


QUERIES = {f.__name__: f for f in (graph_store, json_repair)}

_RANK = "CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 ELSE 1 END"
ORACLE_SQL = {
    "graph_store": f"""WITH p AS (SELECT p_name AS name, p_type AS type, round(p_retailprice / 2100, 6) AS confidence, concat_ws(' ', p_brand, p_type) AS description, {_RANK} AS rank, p_partkey % 2 AS turn, CASE WHEN p_partkey % 3 = 0 THEN ['d' || (p_partkey % 2)] ELSE ['d' || (p_partkey % 2), 'b' || (p_partkey % 5)] END AS documents FROM part),
      g AS (SELECT name, max(confidence) AS confidence, CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS importance, list_sort(list_distinct(flatten(list(documents)))) AS documents FROM p GROUP BY name),
      t AS (SELECT name, type FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY turn DESC, type) = 1), d AS (SELECT name, description FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(description) DESC, description) = 1),
      e AS (SELECT 'entity' AS kind, name AS key, concat_ws('|', type, description, importance) AS detail, confidence AS value, list_filter(documents, lambda x: x != 'd1') AS documents FROM g JOIN t USING (name) JOIN d USING (name)),
      r AS (SELECT concat_ws('|', 's' || l_suppkey, 'p' || l_partkey, l_returnflag) AS key, max(l_quantity) AS value, list_sort(list_distinct(list('d' || (l_orderkey % 4)))) AS documents FROM lineitem GROUP BY ALL)
      SELECT kind, key, detail, value, array_to_string(documents, ',') AS documents FROM e WHERE len(documents) > 0 UNION ALL SELECT 'relationship', key, '', value, array_to_string(documents, ',') FROM r WHERE NOT list_contains(documents, 'd1')
      UNION ALL SELECT 'chunk', conv_id || ':' || turn, md5(CASE WHEN turn % 2 = 1 OR turn % 3 = 0 THEN '1 ' ELSE '0 ' END || text), 0, 'd' || (conv_id % 3) FROM conversations WHERE conv_id % 3 != 1""",
    "json_repair": "WITH c AS (SELECT event_id, props, unnest(range(length(props) + 1)) AS cut FROM events) SELECT event_id, cut, cut > 0 AS mended, try_cast(regexp_extract(substr(props, 1, cut), '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM c",
}
