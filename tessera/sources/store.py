"""The graph as tables that are merged and deleted from in place: copy-on-write Parquet behind a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.entities import importance_rank

#: Partitions of each table; a write copies only those that its keys fall in.
BUCKETS = 16
KEYS = {"chunks": ["chunk_id"], "entities": ["name"], "relationships": ["source", "target", "type"]}
SCHEMAS = {
    "chunks": "chunk_id string, document string, text string",
    "entities": "name string, type string, confidence double, description string, importance string, documents array<string>",
    "relationships": "source string, target string, type string, weight double, documents array<string>",
}


def _merged(name: str, rows: DataFrame) -> DataFrame:
    """Old and new rows (turn 0 and 1) by key. Entities: greatest confidence and importance, longest description, type of the newest that
    has one, all documents. Relationships: greatest weight, all documents. Chunks: the newest. Whatever order equal turns come in, the result is one."""
    documents = F.array_sort(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("documents")
    if name == "chunks":
        picked = F.min_by(F.struct("document", "text"), F.struct(-F.col("turn"), F.col("document"), F.col("text"))).alias("c")
        return rows.groupBy("chunk_id").agg(picked).select("chunk_id", "c.document", "c.text")
    if name == "relationships":
        return rows.groupBy(*KEYS[name]).agg(F.max("weight").alias("weight"), documents)
    rank = F.max(importance_rank())
    kind = F.min_by("type", F.struct(F.col("type").isNull(), -F.col("turn"), F.col("type")))
    longest = F.min_by("description", F.struct(-F.coalesce(F.length("description"), F.lit(-1)), F.col("description")))
    importance = F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")
    return rows.groupBy("name").agg(kind.alias("type"), F.max("confidence").alias("confidence"), longest.alias("description"), importance.alias("importance"), documents)


class GraphStore:
    """Tables chunks, entities and relationships under one folder that all executors share.

    A write puts new files of the touched partitions beside the old ones and then a new manifest, by a rename that fails if another writer
    was faster; readers take the greatest manifest, so they see all of a write or nothing of it, and a failed write leaves only files that nothing
    names (vacuum() deletes them). Rows with a null in their key are left out.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.buckets = self.manifest()["buckets"] if self._versions() else buckets

    # the manifest

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def _versions(self) -> list[int]:
        at, fs = self._path("manifests"), self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def manifest(self) -> dict:
        """version, buckets, tables (name: bucket: folder), batches (stream: the last batch written)."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": self.buckets, "tables": {t: {} for t in KEYS}, "batches": {}}
        stream = self._fs().open(self._path("manifests", str(versions[-1])))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1}
        draft = self._path("manifests", f"draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # the context's rename is atomic and refuses to replace a file, so of two writers from one version one fails
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf) if ":" in self.root else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        rename = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(draft, self._path("manifests", str(manifest["version"])), rename)

    # reading

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        folders = {b: at for b, at in manifest["tables"][name].items() if buckets is None or int(b) in buckets}
        paths = [f"{self.root}/{at}/bucket={b}" for b, at in folders.items()]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        return self._rows(self.manifest(), name)

    # writing

    def _replaced(self, manifest: dict, name: str, touched: list[int], rows: DataFrame) -> dict:
        """The manifest with these buckets of the table holding these rows."""
        at = f"{name}/{uuid.uuid4().hex}"
        # touched buckets without rows left have no folder
        rows.withColumn("bucket", self._bucket(name)).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{at}")
        fs = self._fs()
        now = {b: x for b, x in manifest["tables"][name].items() if int(b) not in touched}
        now |= {str(b): at for b in touched if fs.exists(self._path(at, f"bucket={b}"))}
        return manifest | {"tables": manifest["tables"] | {name: now}}

    def merge(self, updates: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Upsert rows of several tables in one step. A batch (stream, number) that was written before, or one older, changes nothing: then False."""
        manifest = self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        for name, rows in updates.items():
            rows = rows.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).dropna(subset=KEYS[name])
            touched = sorted(r.bucket for r in rows.select(self._bucket(name).alias("bucket")).distinct().collect())  # at most `buckets` numbers
            if touched:
                both = self._rows(manifest, name, touched).withColumn("turn", F.lit(0)).unionByName(rows.withColumn("turn", F.lit(1)))
                manifest = self._replaced(manifest, name, touched, _merged(name, both))
        if batch:
            manifest = manifest | {"batches": manifest["batches"] | {batch[0]: batch[1]}}
        self._commit(manifest)
        return True

    def delete_document(self, document: str) -> None:
        """A document's chunks go, relationships that name it go, it leaves the lists of entities, and those that no other document has go; in one step."""
        manifest = self.manifest()
        holds = {"chunks": F.col("document").eqNullSafe(F.lit(document)), "entities": F.array_contains("documents", document), "relationships": F.array_contains("documents", document)}
        for name, held in holds.items():
            touched = sorted(r.bucket for r in self._rows(manifest, name).where(held).select(self._bucket(name).alias("bucket")).distinct().collect())
            if touched:
                rows = self._rows(manifest, name, touched)
                if name == "entities":
                    rows = rows.withColumn("documents", F.array_remove("documents", document)).where(F.size("documents") > 0)
                else:
                    rows = rows.where(~F.coalesce(held, F.lit(False)))
                manifest = self._replaced(manifest, name, touched, rows)
        self._commit(manifest)

    def vacuum(self) -> None:
        """Delete files and manifests that the present manifest doesn't name. For times without readers of older ones."""
        manifest, fs = self.manifest(), self._fs()
        for name in KEYS:
            if fs.exists(self._path(name)):
                used = {at.rpartition("/")[2] for at in manifest["tables"][name].values()}
                for s in fs.listStatus(self._path(name)):
                    if s.getPath().getName() not in used:
                        fs.delete(s.getPath(), True)
        for s in fs.listStatus(self._path("manifests")):
            if s.getPath().getName() != str(manifest["version"]):
                fs.delete(s.getPath(), True)

    def sink(self, stream: str, updates):
        """A function for foreachBatch: merges updates(batch) (tables by name) under the stream's name, each batch once."""
        return lambda batch, number: self.merge(updates(batch), (stream, number)) and None
