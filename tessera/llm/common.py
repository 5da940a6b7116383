"""What the operators share: tables, the shared folder, tables written to cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own (tests); on a cluster that
    is an error, as executors could not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None, files: int = 1) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor costs no recomputation.

    With `by` it is a table bucketed by that column in so many files, and joins by the column leave it where it is.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    write = df.write.option("compression", "zstd")
    if by:
        called = path.rsplit("/", 1)[1].replace("-", "_")
        write.bucketBy(files, by).option("path", path).saveAsTable(called)
        out = spark.table(called)
    else:
        write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "stored_path", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator on texts reads; a null text is the empty one, other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bits of the marks that tell which rows are asked for, 2 to this power, whatever the number of rows.
MARK_BITS = 27


def place(*columns):
    """Where a row is marked by these columns, nulls being equal; a few others may be marked with it. Equal values of other types have other places."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << MARK_BITS)).alias("place")


def marks(places: DataFrame):
    """A broadcast of a bit for each place, set at those given (column place); made chunk by chunk on the executors, the driver gets the fixed size of all bits."""
    low = MARK_BITS - 6  # 64 chunks

    def mark(batches):
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("place").to_numpy()
            for c in np.unique(at >> low).tolist():
                bits = chunks.setdefault(c, np.zeros(1 << low, dtype=bool))
                bits[at[at >> low == c] & (1 << low) - 1] = True
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(chunks, type=pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in chunks.values()], type=pa.binary())], names=["chunk", "data"])

    parts = places.select("place", F.shiftright("place", low).alias("chunk")).repartition(16, "chunk").mapInArrow(tidy(mark), "chunk int, data binary").collect()
    out = np.zeros((64, (1 << low) // 8), dtype=np.uint8)
    for r in parts:
        out[r.chunk] = np.frombuffer(r.data, dtype=np.uint8)
    return places.sparkSession.sparkContext.broadcast(out.reshape(-1))


def is_marked(marked, at: np.ndarray) -> np.ndarray:
    return (marked.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_pieces(data: bytes, size: int = 1 << 22):
    """data in pieces of about `size` bytes, cut at ASCII white space; a longer run without any stays whole."""
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def tidy(run):
    """The function of mapInArrow, giving memory back to the machine when its task ends: workers live on beside other stages' JVM."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what numpy freed until it is told
                trim(0)

    return tidied
