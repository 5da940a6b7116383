"""The folder that all executors share, where iterative plans cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets one of its own; elsewhere it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of one task behind a shuffle of known size.
TASK_ROWS = 400_000


def dealt(df: DataFrame, rows: int, *columns: str, always: bool = False) -> DataFrame:
    """df of about `rows` rows, brought together by the columns in as many tasks as they ask for; what one task may hold is left to the session.

    What groups or joins by these columns behind it moves nothing again, and a task's share doesn't grow with the table. The number is given
    even where the session has as many partitions, as Spark puts such small ones together by their bytes, to tasks of millions of narrow rows.
    """
    if rows > TASK_ROWS:
        spark = df.sparkSession
        least = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
        return df.repartition(max(least, -(-rows // TASK_ROWS)), *columns)
    return df.repartition(*columns) if always else df


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends, and a lost executor costs no recomputation.

    A table rather than a checkpoint, as checkpoints hand on what the planner knew of the rows, which grows from round to round until
    planning takes longer than the work; and the size of a table is known, so small ones are sent instead of shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
