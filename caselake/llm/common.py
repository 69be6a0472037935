"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python worker gets at once. Rows are never split, so a batch is at most this plus one text.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound what a Python worker holds: batches by bytes, because texts run from one word to megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster, where machines share none, it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot if it has more than this share of all rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3


def join_counted(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``values`` for their ``key``; ``values`` has each key once with its ``count`` of rows.

    Rows of hot keys meet their values by a broadcast of at most 1 / ``HOT_SHARE`` of them, so that a key which a third of all
    rows has is not one task; all others by a shuffled join. Keys must not be null. Rows whose key has no value are dropped.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = values.where(F.col(count) > HOT_SHARE * total).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    found = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").select(*rows.columns).join(values.where(F.col(count) <= HOT_SHARE * total), key)
    return found.unionByName(rest)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lowest(ids: DataFrame, limit: int, seed: int, id_column: str = "_id") -> DataFrame:
    """The ``limit`` rows of ``ids`` with the lowest seeded hash of the id, ties by id: a sample that reruns repeat.

    A share of the hashes that holds them with near certainty is kept first, so that what is sorted in one place is in
    proportion to ``limit`` and not to the rows or partitions.
    """
    n = ids.count()
    rank = F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 31)) / (1 << 31)
    share = min(1.0, (limit + 10 * limit**0.5 + 100) / max(1, n))
    return ids.withColumn("_rank", rank).where(F.col("_rank") < share).orderBy("_rank", id_column).limit(limit).drop("_rank")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


class Memo(dict):
    """A bounded memo of a pure function of a key, emptied when full. It only saves time: what is gone is computed again."""

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
