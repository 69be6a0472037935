"""Global order without a single task: range partitions, and offsets of one row for each of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> None:
    """Set the folder that the session names; a local session that names none gets a temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share."""
    _shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    As ``checkpointed``, but without the statistics and constraints of the plan before, which grow where tables are joined to
    what came from them round after round.
    """
    at = folder(df.sparkSession, "rounds")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def with_running(df: DataFrame, order: list[str | Column], sums: dict[str, Column | str], index: str | None = "idx") -> DataFrame:
    """Add running sums (and the position from 0 as ``index``) in the ascending order given, which should be total.

    Rows are range-partitioned by the order and summed inside each range by a window; what the ranges before add up to is
    one row for each range, gathered on the driver and put back as a literal.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"_k{i}" for i in range(len(order))]
    df = df.withColumns({k: c for k, c in zip(keys, order, strict=True)} | {f"_s_{n}": F.expr(c) if isinstance(c, str) else c for n, c in sums.items()})
    ranged = checkpointed(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("n"), *(F.sum(f"_s_{n}").alias(n) for n in sums)).orderBy("_part").collect()
    before: dict[str, dict[int, float]] = {n: {} for n in ("n", *sums)}
    for name, of in before.items():
        total = 0
        for r in totals:
            of[r["_part"]] = total
            total += r[name] or 0
    w = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda of: F.coalesce(F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("_part")], F.lit(0)) if of else F.lit(0)
    out = {n: F.sum(f"_s_{n}").over(w) + at(before[n]) for n in sums}
    if index:
        out[index] = (F.count("*").over(w) - 1 + at(before["n"])).cast("long")
    return ranged.withColumns(out).drop("_part", *keys, *(f"_s_{n}" for n in sums))


def with_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """Add the position of each row, from 0, in the order given (a total one)."""
    return with_running(df, list(order), {}, name)
