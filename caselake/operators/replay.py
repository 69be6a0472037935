"""Test-then-train over batches of time, for models that are counts.

Counts add up, so the model before every batch is a sum of counts over earlier batches: one aggregation and one join, with no
loop over batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.model import key_of
from caselake.plans.log import as_category
from caselake.plans.order import written


def batch_counts(df: DataFrame, value: str, parents: list[str], batch: str = "batch") -> DataFrame:
    """(batch, parents, value, n)."""
    return df.groupBy(F.col(batch).alias("batch"), key_of(parents).alias("parents"), as_category(value).alias("value")).agg(F.count("*").alias("n"))


def models_before(counts: DataFrame, batches: DataFrame, window: int = 0, segment: Column | None = None) -> DataFrame:
    """(batch, parents, value, n): counts of the training batches of each batch.

    Window 0: all earlier batches; w: the last w. Batches are calendar units, so there are few of them, and the range join
    has the size of the models it makes.
    """
    past = F.col("past") < F.col("batch")
    if window:
        past &= F.col("past") >= F.col("batch") - window
    if segment is not None:
        past = segment
    rows = counts.withColumnRenamed("batch", "past").join(F.broadcast(batches.select("batch").distinct()), past)
    return rows.groupBy("batch", "parents", "value").agg(F.sum("n").alias("n"))


def drift_segments(drifts: list[int], reset: bool) -> Column:
    """Training batches at drifts. ``reset``: those since the last drift (the drift's own batch is the first); else only the
    batch before, until a drift, whose batch starts anew."""
    begin = F.lit(0)
    for d in sorted(drifts):
        begin = F.when(F.col("batch") > d, d).otherwise(begin)
    return (F.col("past") < F.col("batch")) & (F.col("past") >= begin) if reset else (F.col("past") == F.col("batch") - 1) & (F.col("past") >= begin)


def test_then_train(df: DataFrame, value: str, parents: list[str], keys: list[str], window: int = 0, drifts: list[int] | None = None, reset: bool = True, batch: str = "batch") -> DataFrame:
    """(keys, batch, expected, predicted, p_predicted, p_expected): each batch predicted by the model of its training batches.

    Contexts the model hasn't seen fall back to its marginal; without any training batch nothing is predicted ("0").
    """
    counts = batch_counts(df, value, parents, batch)
    segment = drift_segments(drifts, reset) if drifts is not None else None
    model = models_before(counts, df.select(F.col(batch).alias("batch")), window, segment)
    given = model.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("batch", "parents")))
    flat = model.groupBy("batch", "value").agg(F.sum("n").alias("n"))
    flat = flat.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("batch")))
    best = lambda rows, by: rows.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("q"), "value", "p")).alias("b")).select(*by, F.col("b.value").alias("v"), F.col("b.p").alias("pv"))
    rows = df.select(*keys, F.col(batch).alias("batch"), key_of(parents).alias("parents"), as_category(value).alias("expected"))
    rows = rows.join(best(given, ["batch", "parents"]).withColumnsRenamed({"v": "v1", "pv": "p1"}), ["batch", "parents"], "left")
    rows = rows.join(best(flat, ["batch"]).withColumnsRenamed({"v": "v0", "pv": "p0"}), "batch", "left")
    rows = rows.join(given.select("batch", "parents", F.col("value").alias("expected"), F.col("p").alias("e1")), ["batch", "parents", "expected"], "left")
    rows = rows.join(flat.select("batch", F.col("value").alias("expected"), F.col("p").alias("e0")), ["batch", "expected"], "left")
    seen = F.col("v1").isNotNull()
    return rows.select(
        *keys, "batch", "expected", F.coalesce("v1", "v0", F.lit("0")).alias("predicted"), F.coalesce("p1", "p0", F.lit(0.0)).alias("p_predicted"),
        F.coalesce(F.when(seen, F.col("e1")).otherwise(F.col("e0")), F.lit(0.0)).alias("p_expected"),
    )


def replay(batches: list[DataFrame], start, test: Callable, update: Callable) -> tuple[DataFrame | None, list[float]]:
    """For models that aren't counts: test each batch, then update, in a driver loop; returns results and seconds a batch."""
    model, out, seconds = start, None, []
    for b in batches:
        began = time.time()
        result = written(test(model, b))
        out = result if out is None else out.unionByName(result)
        model = update(model, b)
        seconds.append(time.time() - began)
    return out, seconds
