"""Drift between periods: two-sample tests over windows of scores, medians by attribute, windows that adapt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.columns import kolmogorov_p
from caselake.plans.log import EventLog
from caselake.plans.order import with_index


def ks_test(samples: DataFrame, by: list[str], value: str = "value", side: str = "side", weight: str | None = None) -> DataFrame:
    """(by, d, n, m, p): two-sample Kolmogorov-Smirnov test of rows with side 0 against side 1 in each group.

    Both samples are merged: running counts over distinct values give the two distribution functions. p is the Kolmogorov
    series. ``samples`` may be counts of rows, if ``weight`` names the count.
    """
    of = lambda s: F.sum(F.when(F.col(side) == s, F.col(weight) if weight else F.lit(1)).otherwise(0))
    c = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(of(0).alias("_a"), of(1).alias("_b"))
    run, all_ = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    c = c.withColumns({"_ca": F.sum("_a").over(run), "_cb": F.sum("_b").over(run), "_n": F.sum("_a").over(all_), "_m": F.sum("_b").over(all_)})
    out = c.where("_n > 0 AND _m > 0").groupBy(*by).agg(F.max(F.abs(F.col("_ca") / F.col("_n") - F.col("_cb") / F.col("_m"))).alias("d"), F.first("_n").alias("n"), F.first("_m").alias("m"))
    return out.withColumn("p", kolmogorov_p(F.col("d"), F.col("n"), F.col("m")))


def score_series(scores: DataFrame, log: EventLog, zero: float | None = -5.0) -> DataFrame:
    """(case, idx, value): score over number of events, in order of the cases' first events; 0 becomes ``zero`` (None: goes)."""
    s = log.spec
    first = log.df.groupBy(s.case).agg(F.min(s.time).alias("began"))
    rows = scores.select(s.case, (F.col("score") / F.col("events")).alias("value")).join(first, s.case)
    rows = rows.where("value <> 0") if zero is None else rows.withColumn("value", F.when(F.col("value") == 0, zero).otherwise(F.col("value")))
    return with_index(rows, "began", s.case).select(s.case, "idx", "value")


def _slide(idx: np.ndarray, value: np.ndarray, first: int, until: int, window: int, stride: int) -> pd.DataFrame:
    """(start, d, n, m) of the starts first, first + stride, .. below ``until``.

    Values are ranked once. A window's distribution is a count for each rank; from one start to the next, only cases that leave
    or enter a window change counts.
    """
    there = np.isfinite(value)
    distinct, rank = np.unique(value[there], return_inverse=True)
    order = np.argsort(idx[there], kind="stable")
    idx, rank = idx[there][order], rank[order]
    starts = np.arange(first, until, stride)
    edges = np.searchsorted(idx, np.stack([starts, starts + window, starts + 2 * window]))
    left, right = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    at, rows = [0, 0, 0], []
    for start, (a, b, c) in zip(starts.tolist(), edges.T.tolist(), strict=True):
        np.add.at(left, rank[at[1] : b], 1)
        np.subtract.at(left, rank[at[0] : a], 1)
        np.add.at(right, rank[at[2] : c], 1)
        np.subtract.at(right, rank[at[1] : b], 1)
        at = [a, b, c]
        if b > a and c > b:
            rows.append((start, float(np.abs(np.cumsum(left) / (b - a) - np.cumsum(right) / (c - b)).max()), b - a, c - b))
    return pd.DataFrame(rows, columns=["start", "d", "n", "m"])


def sliding_drift(series: DataFrame, window: int, stride: int = 1) -> DataFrame:
    """(start, d, p, log_p) comparing cases start .. start + w - 1 with the next w, for starts 0, stride, .. below n - 2 w.

    Starts are dealt in runs of 2 w; a run's cases and those of its last window go to one task, so each case is copied twice,
    whatever w and stride are. log_p is -350 where p is 0. The number of cases is read first, as one number.
    """
    last = (series.agg(F.max("idx")).first()[0] or 0) + 1 - 2 * window - 1
    size = 2 * window

    def slide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = -(-key[0] * size // stride) * stride
        return _slide(pdf["idx"].to_numpy(), pdf["value"].to_numpy(float), first, min((key[0] + 1) * size, last + 1), window, stride)

    low = F.greatest(F.ceil((F.col("idx") - 2 * window - size + 1) / size), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col("idx") / size), F.lit(max(last, 0) // size)).cast("long")
    rows = series.select("idx", F.col("value").cast("double").alias("value")).where((low <= high) & (F.lit(last) >= 0))
    tests = rows.withColumn("run", F.explode(F.sequence(low, high))).groupBy("run").applyInPandas(slide, "start long, d double, n long, m long")
    tests = tests.withColumn("p", kolmogorov_p(F.col("d"), F.col("n"), F.col("m")))
    return tests.select("start", "d", "p", F.when(F.col("p") > 0, F.log10("p")).otherwise(-350.0).alias("log_p"))


def median_and_mad(scores: DataFrame, attribute: str = "attribute", value: str = "score") -> DataFrame:
    """(attribute, median, mad): the median, and the median distance from it over 0.6745."""
    med = scores.groupBy(attribute).agg(F.median(value).alias("median"))
    far = scores.join(med, attribute).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return far.groupBy(attribute).agg(F.first("median").alias("median"), (F.median("_d") / 0.6745).alias("mad"))


def attribute_drift(scores: DataFrame, period: str, attribute: str = "attribute", value: str = "score") -> DataFrame:
    """(attribute, period_a, period_b, d, p) for each pair of periods; distinct values, counted first, are copied for each pair."""
    periods = scores.select(period).distinct()
    a, b = periods.select(F.col(period).alias("period_a")), periods.select(F.col(period).alias("period_b"))
    pairs = a.join(b, F.col("period_a") < F.col("period_b"))
    both = pairs.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_p", F.when(F.col("side") == 0, F.col("period_a")).otherwise(F.col("period_b")))
    counts = scores.groupBy(F.col(period).alias("_p"), attribute, F.col(value).alias("value")).agg(F.count("*").alias("_rows"))
    return ks_test(counts.join(both, "_p"), [attribute, "period_a", "period_b"], weight="_rows").select(attribute, "period_a", "period_b", "d", "p")


def score_bands(scores: DataFrame, edges: list[float], value: str = "score") -> DataFrame:
    """(band, cases): cases by score; band i holds scores above edge i + 1 and up to edge i, for descending edges."""
    band = F.lit(len(edges))
    for i in range(len(edges) - 1, 0, -1):
        band = F.when((F.col(value) <= edges[i - 1]) & (F.col(value) > edges[i]), i - 1).otherwise(band)
    band = F.when(F.col(value) > edges[0], -1).otherwise(band)
    return scores.groupBy(band.cast("long").alias("band")).agg(F.count("*").alias("cases"))


def adaptive_window(series: DataFrame, batch: str, value: str = "value") -> DataFrame:
    """(batch, past, p, keep): past batches that look like a batch: ln(p + 0.0001) is at least its mean over the past."""
    ids = series.select(F.col(batch).alias("batch")).distinct()
    pairs = ids.join(ids.select(F.col("batch").alias("past")), F.col("past") < F.col("batch"))
    both = pairs.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", F.when(F.col("side") == 0, F.col("batch")).otherwise(F.col("past")))
    counts = series.groupBy(F.col(batch).alias("_b"), F.col(value).alias("value")).agg(F.count("*").alias("_rows"))
    tests = ks_test(counts.join(both, "_b"), ["batch", "past"], weight="_rows")
    lp = F.ln(F.col("p") + 0.0001)
    return tests.select("batch", "past", "p", (lp >= F.avg(lp).over(Window.partitionBy("batch"))).alias("keep"))
