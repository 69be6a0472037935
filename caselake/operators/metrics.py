"""Quality of predictions and of rankings, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.plans.order import with_index, with_running


def hit() -> Column:
    """1 if the prediction is right; two nulls agree."""
    return F.col("expected").eqNullSafe(F.col("predicted")).cast("int")


def accuracy(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of rows (expected, predicted) that agree."""
    return results.groupBy(*(by or [])).agg(F.avg(hit()).alias("accuracy"))


def cumulative_accuracy(results: DataFrame, order: list[str]) -> DataFrame:
    """(order, position, accuracy) over all rows so far."""
    run = with_running(results, order, {"hits": hit()})
    return run.select(*order, (F.col("idx") + 1).alias("position"), (F.col("hits") / (F.col("idx") + 1)).alias("accuracy"))


def period_accuracy(results: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """(period, rows, accuracy) for each block of n rows in order."""
    run = with_running(results, order, {})
    return run.groupBy(F.floor(F.col("idx") / n).cast("long").alias("period")).agg(F.count("*").alias("rows"), F.avg(hit()).alias("accuracy"))


def rolling_accuracy(results: DataFrame, order: list[str], w: int) -> DataFrame:
    """(position, accuracy) over the w rows before each row; the first w rows are left out.

    The mean is a difference of two running sums, w rows apart, joined on the position: no window holds all rows.
    """
    run = with_running(results, order, {"hits": hit()}).select("idx", "hits")
    before = run.select((F.col("idx") + 1).alias("position"), F.col("hits").alias("upto"))
    far = run.select((F.col("idx") + 1 + w).alias("position"), F.col("hits").alias("from"))
    last = run.agg(F.max("idx").alias("last"))
    return before.join(far, "position", "left").join(F.broadcast(last)).where((F.col("position") >= w) & (F.col("position") <= F.col("last"))).select("position", ((F.col("upto") - F.coalesce("from", F.lit(0))) / w).alias("accuracy"))


def moving_mean(series: DataFrame, order: list[str], value: str, w: int = 100, by: list[str] | None = None, block: int = 1_000_000) -> DataFrame:
    """Add ``mean`` over the last w values (fewer at the start) of each series.

    Without ``by`` all rows are one series, whose order should be total. It is cut into blocks of rows, and the last w - 1 rows
    of a block go to the next one too, so no task has the whole series.
    """
    if by:
        return series.withColumn("mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - w, 0)))
    block = max(block, w)
    own = F.floor(F.col("_idx") / block)
    blocks = F.when(F.col("_idx") % block > block - w, F.array(own, own + 1)).otherwise(F.array(own))
    rows = with_index(series, *order, name="_idx").withColumn("_block", F.explode(blocks))
    rows = rows.withColumn("mean", F.avg(value).over(Window.partitionBy("_block").orderBy("_idx").rowsBetween(1 - w, 0)))
    return rows.where(own == F.col("_block")).drop("_idx", "_block")


def brier(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of 1 - probability of the true value."""
    return results.groupBy(*(by or [])).agg(F.avg(1 - F.col("p_expected")).alias("brier"))


def brier_multi(distribution: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, brier) from rows (keys, value, p, expected): sum of squared errors over the values of a prediction."""
    return distribution.groupBy(*keys).agg(F.sum(F.pow(F.col("p") - (F.col("value") == F.col("expected")).cast("int"), F.lit(2))).alias("brier"))


def class_report(results: DataFrame) -> DataFrame:
    """(class, support, predicted, correct, precision, recall, f1) for each class that occurs or is predicted."""
    a = results.groupBy(F.col("expected").alias("class")).agg(F.count("*").alias("support"), F.sum(hit()).alias("correct"))
    b = results.groupBy(F.col("predicted").alias("class")).agg(F.count("*").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = a.join(b, "class", "full").select("class", zero("support"), zero("predicted"), zero("correct"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    rows = rows.withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn("recall", ratio(F.col("correct"), F.col("support")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def weighted_precision(results: DataFrame) -> DataFrame:
    """Precision of the classes, weighed by their support."""
    return class_report(results).agg((F.sum(F.col("support") * F.col("precision")) / F.sum("support")).alias("precision"))


def weighted_recall(results: DataFrame) -> DataFrame:
    """Recall of the classes, weighed by their support; by algebra the accuracy."""
    return class_report(results).agg((F.sum(F.col("support") * F.col("recall")) / F.sum("support")).alias("recall"))


def confusion(results: DataFrame, mistakes_only: bool = False) -> DataFrame:
    rows = results.where(hit() == 0) if mistakes_only else results
    return rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def top_accuracy(distribution: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """One row: share of predictions whose true value is among the n likeliest (ties: smaller value)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p"), "value")
    found = distribution.withColumn("rank", F.row_number().over(w)).groupBy(*keys).agg(F.max(((F.col("rank") <= n) & (F.col("value") == F.col("expected"))).cast("int")).alias("hit"))
    return found.agg(F.avg("hit").alias("accuracy"))


def _points(scores: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Running true and false positives by ascending score (most anomalous first), one point a row, in each group of ``by``.

    Sums run over the global order by group and score; what the groups before have is taken off again, so that no group is a
    single task.
    """
    y = F.col("label").cast("long")
    run = with_running(scores, [*by, "score", tie], {"tp": y, "fp": 1 - y})
    groups = run.groupBy(*by).agg(F.sum(y).alias("positives"), F.sum(1 - y).alias("negatives"), F.min(F.col("tp") - y).alias("_tp"), F.min(F.col("fp") - 1 + y).alias("_fp"), F.min("idx").alias("_i"))
    points = run.join(groups, by) if by else run.join(F.broadcast(groups))
    return points.withColumns({"tp": F.col("tp") - F.col("_tp"), "fp": F.col("fp") - F.col("_fp"), "rank": F.col("idx") - F.col("_i") + 1}).drop("_tp", "_fp", "_i")


def roc(scores: DataFrame, by: list[str] | None = None, tie: str = "case_id") -> DataFrame:
    """(by, rank, fpr, tpr) from (score, label, tie); a low score says anomaly."""
    p = _points(scores, by or [], tie)
    return p.select(*(by or []), "rank", F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double")).alias("fpr"), F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")).alias("tpr"))


def roc_auc(scores: DataFrame, by: list[str] | None = None, tie: str = "case_id") -> DataFrame:
    """Area under the curve: with one point a row, each negative adds the share of positives ranked before it; null without
    positives."""
    p = _points(scores, by or [], tie).where(F.col("label").cast("long") == 0)
    return p.groupBy(*(by or [])).agg((F.sum(F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double"))) / F.first("negatives")).alias("auc"))


def precision_recall(scores: DataFrame, by: list[str] | None = None, tie: str = "case_id") -> DataFrame:
    """(by, rank, precision, recall)."""
    p = _points(scores, by or [], tie)
    return p.select(*(by or []), "rank", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")).alias("recall"))


def average_precision(scores: DataFrame, by: list[str] | None = None, tie: str = "case_id") -> DataFrame:
    """Area under precision and recall as steps: the mean precision at each positive."""
    p = _points(scores, by or [], tie).where(F.col("label").cast("long") == 1)
    return p.groupBy(*(by or [])).agg((F.sum(F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("positives")).alias("area"))


def flagged_report(scores: DataFrame, flagged: Column) -> DataFrame:
    """One row: precision, recall and F1 of rows for which ``flagged`` holds, against label 1."""
    y = F.col("label") == 1
    one = scores.agg(F.count_if(flagged & y).cast("double").alias("tp"), F.count_if(flagged).cast("double").alias("f"), F.count_if(y).cast("double").alias("p"))
    return one.select(F.try_divide("tp", "f").alias("precision"), F.try_divide("tp", "p").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("f") + F.col("p")).alias("f1"))


def run_summary(runs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median and population variance over repeated runs."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.var_pop(value).alias("variance"))


def rank_methods(results: DataFrame, setting: list[str], value: str = "accuracy") -> DataFrame:
    """Add ``rank`` inside each setting, best first, equal ones by method."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*setting).orderBy(F.desc(value), "method")))


def result_table(results: DataFrame, rows: list[str], column: str, columns: list, value: str) -> DataFrame:
    """Means as a table: one row for each value of ``rows``, one column for each of ``columns``."""
    return results.groupBy(*rows).pivot(column, columns).agg(F.avg(value))


def timing(results: DataFrame, by: list[str], value: str) -> DataFrame:
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("batches"))


def missing_experiments(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.select(*keys).join(done.select(*keys).distinct(), keys, "left_anti")


def report_by_axis(flags: DataFrame, axes: dict[str, list[str]], attribute: str = "attribute") -> DataFrame:
    """(axis, attribute, label, precision, recall, f1) of 0/1 ``truth`` and ``predicted`` for normal (0) and anomalous (1).

    An axis is a list of columns: flags are collapsed to one for each of their values, set if any of them is. ``attribute`` is
    ``any`` on axes without that column. A label that nothing has or predicts scores 0.
    """
    out = None
    for axis, by in axes.items():
        one = flags.groupBy(*by).agg(F.max("truth").alias("t"), F.max("predicted").alias("p"))
        name = F.col(attribute) if attribute in by else F.lit("any")
        each = one.select(name.alias("attribute"), "t", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
        hit, said, is_ = F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))), F.count_if(F.col("p") == F.col("label")), F.count_if(F.col("t") == F.col("label"))
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        part = each.groupBy("attribute", "label").agg(share(hit, said).alias("precision"), share(hit, is_).alias("recall"), share(2 * hit, said + is_).alias("f1")).select(F.lit(axis).alias("axis"), "attribute", "label", "precision", "recall", "f1")
        out = part if out is None else out.unionByName(part)
    return out
