"""Preparation of logs: columns, filters, dictionaries, bins, labels, splits, folds, batches, sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.columns import calendar_batch, draw, equal_width_bin
from caselake.operators.context import add_end_events, k_context
from caselake.plans.log import EventLog, Setting, as_category
from caselake.plans.order import with_index


def keep_attributes(log: EventLog, columns: list[str]) -> EventLog:
    """Keep these columns; case, time and order always stay."""
    s = log.spec
    wanted = [c for c in log.df.columns if c in {*columns, s.case, s.time, *s.order}]
    keep = lambda names: tuple(c for c in names if c in wanted)
    return log.with_df(log.df.select(*wanted), categorical=keep(s.categorical), numeric=keep(s.numeric))


def remove_attributes(log: EventLog, prefixes: list[str]) -> EventLog:
    """Drop columns whose names begin with one of ``prefixes``."""
    s = log.spec
    gone = [c for c in log.df.columns if c.startswith(tuple(prefixes))]
    return log.with_df(log.df.drop(*gone), categorical=tuple(c for c in s.categorical if c not in gone), numeric=tuple(c for c in s.numeric if c not in gone))


def filter_rows(log: EventLog, condition: str | Column) -> EventLog:
    return log.with_df(log.df.filter(condition))


def filter_case_length(log: EventLog, longer_than: int) -> EventLog:
    """Keep cases with strictly more events."""
    n = F.count("*").over(Window.partitionBy(log.spec.case))
    return log.with_df(log.df.withColumn("_n", n).where(F.col("_n") > longer_than).drop("_n"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``n``: the position of a row among those of its column, from 1. Positions are global first, so that a column with
    very many values is no single task; what the columns before have is one row a column."""
    placed = with_index(rows, "column", *order, name="_i")
    first = placed.groupBy("column").agg(F.min("_i").alias("_first"))
    return placed.join(F.broadcast(first), "column").withColumn("n", F.col("_i") - F.col("_first") + 1).drop("_i", "_first")


def _values(columns: list[str]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(c).alias("column"), as_category(c).alias("value")) for c in columns)))


def dictionary(df: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """(column, value, id): distinct values in ascending order get ids from 1; 0 is left for "no event".

    With ``known`` its ids stay and new values are numbered after the largest of their column. Null is the value ``nan``.
    """
    values = df.select(_values(columns).alias("v")).select("v.*").distinct()
    if known is None:
        return _numbered(values, "value").select("column", "value", F.col("n").alias("id"))
    numbered = _numbered(values.join(known, ["column", "value"], "left_anti"), "value")
    last = known.groupBy("column").agg(F.max("id").alias("last"))
    new = numbered.join(F.broadcast(last), "column", "left").select("column", "value", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("id"))
    return known.select("column", "value", "id").unionByName(new)


def first_seen_dictionary(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(column, value, id): ids from 1 in order of first appearance."""
    rows = df.select(F.struct(*order).alias("at"), _values(columns).alias("v"))
    first = rows.groupBy("v.column", "v.value").agg(F.min("at").alias("at")).select("column", "value", *(F.col("at")[c].alias(f"at_{i}") for i, c in enumerate(order)))
    return _numbered(first, *(f"at_{i}" for i in range(len(order))), "value").select("column", "value", F.col("n").alias("id"))


def encode(df: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """Replace values by their ids; a value that the dictionary lacks becomes null. Spark broadcasts a dictionary if it is small."""
    for c in columns:
        one = words.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("id").alias("_id"))
        df = df.join(one, as_category(c) == F.col("_v"), "left").drop("_v").withColumn(c, F.col("_id")).drop("_id")
    return df


def decode(df: DataFrame, column: str, words: DataFrame, output: str) -> DataFrame:
    """Add the value of an id; null for an unknown one."""
    one = words.where(F.col("column") == column).select(F.col("id").alias("_id"), F.col("value").alias(output))
    return df.join(one, F.col(column) == F.col("_id"), "left").drop("_id")


def case_labels(log: EventLog, label: str) -> DataFrame:
    """(case, label) with the label of the first event; each row's own where there are no cases."""
    if log.spec.case is None:
        return log.df.select(label)
    return log.df.groupBy(log.spec.case).agg(F.min_by(label, F.struct(*log.spec.order)).alias(label))


def bin_edges(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """One row: the ends of the range, and the bins; apply with :func:`discretize`."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high")).withColumn("bins", F.lit(bins))


def discretize(df: DataFrame, column: str, edges: DataFrame, bins: int = 25, output: str | None = None) -> DataFrame:
    """Add the right-closed bin of equal width; null outside the edges. The edges are one row, so they are broadcast."""
    return df.join(F.broadcast(edges.select("low", "high").limit(1))).withColumn(output or f"{column}_bin", equal_width_bin(column, F.col("low"), F.col("high"), bins)).drop("low", "high")


def add_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), as_category(column)))


def label_by_membership(log: EventLog, cases: DataFrame, output: str = "label") -> DataFrame:
    """Add 1 for events of cases in ``cases``, else 0."""
    marked = cases.select(log.spec.case).distinct().withColumn("_in", F.lit(1))
    return log.df.join(marked, log.spec.case, "left").withColumn(output, F.coalesce("_in", F.lit(0))).drop("_in")


def keep_cases(log: EventLog, cases: DataFrame, keep: bool = True) -> EventLog:
    return log.with_df(log.df.join(cases.select(log.spec.case), log.spec.case, "left_semi" if keep else "left_anti"))


# -- splits ---------------------------------------------------------------------------------------------------------


def split_events(log: EventLog, percentage: float, method: str = "train-test", seed: int = 42, placed: str | None = None) -> DataFrame:
    """Add ``split`` by position (in the column ``placed``, if the rows have it): ``train-test`` has the first p % as train, ``test-train`` the first 100 - p % as test.

    ``random`` takes about p % by a hash of the order columns, so runs agree.
    """
    p, order = percentage / 100, [log.spec.case, *log.spec.order]
    if method == "random":
        return log.df.withColumn("split", F.when(F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(1_000_000)) < p * 1_000_000, "train").otherwise("test"))
    rows = log.df.withColumn("idx", F.col(placed)) if placed else with_index(log.df, *log.spec.order, log.spec.case)
    n = rows.count()
    if method == "train-test":
        cut, first, rest = -int(-n * p // 1), "train", "test"
    else:
        cut, first, rest = -int(-n * (1 - p) // 1), "test", "train"
    return rows.withColumn("split", F.when(F.col("idx") < cut, first).otherwise(rest)).drop("idx")


def case_rank(log: EventLog) -> DataFrame:
    """(case, idx): position of each case by its first event."""
    s = log.spec
    first = log.df.groupBy(s.case).agg(F.min(F.struct(*s.order)).alias("at"))
    return with_index(first.select(s.case, *(F.col("at")[c].alias(f"at_{i}") for i, c in enumerate(s.order))), *(f"at_{i}" for i in range(len(s.order))), s.case).select(s.case, "idx")


def split_cases(log: EventLog, percentage: float, test_first: bool = False) -> DataFrame:
    """Add ``split``: whole cases, in order of their first event; round(n p) of them (halves to even) come first."""
    ranked = case_rank(log)
    n = ranked.count()
    first, rest = ("test", "train") if test_first else ("train", "test")
    return log.df.join(ranked, log.spec.case).withColumn("split", F.when(F.col("idx") < round(n * percentage / 100), first).otherwise(rest)).drop("idx")


def split_three(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Add ``split`` train (80 %), valid (6 %) and test (14 %), disjoint, by a hash of the keys."""
    share = draw(1000, seed, *map(F.col, keys))
    return df.withColumn("split", F.when(share < 800, "train").when(share < 860, "valid").otherwise("test"))


def folds(log: EventLog, k: int) -> DataFrame:
    """Add ``fold`` 0 .. k-1: runs of rows in order; the first n mod k folds have one more."""
    rows = with_index(log.df, *log.spec.order, log.spec.case)
    n = rows.count()
    size, more = divmod(n, k)
    edge = more * (size + 1)
    fold = F.when(F.col("idx") < edge, F.floor(F.col("idx") / (size + 1))).otherwise(more + F.floor((F.col("idx") - edge) / max(1, size)))
    return rows.withColumn("fold", fold.cast("long")).drop("idx")


def fold_split(folded: DataFrame, i: int) -> DataFrame:
    """Add ``split``: fold i is the test, the others train."""
    return folded.withColumn("split", F.when(F.col("fold") == i, "test").otherwise("train"))


def batches(log: EventLog, unit: str = "month") -> DataFrame:
    """Add ``batch_id`` (day, week or month) and ``batch``, its position from 0."""
    rows = log.df.withColumn("batch_id", calendar_batch(log.spec.time, unit))
    ids = rows.select("batch_id").distinct().withColumn("batch", (F.row_number().over(Window.orderBy("batch_id")) - 1).cast("long"))
    return rows.join(F.broadcast(ids), "batch_id")  # as many rows as calendar units


def split_week(log: EventLog, year: int, week: int, since: tuple[int, int] | None = None) -> DataFrame:
    """Add ``split``: ISO week (year, week) is the test, weeks before it (from ``since`` on) train; later rows go."""
    at = F.expr(f"extract(YEAROFWEEK FROM {log.spec.time})") * 100 + F.weekofyear(log.spec.time)
    limit = year * 100 + week
    rows = log.df.withColumn("_at", at).where(F.col("_at") <= limit)
    if since:
        rows = rows.where(F.col("_at") >= since[0] * 100 + since[1])
    return rows.withColumn("split", F.when(F.col("_at") == limit, "test").otherwise("train")).drop("_at")


def first_rows_train(df: DataFrame, order: list[str], n: int, normal: str | Column | None = None) -> DataFrame:
    """Add ``split``: the first n rows train (only normal ones, if asked), the rest test."""
    rows = with_index(df, *order).withColumn("split", F.when(F.col("idx") < n, "train").otherwise("test")).drop("idx")
    if normal is None:
        return rows
    return rows.where((F.col("split") == "test") | (F.expr(normal) if isinstance(normal, str) else normal))


def prepare_context(log: EventLog, setting: Setting, longest: int = 40) -> EventLog:
    """Filter, end events and dictionary-encoded context of an experiment, in this order."""
    if setting.longer_than is not None:
        log = filter_case_length(log, setting.longer_than)
    k = setting.k
    if k is None:
        k = min(longest, log.df.groupBy(log.spec.case).count().agg(F.max("count")).first()[0] or 0)
    if setting.add_end:
        log = add_end_events(log)
    return log.with_df(k_context(log, k, log.attributes()), k=k)


def by_position(setting: Setting) -> bool:
    return not setting.by_case and setting.split in ("train-test", "test-train")


def prepare_split(log: EventLog, setting: Setting, placed: str | None = None) -> EventLog:
    """Split (or folds) of an experiment; positions may be there already (see ``split_events``)."""
    if setting.split == "k-fold":
        return log.with_df(folds(log, setting.folds))
    return log.with_df(split_cases(log, setting.percentage, setting.split == "test-train") if setting.by_case else split_events(log, setting.percentage, setting.split, placed=placed))


def prepare(log: EventLog, setting: Setting, longest: int = 40) -> EventLog:
    """Context and then split (or folds) of an experiment."""
    return prepare_split(prepare_context(log, setting, longest), setting)


# -- sets of rows ---------------------------------------------------------------------------------------------------


def combine(logs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def conditional_probability(df: DataFrame, event: str, given: str) -> DataFrame:
    """One row: P(event | given) of two conditions on rows, null if nothing is given."""
    both, one = F.count_if(F.expr(f"({event}) AND ({given})")), F.count_if(F.expr(given))
    return df.agg(F.try_divide(both.cast("double"), one.cast("double")).alias("p"))
