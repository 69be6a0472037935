"""Features of prefixes for classifiers: sequences, counts, gaps, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.columns import DAY, seconds_between
from caselake.plans.log import EventLog, as_category

HALF_DAY = 43200.0


def _elapsed(log: EventLog) -> tuple[Column, Column]:
    w, t = log.window(), log.spec.time
    gap = F.coalesce(seconds_between(t, F.lag(t).over(w)), F.lit(0.0))
    return gap, seconds_between(t, F.first(t).over(w))


def sequence_features(log: EventLog, activities: list[str], k: int = 3) -> DataFrame:
    """(case, position, x): for each event a k x (activities + 5) array, oldest first, zeros where there is no event.

    A row has the one-hot activity, its position in the window from 1, seconds since the event before, since the case began,
    since midnight, and weekday / 7.
    """
    s, w = log.spec, log.window()
    gap, since = _elapsed(log)
    a = as_category(s.activity)
    midnight = F.hour(s.time) * 3600 + F.minute(s.time) * 60 + F.second(s.time)
    one = F.array(*(F.when(a == v, 1.0).otherwise(0.0) for v in activities), gap, since, midnight.cast("double"), F.weekday(s.time) / 7.0)
    rows = log.df.select(s.case, *s.order, F.row_number().over(w).cast("long").alias("position"), one.alias("one"))
    held = rows.withColumn("held", F.collect_list("one").over(w.rowsBetween(1 - k, 0)))
    n = len(activities)
    placed = F.transform("held", lambda r, i: F.concat(F.slice(r, 1, n), F.array((i + 1).cast("double")), F.slice(r, n + 1, 4)))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0), n + 5), k - F.size("held"))
    return held.select(s.case, "position", F.concat(pad, placed).alias("x"))


def log_gaps(log: EventLog, k: int = 3) -> DataFrame:
    """(case, position, gaps): ln(1 + seconds) between the last k events, newest first, 0 where there is none."""
    w = log.window()
    gap, _ = _elapsed(log)
    rows = log.df.select(log.spec.case, *log.spec.order, F.row_number().over(w).cast("long").alias("position"), F.log1p(F.greatest(gap, F.lit(0.0))).alias("g"))
    return rows.select(log.spec.case, "position", F.array(*(F.coalesce(F.lag("g", i).over(w), F.lit(0.0)) for i in range(k))).alias("gaps"))


def padded_ngrams(log: EventLog, n: int = 3, columns: list[str] | None = None, missing: str = "0") -> DataFrame:
    """(case, position, gram_<c>, next_<c>): the n values before an event, oldest first, padded on the left, and its own."""
    s, w = log.spec, log.window()
    columns = columns or [c for c in (s.activity, s.resource) if c]
    grams = [F.array(*(F.lag(as_category(c), i, missing).over(w) for i in range(n, 0, -1))).alias(f"gram_{c}") for c in columns]
    return log.df.select(s.case, F.row_number().over(w).cast("long").alias("position"), *grams, *(as_category(c).alias(f"next_{c}") for c in columns))


def count_time_matrix(log: EventLog, activities: list[str]) -> DataFrame:
    """(case, position, counts, times): for each activity, its occurrences so far and the days from the start of the case to
    its last one."""
    s, w = log.spec, log.window()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    a = as_category(s.activity)
    rows = log.df.withColumn("_since", seconds_between(s.time, F.first(s.time).over(w)) / DAY)
    counts = F.array(*(F.sum((a == v).cast("long")).over(run) for v in activities))
    times = F.array(*(F.coalesce(F.max(F.when(a == v, F.col("_since"))).over(run), F.lit(0.0)) for v in activities))
    return rows.select(s.case, F.row_number().over(w).cast("long").alias("position"), counts.alias("counts"), times.alias("times"))


def sliding_windows(log: EventLog, length: int) -> DataFrame:
    """(case, position, window, next): runs of ``length`` activities and what comes after; cases not longer give none."""
    s, w = log.spec, log.window()
    a = as_category(s.activity)
    rows = log.df.select(s.case, F.row_number().over(w).cast("long").alias("position"), F.collect_list(a).over(w.rowsBetween(1 - length, 0)).alias("window"), F.lead(a).over(w).alias("next"))
    return rows.where((F.size("window") == length) & F.col("next").isNotNull())


def one_hot(log: EventLog, activities: list[str]) -> DataFrame:
    """The log's case and order with a 0/1 column for each activity."""
    a = as_category(log.spec.activity)
    return log.df.select(log.spec.case, *log.spec.order, *((a == v).cast("int").alias(f"is_{v}") for v in activities))


def prefix_features(log: EventLog, activities: list[str]) -> DataFrame:
    """Features of the prefix up to each event: length, days, gaps (mean, median, least, largest), counts of activities,
    different resources, and counts of pairs of neighbours as a map."""
    s, w = log.spec, log.window()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    a = as_category(s.activity)
    gap, since = _elapsed(log)
    rows = log.df.withColumns({"_a": a, "_gap": F.when(F.row_number().over(w) > 1, gap), "_since": since / DAY, "_pair": F.concat_ws(">", F.lag(a).over(w), a)})
    gaps, pairs = F.collect_list("_gap").over(run), F.collect_list(F.when(F.contains("_pair", F.lit(">")), F.col("_pair"))).over(run)
    out = rows.select(
        s.case, F.row_number().over(w).cast("long").alias("length"), F.col("_since").alias("days"), F.coalesce(F.avg("_gap").over(run), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.min("_gap").over(run), F.lit(0.0)).alias("min_gap"), F.coalesce(F.max("_gap").over(run), F.lit(0.0)).alias("max_gap"), F.array_sort(gaps).alias("_g"),
        *(F.sum((F.col("_a") == v).cast("long")).over(run).alias(f"n_{v}") for v in activities),
        *([F.size(F.collect_set(as_category(s.resource)).over(run)).cast("long").alias("resources")] if s.resource else []), pairs.alias("_pairs"),
    )
    n = F.size("_g")
    low, high = F.get("_g", F.floor((n - 1) / 2).cast("int")), F.get("_g", F.floor(n / 2).cast("int"))
    bigrams = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("_pairs")), lambda p: F.struct(p, F.size(F.filter("_pairs", lambda q: q == p)).cast("long"))))
    return out.withColumn("median_gap", F.when(n > 0, (low + high) / 2).otherwise(0.0)).withColumn("bigrams", bigrams).drop("_g", "_pairs")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the least and largest value of each column."""
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def scale(df: DataFrame, columns: list[str], limits: DataFrame, how: str = "min-max") -> DataFrame:
    """Replace columns by their place between the limits, clipped to 0 .. 1: ``min-max``, ``max`` or ``log`` (log1p / max)."""
    df = df.join(F.broadcast(limits.limit(1)))
    for c in columns:
        low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
        ratio = {"min-max": lambda: (F.col(c) - low) / F.nullif(high - low, F.lit(0.0)), "max": lambda: F.col(c) / F.nullif(high, F.lit(0.0)), "log": lambda: F.log1p(c) / F.nullif(F.log1p(high), F.lit(0.0))}[how]()
        df = df.withColumn(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0)))))
    return df.drop(*limits.columns)


def unscale(df: DataFrame, column: str, limits: DataFrame, how: str = "min-max") -> DataFrame:
    df = df.join(F.broadcast(limits.limit(1)))
    low, high, x = F.col(f"{column}_min"), F.col(f"{column}_max"), F.col(column)
    value = {"min-max": x * (high - low) + low, "max": x * high, "log": F.expm1(x * F.log1p(high))}[how]
    return df.withColumn(column, value).drop(*limits.columns)


def image(df: DataFrame, columns: list[str], output: str = "image") -> DataFrame:
    """Add an array of (red, green, blue) bytes: each scaled column as 24 bits, padded with black to a square."""
    side = next(i for i in range(1, len(columns) + 1) if i * i >= len(columns))
    pixel = lambda c: F.array(*((F.shiftright((F.col(c) * (2**24 - 1)).cast("int"), s).bitwiseAND(255)) for s in (16, 8, 0)))
    black = F.array_repeat(F.array(*(F.lit(0),) * 3), side * side - len(columns))
    return df.withColumn(output, F.concat(F.array(*map(pixel, columns)), black))
