"""What stands next to an event: its context, durations, prefixes, and events added or taken away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.columns import DAY, seconds_between
from caselake.plans.log import EventLog, as_category

END, START = "end", "start"


def k_context(log: EventLog, k: int | None = None, columns: list[str] | None = None, missing: str = "0") -> DataFrame:
    """Add ``X_Prev0`` .. ``X_Prev{k-1}``: ``X_Prev{i}`` is X of the event i + 1 before; ``missing`` where there is none.

    Numeric columns have 0.0 there. The case id is the same in the whole context. One window, so one exchange and sort.
    """
    w, k = log.window(), log.spec.k if k is None else k
    new = {}
    for c in columns or [*log.attributes(), *log.spec.numeric]:
        value, default = (F.col(c), 0.0) if c in log.spec.numeric else (as_category(c), missing)
        new |= {f"{c}_Prev{i}": F.lag(value, i + 1, default).over(w) for i in range(k)}
    new |= {f"{log.spec.case}_Prev{i}": F.col(log.spec.case) for i in range(k)}
    return log.df.withColumns(new)


def duration_context(log: EventLog, k: int | None = None) -> DataFrame:
    """Add ``duration_{i}``: seconds since the event i + 1 before, 0 if there is none."""
    w, t = log.window(), log.spec.time
    return log.df.withColumns({f"duration_{i}": F.coalesce(seconds_between(t, F.lag(t, i + 1).over(w)), F.lit(0.0)) for i in range(log.spec.k if k is None else k)})


def trace_so_far(log: EventLog, column: str | None = None, separator: str = ">") -> DataFrame:
    """Add ``trace``: the values of the case up to and with the event, as one text."""
    w = log.window().rowsBetween(Window.unboundedPreceding, 0)
    return log.df.withColumn("trace", F.concat_ws(separator, F.collect_list(as_category(column or log.spec.activity)).over(w)))


def remaining_time(log: EventLog, unit: float = DAY) -> DataFrame:
    """Add ``duration`` since the event before and ``remaining``, the sum of later durations of the case (days)."""
    w, t = log.window(), log.spec.time
    df = log.df.withColumn("duration", F.coalesce(seconds_between(t, F.lag(t).over(w)), F.lit(0.0)) / unit)
    return df.withColumn("remaining", F.coalesce(F.sum("duration").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))


def processing_times(df: DataFrame, case: str, order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Add ``processing`` (end - start) and ``waiting`` (start - end of the event before, 0 for the first), in seconds."""
    w = Window.partitionBy(case).orderBy(*order)
    return df.withColumns({"processing": seconds_between(end, start), "waiting": F.coalesce(seconds_between(start, F.lag(end).over(w)), F.lit(0.0))})


def _artificial(log: EventLog, name: str, first: bool) -> DataFrame:
    """One event a case, at the time of its first or last event; other texts are ``name``, other values null."""
    s = log.spec
    at = F.struct(*s.order)
    pick = F.min_by if first else F.max_by
    fields = {f.name: f.dataType.simpleString() for f in log.df.schema}
    aggs = []
    for c, kind in fields.items():
        if c == s.case:
            continue
        if c in s.order and c != s.activity:
            aggs.append(pick(c, at).alias(c))
        else:
            aggs.append((F.lit(name) if kind == "string" else F.lit(None).cast(kind)).alias(c))
    return log.df.groupBy(s.case).agg(*aggs).select(*fields)


def add_end_events(log: EventLog, start: bool = False) -> EventLog:
    """Append an ``end`` event to each case (and, if asked, put a ``start`` event before it).

    ``event_rank`` (-1, 0, 1) leads the order, so an end is last even among events of its time.
    """
    df = log.df.withColumn("event_rank", F.lit(0)).unionByName(_artificial(log, END, False).withColumn("event_rank", F.lit(1)))
    if start:
        df = df.unionByName(_artificial(log, START, True).withColumn("event_rank", F.lit(-1)))
    return log.with_df(df, order=("event_rank", *log.spec.order))


def drop_repeats(log: EventLog, columns: list[str] | None = None) -> EventLog:
    """Drop an event whose columns (activity and resource) all equal those of the event before."""
    w = log.window()
    columns = columns or [c for c in (log.spec.activity, log.spec.resource) if c]
    same = F.row_number().over(w) > 1
    for c in columns:
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    return log.with_df(log.df.withColumn("_same", same).where("not _same").drop("_same"))


def reduce_loops(log: EventLog, columns: list[str] | None = None, end: str | None = None) -> DataFrame:
    """Merge runs of events with equal columns: case, ``run``, the columns, first ``start`` and last ``end`` time, ``events``."""
    s, w = log.spec, log.window()
    columns = columns or [c for c in (s.activity, s.resource) if c]
    new = F.row_number().over(w) == 1
    for c in columns:
        new |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = log.df.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(s.case, "run").agg(*(F.first(c).alias(c) for c in columns), F.min(s.time).alias("start"), F.max(end or s.time).alias("end"), F.count("*").alias("events"))


def traces(log: EventLog, columns: list[str] | None = None) -> DataFrame:
    """One row a case: each column as an array in the order of events, and their number."""
    s = log.spec
    columns = columns or [s.activity]
    event = F.struct(*s.order, *(F.col(c).alias(f"v_{c}") for c in columns))
    grouped = log.df.groupBy(s.case).agg(F.array_sort(F.collect_list(event)).alias("_e"))
    return grouped.select(s.case, *(F.col("_e")[f"v_{c}"].alias(c) for c in columns), F.size("_e").cast("long").alias("length"))


def prefixes_and_suffixes(log: EventLog, sizes: tuple[int, ...] | None = None, column: str | None = None) -> DataFrame:
    """For each event its ``prefix`` (with it) and ``suffix`` (after it) in the case; ``sizes`` keeps prefixes of these lengths."""
    w, c = log.window(), column or log.spec.activity
    df = log.df.select(
        log.spec.case, F.row_number().over(w).cast("long").alias("prefix_size"),
        F.collect_list(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("prefix"),
        F.collect_list(c).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("suffix"),
    )
    return df.where(F.col("prefix_size").isin(*sizes)) if sizes else df


def pair_start_complete(df: DataFrame, case: str, task: str, kind: str, order: list[str], time: str, start: str = "start", complete: str = "complete") -> DataFrame:
    """Pair the n-th start of a task in a case with its n-th completion; cases in which some start or completion is left go.

    Returns case, task, ``nth``, ``start``, ``end``.
    """
    w = Window.partitionBy(case, task, kind).orderBy(*order)
    rows = df.where(F.col(kind).isin(start, complete)).select(case, task, kind, F.col(time).alias("at"), F.row_number().over(w).alias("nth"))
    a = rows.where(F.col(kind) == start).select(case, task, "nth", F.col("at").alias("start"))
    b = rows.where(F.col(kind) == complete).select(case, task, "nth", F.col("at").alias("end"))
    both = a.join(b, [case, task, "nth"], "full")
    whole = both.groupBy(case).agg(F.bool_and(F.col("start").isNotNull() & F.col("end").isNotNull()).alias("whole")).where("whole").select(case)
    return both.join(whole, case, "left_semi")


def pair_by_position(df: DataFrame, case: str, kind: str, order: list[str], columns: list[str], time: str, start: str = "start", complete: str = "complete") -> DataFrame:
    """Pair the n-th start of a case with its n-th completion, whatever their tasks; columns are those of the start."""
    w = Window.partitionBy(case, kind).orderBy(*order)
    rows = df.withColumn("nth", F.row_number().over(w))
    a = rows.where(F.col(kind) == start).select(case, "nth", *columns, F.col(time).alias("start"))
    b = rows.where(F.col(kind) == complete).select(case, "nth", F.col(time).alias("end"))
    return a.join(b, [case, "nth"])
