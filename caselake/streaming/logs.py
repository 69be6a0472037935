"""Streams of events: counts that grow, contexts in the order of time, scores of cases and alerts.

State machines with timers in event time: events wait until the watermark has passed them, so what comes out is in order
whatever the order of arrival; state of cases that stay idle is dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from caselake.operators.model import key_of
from caselake.plans.log import EventLog, as_category

#: State machines need this store; it keeps state on disk, so cases need not fit in memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "case_id string, time timestamp, tie long, value string"
CONTEXT = f"{EVENT}, prev array<string>"
SCORE = "case_id string, time timestamp, tie long, events long, score double, alert boolean"
#: Time of the row that ends a log: later than all events.
END_OF_LOG = "2200-01-01 00:00:00"


def stream_counts(df: DataFrame, value: str, parents: list[str]) -> DataFrame:
    """(parents, value, n) as a running aggregate: update or complete output mode; the state is the table itself."""
    return df.groupBy(key_of(parents).alias("parents"), as_category(value).alias("value")).agg(F.count("*").alias("n"))


def micros(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1_000_000)


class Ordered(StatefulProcessor):
    """Rows of a key wait in a list until the watermark has passed their time; then ``released`` gets them in order.

    State: the waiting rows (time in microseconds, tie, and what a subclass needs), when the next timer is due, when the last row
    and the last released row were, and what a subclass remembers. Each call to the store is a message to another process,
    whatever its size: rows that come together wait as one text, all else is one value, and a key has one timer, for its first
    waiting row or, without one, for its end after staying idle. A key starts anew after a gap longer than ``idle``, so what
    comes out depends on the rows alone and not on when they came.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.clock = handle.getValueState("clock", "due long, last long, released long, memory string")

    def rows_of(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """The rows that are to wait, from a frame of input: (time, tie, ...)."""
        raise NotImplementedError

    def released(self, key: tuple, rows: list[list], memory: list | None) -> tuple[pd.DataFrame, list]:
        """What comes out for rows in order, and what to remember; ``memory`` is None where a key starts."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in self.rows_of(pdf)]
        if key[0] is None or not new:  # the row that ends a log has no case
            return
        self.waiting.appendValue((json.dumps(new),))
        due, last, released, memory = self.clock.get() or (None, None, None, None)
        first, latest = -(-min(r[0] for r in new) // 1000), max(r[0] for r in new)  # timers are in milliseconds
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            due = first
            self.handle.registerTimer(due)
        self.clock.update((due, latest if last is None else max(last, latest), released, memory))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, passed = self.clock.get(), timerValues.getCurrentWatermarkInMs() * 1000
        if clock is None or clock[0] * 1000 > passed:
            return
        _, last, before, memory = clock
        memory = json.loads(memory) if memory else None
        rows = sorted((r for (text,) in self.waiting.get() for r in json.loads(text)), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= passed]
        rest = rows[len(ready) :]
        run: list[list] = []
        for r in ready:
            if before is not None and r[0] - before > self.idle:
                if run:
                    yield self.released(key, run, memory)[0]
                memory, run = None, []
            run.append(r)
            before = r[0]
        if run:
            out, memory = self.released(key, run, memory)
            yield out
        if rows:
            self.waiting.clear()
        if not rest and last + self.idle <= passed:
            self.clock.clear()
            return
        if rest:
            self.waiting.appendValue((json.dumps(rest),))
        due = -(-(rest[0][0] if rest else last + self.idle) // 1000)
        self.handle.registerTimer(due)
        self.clock.update((due, last, before, json.dumps(memory)))

    def close(self) -> None:
        pass


def _frame(case: str, time: Sequence[int], **columns: Sequence) -> pd.DataFrame:
    return pd.DataFrame({"case_id": case, "time": np.array(time, "datetime64[us]"), **columns})


class ContextProcessor(Ordered):
    """The k values before each event, newest first."""

    def __init__(self, k: int, idle: int):
        super().__init__(idle)
        self.k = k

    def rows_of(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        return zip(pdf["micros"].tolist(), pdf["tie"].tolist(), map(str, pdf["value"]), strict=True)

    def released(self, key: tuple, rows: list[list], memory: list | None) -> tuple[pd.DataFrame, list]:
        last, prev = memory or [], []
        for _, _, v in rows:
            prev.append((last + ["0"] * self.k)[: self.k])
            last = [v, *last][: self.k]
        time, tie, value = zip(*rows, strict=True)
        return _frame(key[0], time, tie=tie, value=value, prev=prev), last


class ScoreProcessor(Ordered):
    """Running mean of the scores of a case; one alert, at the first event after ``least`` at which it is below the threshold."""

    def __init__(self, threshold: float, least: int, idle: int):
        super().__init__(idle)
        self.threshold, self.least = threshold, least

    def rows_of(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        return zip(pdf["micros"].tolist(), pdf["tie"].tolist(), pdf["x"].tolist(), strict=True)

    def released(self, key: tuple, rows: list[list], memory: list | None) -> tuple[pd.DataFrame, list]:
        n, total, alerted = memory or (0, 0.0, False)
        out = []
        for time, tie, x in rows:
            n, total = n + 1, total + x
            alert = not alerted and n >= self.least and total / n < self.threshold
            alerted = alerted or alert
            out.append((time, tie, n, total / n, alert))
        time, tie, events, score, alert = zip(*out, strict=True)
        return _frame(key[0], time, tie=tie, events=events, score=score, alert=alert), [n, total, alerted]


def _ordered(rows: DataFrame, processor: Ordered, schema: str) -> DataFrame:
    """Rows with a watermark on ``time``, by case, through a processor; its output has an event time too, so processors chain."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    by = rows.withColumn("micros", F.unix_micros("time")).groupBy("case_id")
    return by.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName="time")


def stream_context(log: EventLog, k: int | None = None, idle: str = "30 days", late: str = "1 day") -> DataFrame:
    """(case, time, tie, value, prev): each event's activity and the k before it, newest first, ``0`` where there is none.

    An event comes out once the watermark, ``late`` behind the latest event, has passed it; so contexts are those of the log in
    order of time, however events arrive within that. Later ones are dropped. State of a case is its waiting events and
    its last k activities; after a gap longer than ``idle`` a case starts anew, and its state is gone by then. Rows without a
    case come out nowhere, but move the watermark: see ``end_of_log``.
    """
    s, k = log.spec, log.spec.k if k is None else k
    order = [o for o in s.order if o != s.time]
    rows = log.df.select(
        F.col(s.case).cast("string").alias("case_id"), F.col(s.time).cast("timestamp").alias("time"), F.coalesce(F.col(order[0]).cast("long"), F.lit(0)).alias("tie") if order else F.lit(0).cast("long").alias("tie"),
        as_category(s.activity).alias("value"),
    )
    return _ordered(rows.withWatermark("time", late), ContextProcessor(k, micros(idle)), CONTEXT)


def event_scores(context: DataFrame, table: DataFrame, rate: float | Column) -> DataFrame:
    """``context`` with x, the ln of each event's score under a conditional table: joined, so it works on streams and tables."""
    exact = table.select(F.col("parents").alias("prev"), "value", "p")
    known = table.select(F.col("parents").alias("prev")).distinct().withColumn("known", F.lit(True))
    j = context.join(known, "prev", "left").join(exact, ["prev", "value"], "left")
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    score = F.when(F.col("known").isNull(), rate).otherwise((1 - rate) * F.coalesce("p", rate))
    return j.select("case_id", "time", "tie", F.ln(F.greatest(score, F.lit(1e-10))).alias("x"))


def stream_scores(context: DataFrame, table: DataFrame, rate: float, threshold: float = float("-inf"), least: int = 1, idle: str = "30 days") -> DataFrame:
    """(case_id, time, tie, events, score, alert): the running mean of a case's event scores after each of its events.

    ``context`` comes from ``stream_context``, whose event time goes on; the table is static and joined to the stream. ``alert``
    is true at the first event, from the ``least``-th on, after which the mean is below the threshold: once a case. After a
    gap longer than ``idle`` a case starts anew.
    """
    return _ordered(event_scores(context, table, rate), ScoreProcessor(threshold, least, micros(idle)), SCORE)


def end_of_log(log: EventLog, folder: str) -> tuple[EventLog, Callable[[], None]]:
    """A streamed log that can be ended: the log with the rows of ``folder``, and a function that writes one row there.

    That row has no case and a time after all others, so the watermark passes every event that still waits.
    """
    s, spark = log.spec, log.df.sparkSession
    fields = log.df.schema.fields
    closing = spark.createDataFrame([(None,) * len(fields)], log.df.schema).withColumn(s.time, F.lit(END_OF_LOG).cast("timestamp").cast(log.df.schema[s.time].dataType))
    closing.limit(0).write.mode("ignore").parquet(folder)  # the folder has to be there when the stream starts

    def end() -> None:
        closing.write.mode("append").parquet(folder)

    return log.with_df(log.df.unionByName(spark.readStream.schema(log.df.schema).parquet(folder))), end


def run_available(df: DataFrame, folder: str, mode: str, sink: Callable[[DataFrame, int], None]) -> list:
    """Run a stream over what is there now, exactly once for each micro-batch, with its progress under ``folder``.

    Returns the progress of its micro-batches, state rows among it.
    """
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def run_to_end(df: DataFrame, end: Callable[[], None], spark: SparkSession, folder: str) -> DataFrame:
    """Run a stream of ``end_of_log`` over what is there and once more after its end; all rows that came out, as a table."""
    out = f"{folder}/out-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(f"{out}/batch=-1")

    def sink(rows: DataFrame, i: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={i}")

    run_available(df, folder, "append", sink)
    end()
    run_available(df, folder, "append", sink)
    return spark.read.parquet(out).drop("batch")
