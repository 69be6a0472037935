"""Streams over one, several and many micro-batches in shuffled order, against the batch form; idle cases; alerts."""

import datetime
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from caselake.operators.context import k_context
from caselake.plans.log import EventLog, LogSpec
from caselake.streaming import logs as sl

SCHEMA = "case_id long, tie long, time timestamp, activity string"
SPEC = LogSpec(order=("time", "tie"))
START = datetime.datetime(2024, 1, 1)


def rows(cases=6, n=15, seed=1):
    """Events with equal times, ordered by tie, over ten days."""
    rng = random.Random(seed)
    return [(c, i, START + datetime.timedelta(hours=16 * (i // 2) + c), rng.choice("abc")) for c in range(cases) for i in range(n)]


def source(spark, folder, batches):
    """A stream of one micro-batch for each list of rows, in that order."""
    spark.createDataFrame([], SCHEMA).limit(0).write.parquet(f"{folder}/in")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{folder}/parts/{i:03}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf)
    for i in range(len(batches)):  # one file each; their times give the order
        part = next(s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/parts/{i:03}/*.parquet")))
        to = jvm.org.apache.hadoop.fs.Path(f"{folder}/in/{i:03}.parquet")
        fs.rename(part, to)
        fs.setTimes(to, 1_700_000_000_000 + 60_000 * i, -1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return sl.end_of_log(EventLog(stream, SPEC), f"{folder}/end")


def as_batch(spark, data):
    df = k_context(EventLog(spark.createDataFrame(data, SCHEMA), SPEC), 2)
    return sorted((str(r["case_id"]), r["tie"], r["activity"], [r["activity_Prev0"], r["activity_Prev1"]]) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3, 20])
def test_contexts_equal_the_batch_form_whatever_the_order_of_arrival(spark, tmp_path, n):
    data = rows()
    shuffled = random.Random(n).sample(data, len(data))
    log, end = source(spark, tmp_path, [shuffled[i::n] for i in range(n)])
    out = sl.run_to_end(sl.stream_context(log, 2, late="20 days"), end, spark, str(tmp_path))
    assert sorted((r["case_id"], r["tie"], r["value"], r["prev"]) for r in out.collect()) == as_batch(spark, data)


def test_events_wait_for_those_before_them(spark, tmp_path):
    """Events 0, 2, 4 come in the first file and 1, 3, 5 in the second."""
    data = [(7, i, START + datetime.timedelta(hours=i), "abcabc"[i]) for i in range(6)]
    log, end = source(spark, tmp_path, [data[::2], data[1::2]])
    out = sl.run_to_end(sl.stream_context(log, 2), end, spark, str(tmp_path))
    assert sorted((r["case_id"], r["tie"], r["value"], r["prev"]) for r in out.collect()) == as_batch(spark, data)


def test_late_events_are_dropped_and_idle_cases_forgotten(spark, tmp_path):
    day = lambda i: START + datetime.timedelta(days=i)
    batches = [[(c, 0, day(0), "a") for c in range(8)], [(99, 0, day(3), "b")], [(99, 1, day(20), "c")], [(0, 1, day(0), "late"), (99, 2, day(40), "a")], [(0, 2, day(41), "b")]]
    log, _ = source(spark, tmp_path, batches)
    got = {}

    def sink(df, i):
        got.update({(r["case_id"], r["tie"]): r["prev"] for r in df.collect()})

    progress = sl.run_available(sl.stream_context(log, 2, idle="18 days", late="1 day"), str(tmp_path), "append", sink)
    assert ("0", 1) not in got and got["99", 1] == ["b", "0"] and got["99", 2] == ["0", "0"] and len(got) == 8 + 3  # a gap of 17 days, one of 20
    state = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(state) >= 2 * 8 and state[-1] <= 6  # at last two cases, one with a waiting event


def test_scores_and_one_alert_a_case(spark, tmp_path):
    """Means after each event, over several micro-batches; a case falls below the threshold twice and is told once."""
    data = rows(4, 12, 3)
    table = spark.createDataFrame([(["a", "b"], "c", 0.25), (["b", "a"], "a", 0.5), (["0", "0"], "a", 0.9)], "parents array<string>, value string, p double")
    shuffled = random.Random(5).sample(data, len(data))
    log, end = source(spark, tmp_path, [shuffled[i::4] for i in range(4)])
    scores = sl.stream_scores(sl.stream_context(log, 2, late="20 days"), table, 0.3, threshold=-1.0, least=3)
    got = sl.run_to_end(scores, end, spark, str(tmp_path)).collect()
    import math

    exact = {(tuple(r["parents"]), r["value"]): r["p"] for r in table.collect()}
    sums, want, told = {}, [], set()
    for case, tie, value, prev in as_batch(spark, data):
        p = 0.3 if tuple(prev) not in {k for k, _ in exact} else 0.7 * exact.get((tuple(prev), value), 0.3)
        n, total = sums.get(case, (0, 0.0))
        sums[case] = n, total = n + 1, total + math.log(p)
        alert = case not in told and n >= 3 and total / n < -1.0
        told |= {case} if alert else set()
        want.append((case, tie, n, round(total / n, 9), alert))
    assert sorted((r["case_id"], r["tie"], r["events"], round(r["score"], 9), r["alert"]) for r in got) == want
    assert 0 < sum(r["alert"] for r in got) <= 4


class Store:
    """A state of one key that counts the messages to it: it stands for the handle, the list and the value."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        return State(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _of(self, value=None, clear=False, default=None):
        self.store.calls += 1
        if clear:
            self.store.kept.pop(self.name, None)
        elif value is not None:
            self.store.kept[self.name] = value
        return self.store.kept.get(self.name, default)

    def exists(self):
        return self._of() is not None

    def get(self):
        return self._of()

    def update(self, value):
        self._of(value)

    put = update

    def clear(self):
        self._of(clear=True)

    def appendList(self, rows):
        self.store.kept[self.name] = [*self._of(default=[]), *rows]

    def appendValue(self, row):
        self.appendList([row])


def test_a_key_sends_few_messages_and_keeps_rows_that_came_together_as_one():
    store, idle = Store(), 10**9
    machine = sl.ContextProcessor(2, idle)
    machine.init(store)
    frame = pd.DataFrame({"micros": [i * 1000 for i in range(500)], "tie": range(500), "value": ["a", "b"] * 250})
    assert not list(machine.handleInputRows(("7",), iter([frame.iloc[::-1]]), None))
    assert store.calls <= 5 and len(store.kept["waiting"]) == 1
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 399)
    out = pd.concat(machine.handleExpiredTimer(("7",), passed, None))
    assert len(out) == 400 and out["prev"].tolist()[:3] == [["0", "0"], ["a", "0"], ["b", "a"]] and store.timers >= {400}
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**7)
    out = pd.concat(machine.handleExpiredTimer(("7",), passed, None))
    assert len(out) == 100 and out["prev"].tolist()[0] == ["b", "a"] and not store.kept
    assert store.calls <= 16
