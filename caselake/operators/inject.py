"""Labelled anomalies put into the cases of a log, the same ones on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.columns import draw
from caselake.plans.log import EventLog

KINDS = ("swap", "activity", "weekday", "resource")


def inject(log: EventLog, density: float = 0.1, seed: int = 42, combined: bool = False) -> DataFrame:
    """Change about ``density`` of the cases; adds ``anomaly`` (0, 1) and ``anomaly_kind``.

    By a hash of the case, one of its events (and a kind) is chosen: the event's activity is swapped with the next one's,
    becomes new, its time moves by one to six days, or its resource becomes new. ``combined`` applies all kinds. A case of one
    event isn't swapped.
    """
    s, w = log.spec, log.window()
    h = lambda salt: draw(1_000_000, seed, salt, F.col(s.case))
    n = F.count("*").over(Window.partitionBy(s.case))
    rows = log.df.withColumns({"_pos": F.row_number().over(w), "_n": n, "_hit": h("case") < density * 1_000_000, "_kind": F.pmod(h("kind"), F.lit(len(KINDS)))})
    rows = rows.withColumn("_at", F.pmod(h("place"), F.greatest(F.col("_n") - F.when(F.lit(combined) | (F.col("_kind") == 0), 1).otherwise(0), F.lit(1))) + 1)
    on = lambda kind: F.col("_hit") & (F.lit(combined) | (F.col("_kind") == KINDS.index(kind)))
    here = F.col("_pos") == F.col("_at")
    a = F.col(s.activity)
    moved = F.when(on("swap") & here & (F.col("_n") > 1), F.lead(a).over(w)).when(on("swap") & (F.col("_pos") == F.col("_at") + 1), F.lag(a).over(w)).otherwise(a)
    rows = rows.withColumn("_a", moved)
    rows = rows.withColumn("_a", F.when(on("activity") & here, F.concat(F.lit("new_"), F.col("_a").cast("string"))).otherwise(F.col("_a").cast("string")))
    changes = {s.activity: F.col("_a")}
    if s.time:
        changes[s.time] = F.when(on("weekday") & here, F.col(s.time) + F.make_dt_interval(days=(F.pmod(h("days"), F.lit(6)) + 1).cast("int"))).otherwise(F.col(s.time))
    if s.resource:
        r = F.col(s.resource).cast("string")
        changes[s.resource] = F.when(on("resource") & here, F.concat(F.lit("new_"), r)).otherwise(r)
    kind = F.when(~F.col("_hit"), "none").when(F.lit(combined), "all").otherwise(F.get(F.array(*map(F.lit, KINDS)), F.col("_kind").cast("int")))
    changes |= {"anomaly": F.col("_hit").cast("int"), "anomaly_kind": kind}
    return rows.withColumns(changes).drop("_pos", "_n", "_hit", "_kind", "_at", "_a")


def injected_split(log: EventLog, percentage: float = 50.0, density: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split`` by a hash of the case; anomalies are put into test cases only."""
    s = log.spec
    test = draw(1_000_000, seed, "split", F.col(s.case)) >= percentage * 10_000
    changed = inject(log, density, seed)
    plain = log.df.withColumn(s.activity, F.col(s.activity).cast("string"))
    if s.resource:
        plain = plain.withColumn(s.resource, F.col(s.resource).cast("string"))
    train = plain.where(~test).withColumns({"anomaly": F.lit(0), "anomaly_kind": F.lit("none"), "split": F.lit("train")})
    return train.unionByName(changed.where(test).withColumn("split", F.lit("test")))
