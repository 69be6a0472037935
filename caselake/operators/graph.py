"""Likelihood graph: activity -> resource -> weekday -> next activity, and the likelihood of cases in it."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.plans.log import EventLog, as_category
from caselake.plans.order import checkpointed

BEGIN, FINISH = "START", "END"
PENALTY_ACTIVITY, PENALTY_OTHER = 0.9, 0.95


def steps(log: EventLog) -> DataFrame:
    """(case, position, a, r, w, next, last): an event's activity, resource, weekday and the next activity."""
    s, w = log.spec, log.window()
    a, r = as_category(s.activity), as_category(s.resource)
    return log.df.select(
        s.case, F.row_number().over(w).cast("long").alias("position"), a.alias("a"), F.concat(F.lit("r_"), r).alias("r"), F.concat(F.lit("wd_"), F.weekday(s.time).cast("string")).alias("w"),
        F.coalesce(F.lead(a).over(w), F.lit(FINISH)).alias("next"),
    )


def basic_edges(log: EventLog) -> DataFrame:
    """(source, target, likelihood): P(next activity | activity) with START before and END after each case; START's own
    edges are the shares of first activities."""
    e = steps(log)
    inner = e.select(F.col("a").alias("source"), F.col("next").alias("target"))
    first = e.where("position = 1").select(F.lit(BEGIN).alias("source"), F.col("a").alias("target"))
    n = inner.unionByName(first).groupBy("source", "target").agg(F.count("*").alias("n"))
    return n.select("source", "target", (F.col("n") / F.sum("n").over(Window.partitionBy("source"))).alias("likelihood"))


def edges(log: EventLog) -> DataFrame:
    """(kind, a, r, w, target, likelihood) of the extended graph.

    ``begin``: 1 from START to each first activity; ``resource``: P(r | a); ``weekday``: P(w | a, r); ``next``: P(next | a, r,
    w). Final events count in the denominators, but edges to END have likelihood 0 and are left out.
    """
    e = steps(log)
    null = F.lit(None).cast("string")
    share = lambda rows, by: rows.withColumn("likelihood", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    ar = share(e.groupBy("a", "r").agg(F.count("*").alias("n")), ["a"]).select(F.lit("resource").alias("kind"), "a", null.alias("r"), null.alias("w"), F.col("r").alias("target"), "likelihood")
    aw = share(e.groupBy("a", "r", "w").agg(F.count("*").alias("n")), ["a", "r"]).select(F.lit("weekday").alias("kind"), "a", "r", null.alias("w"), F.col("w").alias("target"), "likelihood")
    an = share(e.groupBy("a", "r", "w", "next").agg(F.count("*").alias("n")), ["a", "r", "w"]).where(F.col("next") != FINISH).select(F.lit("next").alias("kind"), "a", "r", "w", F.col("next").alias("target"), "likelihood")
    begin = e.where("position = 1").select("a").distinct().select(F.lit("begin").alias("kind"), null.alias("a"), null.alias("r"), null.alias("w"), F.col("a").alias("target"), F.lit(1.0).alias("likelihood"))
    return begin.unionByName(ar).unionByName(aw).unionByName(an)


def path_likelihoods(log: EventLog, graph: DataFrame) -> DataFrame:
    """(case, position, a, step, running): likelihood of each event's step and the product so far; 0 where an edge lacks."""
    s = log.spec
    e = steps(log)
    w = Window.partitionBy(s.case).orderBy("position")
    e = e.withColumns({f"p{c}": F.lag(c).over(w) for c in "arw"})
    res = graph.where("kind = 'resource'").select(F.col("a").alias("ga"), F.col("target").alias("gr"), F.col("likelihood").alias("lr"))
    wd = graph.where("kind = 'weekday'").select(F.col("a").alias("ha"), F.col("r").alias("hr"), F.col("target").alias("hw"), F.col("likelihood").alias("lw"))
    nx = graph.where("kind = 'next'").select(F.col("a").alias("ia"), F.col("r").alias("ir"), F.col("w").alias("iw"), F.col("target").alias("it"), F.col("likelihood").alias("ln"))
    bg = graph.where("kind = 'begin'").select(F.col("target").alias("bt"), F.col("likelihood").alias("lb"))
    j = e.join(res, (F.col("a") == F.col("ga")) & (F.col("r") == F.col("gr")), "left").join(wd, (F.col("a") == F.col("ha")) & (F.col("r") == F.col("hr")) & (F.col("w") == F.col("hw")), "left")
    j = j.join(nx, (F.col("pa") == F.col("ia")) & (F.col("pr") == F.col("ir")) & (F.col("pw") == F.col("iw")) & (F.col("a") == F.col("it")), "left").join(bg, F.col("a") == F.col("bt"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    step = F.when(F.col("position") == 1, zero("lb")).otherwise(zero("ln")) * zero("lr") * zero("lw")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = j.select(s.case, "position", "a", step.alias("step"))
    running = F.when(F.min("step").over(run) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest("step", F.lit(1e-300)))).over(run)))
    return rows.withColumn("running", running)


def least_likelihood(paths: DataFrame, longest: int | None = None) -> DataFrame:
    """(a, position, likelihood): least running likelihood of prefixes of a length that end in an activity."""
    rows = paths.where(F.col("position") <= longest) if longest else paths
    return rows.where("running > 0").groupBy("a", "position").agg(F.min("running").alias("likelihood"))


def gini(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini index of the values of each group, sorted: sum((2 i - n - 1) x) / (n sum x)."""
    w = Window.partitionBy(*by)
    rows = values.withColumns({"_i": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    return rows.groupBy(*by).agg(F.try_divide(F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(value)), F.first("_n") * F.sum(value)).alias("gini"))


def class_likelihood(log: EventLog) -> DataFrame:
    """(a, resources, weekdays, successors, resource_share, ...): different values after an activity, over those of the log."""
    e = steps(log)
    each = e.groupBy("a").agg(F.count_distinct("r").alias("resources"), F.count_distinct("w").alias("weekdays"), F.count_distinct(F.when(F.col("next") != FINISH, F.col("next"))).alias("successors"))
    all_ = e.agg(F.count_distinct("r").alias("nr"), F.count_distinct("w").alias("nw"), F.count_distinct("a").alias("na"))
    j = each.join(F.broadcast(all_))
    return j.select("a", "resources", "weekdays", "successors", *((F.col(x) / F.col(n)).alias(o) for x, n, o in (("resources", "nr", "resource_share"), ("weekdays", "nw", "weekday_share"), ("successors", "na", "successor_share"))))


def reachable(graph: DataFrame) -> DataFrame:
    """(a, type, target, likelihood): nodes of a type that are reached from an activity, with path probabilities summed.

    The graph goes activity, resource, weekday, activity, so three joins reach every type.
    """
    r = graph.where("kind = 'resource'").select("a", F.col("target").alias("r"), F.col("likelihood").alias("l1"))
    w = graph.where("kind = 'weekday'").select("a", "r", F.col("target").alias("w"), F.col("likelihood").alias("l2"))
    n = graph.where("kind = 'next'").select("a", "r", "w", F.col("target").alias("t"), F.col("likelihood").alias("l3"))
    rw = r.join(w, ["a", "r"])
    rwn = rw.join(n, ["a", "r", "w"])
    out = r.select("a", F.lit("resource").alias("type"), F.col("r").alias("target"), F.col("l1").alias("l"))
    out = out.unionByName(rw.select("a", F.lit("weekday").alias("type"), F.col("w").alias("target"), (F.col("l1") * F.col("l2")).alias("l")))
    out = out.unionByName(rwn.select("a", F.lit("activity").alias("type"), F.col("t").alias("target"), (F.col("l1") * F.col("l2") * F.col("l3")).alias("l")))
    return out.groupBy("a", "type", "target").agg(F.sum("l").alias("likelihood"))


@dataclass(frozen=True)
class LikelihoodModel:
    """Tables of a likelihood graph with what a walk takes where an edge is missing.

    ``activities`` (a, miss_r, miss_w, miss_a), ``resources`` (a, r, p, miss_w, miss_a) and ``weekdays`` (a, r, w, p, miss_a) are
    the nodes: p is the edge into a node, miss_* is (1 - Gini index) times (1 - class likelihood) of a resource, a weekday or an
    activity that has no edge and can't be reached. ``successors`` (a, r, w, target, p) and ``begin`` (target, p) are the edges
    into activities; ``reach_w`` and ``reach_a`` (a, target, p) sum the paths from an activity to weekdays and activities.
    """

    activities: DataFrame
    resources: DataFrame
    weekdays: DataFrame
    successors: DataFrame
    begin: DataFrame
    reach_w: DataFrame
    reach_a: DataFrame


def scaled_class(found: Column, total: Column) -> Column:
    """Class likelihood: the share of ``found`` in ``total``, mirrored at one half, scaled from 1 / (total + 1) to one half."""
    raw, low = found / total, 1 / (total + 1)
    return F.when(total > 1, (F.when(raw > 0.5, 1 - raw).otherwise(raw) - low) / (0.5 - low)).otherwise(0.0)


def likelihood_model(log: EventLog) -> LikelihoodModel:
    """The tables, from a log. Class likelihoods count different values, but a weekday after a known resource counts events."""
    e, graph = checkpointed(steps(log)), edges(log)
    follows = F.when(F.col("next") != FINISH, F.col("next"))
    reach = checkpointed(reachable(graph))
    spread = gini(reach, ["a", "type"], "likelihood").groupBy("a").pivot("type", ["resource", "weekday", "activity"]).agg(F.first("gini"))
    even = {t: 1 - F.coalesce(F.col(t), F.lit(0.0)) for t in ("resource", "weekday", "activity")}
    totals = e.agg(F.count_distinct("r").alias("nr"), F.count_distinct("w").alias("nw"))
    by_a = e.groupBy("a").agg(F.count_distinct("r").alias("cr"), F.count_distinct("w").alias("cw"), F.count_distinct(follows).alias("na")).join(spread, "a", "left").crossJoin(F.broadcast(totals))  # one row
    by_a = checkpointed(by_a.select("a", *(v.alias(f"even_{t}") for t, v in even.items()), "cr", "cw", "na", "nr", "nw"))
    miss = lambda t, found, total: (F.col(f"even_{t}") * (1 - scaled_class(found, F.col(total)))).alias(f"miss_{t[0]}")
    activities = by_a.select("a", miss("resource", F.col("cr"), "nr"), miss("weekday", F.col("cw"), "nw"), miss("activity", F.lit(0), "na"))
    ar = e.groupBy("a", "r").agg(F.count("*").alias("n"), F.count_distinct(follows).alias("s"))
    p = lambda kind, *names: graph.where(F.col("kind") == kind).select(*(F.col(x).alias(y) for x, y in names), F.col("likelihood").alias("p"))
    resources = p("resource", ("a", "a"), ("target", "r")).join(ar, ["a", "r"]).join(by_a, "a").select("a", "r", "p", miss("weekday", F.col("n"), "nw"), miss("activity", F.col("s"), "na"))
    aw = e.groupBy("a", "w").agg(F.count_distinct(follows).alias("s")).join(by_a, "a").select("a", "w", miss("activity", F.col("s"), "na"))
    weekdays = p("weekday", ("a", "a"), ("r", "r"), ("target", "w")).join(aw, ["a", "w"]).select("a", "r", "w", "p", "miss_a")
    of_type = lambda t: reach.where(F.col("type") == t).select("a", "target", F.col("likelihood").alias("p"))
    return LikelihoodModel(*map(checkpointed, (activities, resources, weekdays, p("next", ("a", "a"), ("r", "r"), ("w", "w"), ("target", "target")), p("begin", ("target", "target")), of_type("weekday"), of_type("activity"))))


def case_likelihood(log: EventLog, model: LikelihoodModel) -> DataFrame:
    """(case, log_likelihood): ln of the least likelihood over the prefixes of a case, walked through the graph.

    A walk keeps the last node (start, activity, activity with resource, or with weekday too), the last activity (none after an
    unknown one) and the likelihood L. For each value of an event (activity, resource, weekday): if an edge leads from the
    last node to it, L takes the edge's likelihood; else, with a last activity, the summed likelihood of paths from there to
    the value, or (1 - Gini)(1 - class likelihood) if there are none, times 0.9 (activity) or 0.95; else L is squared and takes
    that factor alone. Known activities become the last node, unknown ones leave it as it is.

    Nodes only depend on what is known, so windows find them: the last known activity, the first resource since then that has
    an edge, the first weekday since then. Edges are joined once for each kind. The steps are L -> L^(2^d) f, so with c the
    sum of d, ln L = 2^c sum(ln f / 2^c): running sums too, and no case is folded in one place. Likelihood zero is null.
    """
    s, w = log.spec, Window.partitionBy(log.spec.case).orderBy("position")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = steps(log).select(s.case, "position", "a", "r", "w").join(model.activities, "a", "left")
    known = F.col("miss_r").isNotNull()
    e = e.withColumn("known", known).withColumns({"run": F.count(F.when(F.col("known"), 1)).over(so_far), "a0": F.last(F.when(F.col("known"), F.col("a")), True).over(so_far)})
    run = Window.partitionBy(s.case, "run").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    keyed = lambda df, names, values: df.select(*(F.col(x).alias(f"_{y}") for x, y in names.items()), F.struct(*(F.col(v) for v in values)).alias("_found"))

    def look(rows: DataFrame, df: DataFrame, names: dict[str, str], values: list[str], out: str) -> DataFrame:
        """``rows`` with a struct of ``values``, null where ``df`` has no row for the columns that ``names`` maps to."""
        on = [F.col(y) == F.col(f"_{y}") for y in names.values()]
        return rows.join(keyed(df, names, values), on, "left").drop(*(f"_{y}" for y in names.values())).withColumnRenamed("_found", out)

    e = look(e, model.resources, {"a": "a0", "r": "r"}, ["p", "miss_w", "miss_a"], "to_r")
    first = lambda found, *columns: F.first(F.when(F.col(found).isNotNull(), F.struct(*columns)), True).over(run)
    e = e.withColumn("at_r", first("to_r", F.col("r"), F.col("to_r.miss_w"), F.col("to_r.miss_a"), F.col("position"))).withColumn("r0", F.col("at_r.r"))
    e = look(e, model.weekdays, {"a": "a0", "r": "r0", "w": "w"}, ["p", "miss_a"], "to_w")
    e = e.withColumn("at_w", first("to_w", F.col("w"), F.col("to_w.miss_a"), F.col("position")))
    e = look(e, model.reach_w, {"a": "a0", "target": "w"}, ["p"], "by_w")
    before = lambda c: F.lag(c).over(w)
    leave = F.coalesce(F.col("at_w.miss_a"), F.col("at_r.miss_a"), F.col("miss_a"))
    e = e.withColumns({"la": before("a0"), "lr": before("r0"), "lw": before(F.col("at_w.w")), "last": before(F.when(F.col("known"), F.col("a"))), "leave": before(F.when(F.col("known"), leave))})
    e = look(e, model.successors, {"a": "la", "r": "lr", "w": "lw", "target": "a"}, ["p"], "to_a")
    e = look(e, model.begin, {"target": "a"}, ["p"], "to_first")
    e = look(e, model.reach_a, {"a": "last", "target": "a"}, ["p"], "by_a")
    into = F.when(F.col("la").isNull(), F.col("to_first.p")).otherwise(F.col("to_a.p"))
    missing_a = F.coalesce(F.col("by_a.p"), F.col("leave")) * PENALTY_ACTIVITY
    new_r = F.col("at_r.position") == F.col("position")  # the edge to the resource is taken at this event
    new_w = F.col("at_w.position") == F.col("position")
    missing_w = F.coalesce(F.col("by_w.p"), F.col("at_r.miss_w"), F.col("miss_w")) * PENALTY_OTHER
    factors = [  # what is multiplied, and whether the likelihood is squared before
        (F.coalesce(into, missing_a, F.lit(PENALTY_ACTIVITY)), into.isNull() & F.col("last").isNull()),
        (F.when(new_r, F.col("to_r.p")).when(F.col("known"), F.col("miss_r") * PENALTY_OTHER).otherwise(PENALTY_OTHER), ~F.coalesce(new_r, F.lit(False)) & ~F.col("known")),
        (F.when(new_w, F.col("to_w.p")).when(F.col("known"), missing_w).otherwise(PENALTY_OTHER), ~F.coalesce(new_w, F.lit(False)) & ~F.col("known")),
    ]
    d, b = F.lit(0), F.lit(0.0)
    for f, squared in factors:
        twice = squared.cast("int")
        d, b = d + twice, b * (1 + twice) + F.when(f > 0, F.ln(f)).otherwise(float("-inf"))
    e = e.select(s.case, "position", d.alias("d"), b.alias("b")).withColumn("c", F.least(F.sum("d").over(so_far), F.lit(1000)))
    running = F.pow(F.lit(2.0), F.col("c")) * F.sum(F.col("b") * F.pow(F.lit(2.0), -F.col("c"))).over(so_far)
    least = F.least(F.min("running"), F.lit(0.0))
    return e.withColumn("running", running).groupBy(s.case).agg(F.when(least > float("-inf"), least).alias("log_likelihood"))


def per_case(log: EventLog, f, schema: str) -> DataFrame:
    """A user's function on the pandas frame of each case, in order of events."""
    order = list(log.spec.order)

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values(order))

    return log.df.groupBy(log.spec.case).applyInPandas(ordered, schema)
