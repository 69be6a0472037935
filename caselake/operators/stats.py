"""What a log looks like: sizes, variants, entropy, dependencies between columns, relations between activities, roles."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.context import traces
from caselake.plans.log import EventLog, as_category
from caselake.plans.order import checkpointed, with_index, with_running

#: Resources of a block, whose pairs with another block are compared at once, and tasks of one product.
BLOCK, WIDE = 1024, 4096


def characteristics(log: EventLog) -> DataFrame:
    """One row: events, cases, activities, mean, largest and smallest case."""
    s = log.spec
    lengths = log.df.groupBy(s.case).agg(F.count("*").alias("n"))
    sizes = lengths.agg(F.sum("n").alias("events"), F.count("*").alias("cases"), F.avg("n").alias("avg_case_length"), F.max("n").alias("max_case_length"), F.min("n").alias("min_case_length"))
    return sizes.join(log.df.agg(F.count_distinct(as_category(s.activity)).alias("activities")))  # one row each


def attribute_dimensions(log: EventLog) -> DataFrame:
    """(attribute, values, lowest, highest): distinct values of each categorical attribute, least and most over all."""
    columns = log.attributes()
    one = log.df.agg(*(F.count_distinct(as_category(c)).alias(c) for c in columns))
    long = one.unpivot([], columns, "attribute", "values")
    w = Window.partitionBy()
    return long.select("attribute", "values", F.min("values").over(w).alias("lowest"), F.max("values").over(w).alias("highest"))


def activity_distribution(log: EventLog, column: str | None = None) -> DataFrame:
    c = column or log.spec.activity
    return log.df.groupBy(as_category(c).alias("activity")).agg(F.count("*").alias("n"))


def variants(log: EventLog, separator: str = ">") -> DataFrame:
    """(variant, cases, length): different sequences of activities and the number of cases with each."""
    t = traces(log)
    return t.groupBy(F.array_join(log.spec.activity, separator).alias("variant")).agg(F.count("*").alias("cases"), F.first("length").alias("length"))


def first_activities(log: EventLog) -> DataFrame:
    s = log.spec
    first = log.df.groupBy(s.case).agg(F.min_by(s.activity, F.struct(*s.order)).alias("activity"))
    return first.groupBy("activity").agg(F.count("*").alias("cases"))


def _entropy(n: str, total: Column) -> Column:
    return -F.sum(F.col(n) / total * F.ln(F.col(n) / total))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, entropy) in nats."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), as_category(c).alias("value")) for c in columns))).alias("v")).groupBy("v.column", "v.value").agg(F.count("*").alias("n"))
    shares = long.withColumn("total", F.sum("n").over(Window.partitionBy("column")))
    return shares.groupBy("column").agg(_entropy("n", F.col("total")).alias("entropy"))


def counts_by_sets(df: DataFrame, sets: list[tuple[str, ...]], weight: str | None = None) -> DataFrame:
    """(of, cells, n): rows (or the sum of ``weight``) by the values of each set of columns; ``of`` is the set's place in the list.

    Rows are counted by all columns in use first, so different rows, not all rows, are copied once for each set.
    """
    columns = sorted({c for s in sets for c in s})
    name = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = df.groupBy(*(as_category(c).alias(name[c]) for c in columns)).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    copies = F.array(*(F.struct(F.lit(i).alias("of"), F.array(*(name[c] for c in s)).alias("cells")) for i, s in enumerate(sets)))
    return rows.select(F.explode(copies).alias("copy"), "n").groupBy("copy.of", "copy.cells").agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, hx, hy, mi, uncertainty): entropies and mutual information in nats of each pair of columns.

    One pass gives the joint counts of all pairs, and these give the marginal ones. ``uncertainty`` is mi / hy, the share of y
    that x explains; 0 if y is constant.
    """
    sets = list(dict.fromkeys(tuple(sorted({x, y})) for x, y in pairs))
    place = {s: i for i, s in enumerate(sets)}
    wanted = [(place[s], x, y, s.index(x), s.index(y)) for x, y in pairs for s in [tuple(sorted({x, y}))]]
    table = df.sparkSession.createDataFrame(wanted, "of int, x string, y string, ix int, iy int")  # one row a pair of columns
    rows = counts_by_sets(df, sets).join(F.broadcast(table), "of").select("x", "y", F.get("cells", F.col("ix")).alias("vx"), F.get("cells", F.col("iy")).alias("vy"), "n")
    wide = rows.withColumns({"nx": F.sum("n").over(Window.partitionBy("x", "y", "vx")), "ny": F.sum("n").over(Window.partitionBy("x", "y", "vy"))})
    wide = wide.withColumn("total", F.sum("n").over(Window.partitionBy("x", "y")))
    p, t = F.col("n") / F.col("total"), F.col("total")
    out = wide.groupBy("x", "y").agg(
        (-F.sum(p * F.ln(F.col("nx") / t))).alias("hx"), (-F.sum(p * F.ln(F.col("ny") / t))).alias("hy"), F.sum(p * F.ln(F.col("n") * t / (F.col("nx") * F.col("ny")))).alias("mi")
    )
    return out.withColumn("uncertainty", F.when(F.col("hy") > 1e-12, F.col("mi") / F.col("hy")).otherwise(0.0))


def functional_dependencies(df: DataFrame, parents: list[str], children: list[str], threshold: float = 0.99) -> DataFrame:
    """(parent, child, uncertainty): pairs where the parent explains at least ``threshold`` of the child."""
    found = mutual_information(df, [(p, c) for p in parents for c in children if p != c])
    return found.where(F.col("uncertainty") >= threshold).select(F.col("x").alias("parent"), F.col("y").alias("child"), "uncertainty")


def new_value_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate): distinct values for each row."""
    one = df.agg(*((F.count_distinct(as_category(c)) / F.count("*")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "rate")


def running_new_value_rate(log: EventLog, column: str) -> DataFrame:
    """For each event in order: position from 1, and different values so far for each event so far."""
    order = [*log.spec.order, log.spec.case]
    first = F.row_number().over(Window.partitionBy(as_category(column)).orderBy(*order)) == 1
    rows = log.df.withColumn("_new", first.cast("long"))
    run = with_running(rows, order, {"seen": "_new"})
    return run.select(log.spec.case, *log.spec.order, (F.col("idx") + 1).alias("position"), (F.col("seen") / (F.col("idx") + 1)).alias("rate"))


def follows(log: EventLog, window: int | None = None, per_case: bool = False) -> DataFrame:
    """(a, b, n): occurrences of a that b follows in the case, within the next ``window`` events; b counts once for each.

    Without a window, b follows an occurrence if b's last place in the case is later; so events meet the last places of the
    case's activities, and long cases cost their length times their different activities. With one, an event meets its window.
    """
    s, a = log.spec, as_category(log.spec.activity)
    if window is None:
        rows = log.df.select(s.case, a.alias("a"), F.row_number().over(log.window()).alias("_at"))
        last = rows.groupBy(s.case, F.col("a").alias("b")).agg(F.max("_at").alias("_last"))
        rows = rows.join(last, s.case).where(F.col("_at") < F.col("_last"))
    else:
        rows = log.df.select(s.case, a.alias("a"), F.collect_list(a).over(log.window().rowsBetween(1, window)).alias("after"))
        rows = rows.select(s.case, "a", F.explode(F.array_distinct("after")).alias("b"))
    return rows.groupBy(*([s.case] if per_case else []), "a", "b").agg(F.count("*").alias("n"))


def relations(log: EventLog, window: int | None = None) -> DataFrame:
    """(activity, always, sometimes, never): other activities that follow each occurrence, some, none."""
    counts = activity_distribution(log).withColumnRenamed("activity", "a").withColumnRenamed("n", "total")
    pairs = follows(log, window).where("a <> b").join(counts, "a")
    all_ = F.count("*").over(Window.partitionBy())
    others = counts.withColumn("others", all_ - 1)
    got = pairs.groupBy("a").agg(F.count_if(F.col("n") == F.col("total")).alias("always"), F.count_if(F.col("n") < F.col("total")).alias("sometimes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = others.join(got, "a", "left").select(F.col("a").alias("activity"), zero("always"), zero("sometimes"), "others")
    return out.select("activity", "always", "sometimes", (F.col("others") - F.col("always") - F.col("sometimes")).alias("never"))


def relation_entropy(log: EventLog, window: int | None = None) -> DataFrame:
    """(activity, entropy) in bits of the shares of always, sometimes and never."""
    total = F.col("always") + F.col("sometimes") + F.col("never")
    part = lambda c: F.when(F.col(c) > 0, -F.col(c) / total * F.log2(F.col(c) / total)).otherwise(0.0)
    return relations(log, window).select("activity", (part("always") + part("sometimes") + part("never")).alias("entropy"))


def j_measure(log: EventLog, window: int = 5) -> DataFrame:
    """(case, a, b, j): how much an occurrence of a tells of b in the next ``window`` events, in bits; pairs that occur.

    With p(a), p(b) the shares of the case's events and p(b|a) the share of a's occurrences that b follows:
    j = p(a) (p(b|a) log2(p(b|a)/p(b)) + (1-p(b|a)) log2((1-p(b|a))/(1-p(b)))).
    """
    c = log.spec.case
    counts = log.df.groupBy(c, as_category(log.spec.activity).alias("v")).agg(F.count("*").alias("n"))
    shares = counts.select(c, "v", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(c))).alias("p"))
    left = shares.select(c, F.col("v").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    right = shares.select(c, F.col("v").alias("b"), F.col("p").alias("pb"))
    pairs = left.join(right, c).join(follows(log, window, per_case=True), [c, "a", "b"], "left")  # activities of one case
    q = F.coalesce("n", F.lit(0)) / F.col("na")
    term = lambda x, y: F.when(x > 0, F.when(y > 0, x * F.log2(x / y)).otherwise(0.0)).otherwise(0.0)
    return pairs.select(c, "a", "b", (F.col("pa") * (term(q, F.col("pb")) + term(1 - q, 1 - F.col("pb")))).alias("j"))


def repeat_lengths(log: EventLog) -> DataFrame:
    """(activity, length): mean length of runs of one activity longer than 1, plus one, cut to a whole number.

    A case's last run isn't counted.
    """
    s, w = log.spec, log.window()
    a = as_category(s.activity)
    new = (F.row_number().over(w) == 1) | (a != F.lag(a).over(w))
    runs = log.df.select(s.case, *s.order, a.alias("activity"), new.cast("int").alias("_new")).withColumn("run", F.sum("_new").over(w))
    sizes = runs.groupBy(s.case, "run").agg(F.first("activity").alias("activity"), F.count("*").alias("n"))
    sizes = sizes.withColumn("last", F.max("run").over(Window.partitionBy(s.case))).where("run < last AND n > 1")
    return sizes.groupBy("activity").agg(F.floor(F.avg("n") + 1).cast("long").alias("length"))


# -- resources and roles ------------------------------------------------------------------------------------------------


def resource_profile(log: EventLog) -> DataFrame:
    """(resource, task, n), without zeros."""
    return log.df.groupBy(as_category(log.spec.resource).alias("resource"), as_category(log.spec.activity).alias("task")).agg(F.count("*").alias("n"))


def resource_correlation(profile: DataFrame) -> DataFrame:
    """(x, y, r), x < y: Pearson correlation of the task counts of two resources that share a task; null if one is constant.

    Pairs come from a join on the task, so a task that u resources do makes u^2 / 2 pairs: the result itself has that size.
    Pairs without a common task have r <= 0 and are left out.
    """
    tasks = profile.agg(F.count_distinct("task").alias("t"))
    sums = profile.groupBy("resource").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    a, b = profile.select(F.col("resource").alias("x"), "task", F.col("n").alias("nx")), profile.select(F.col("resource").alias("y"), "task", F.col("n").alias("ny"))
    dot = a.join(b, "task").where("x < y").groupBy("x", "y").agg(F.sum(F.col("nx") * F.col("ny")).alias("xy"))
    sx, sy = sums.toDF("x", "sx", "qx"), sums.toDF("y", "sy", "qy")
    all_ = dot.join(sx, "x").join(sy, "y").join(F.broadcast(tasks))
    t = F.col("t").cast("double")
    var = lambda s, q: F.col(q) - F.col(s) * F.col(s) / t
    scale = F.sqrt(var("sx", "qx") * var("sy", "qy"))
    return all_.select("x", "y", F.when(scale > 1e-9, (F.col("xy") - F.col("sx") * F.col("sy") / t) / scale).alias("r"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, root): smallest vertex that edges (x, y) reach; labels are halved in distance each round."""
    labels = checkpointed(vertices.select("vertex", F.col("vertex").alias("root")))
    both = checkpointed(edges.select("x", "y").union(edges.select("y", "x")).toDF("vertex", "next").distinct())
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "next"), "next").groupBy("vertex").agg(F.min("root").alias("near"))
        hop = labels.join(near, "vertex", "left").select("vertex", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        jump = labels.select(F.col("vertex").alias("mid"), F.col("root").alias("far"))
        new = checkpointed(hop.join(jump, "mid").select("vertex", "old", F.least("mid", "far").alias("root")))
        moved = new.where("old <> root").limit(1).count()
        labels = new.select("vertex", "root")
        if not moved:
            return labels


def _block_pairs(threshold: float):
    """Function of (key, rows of one block, rows of another) to (a, b, r): pairs above the threshold, by products of matrices of counts."""

    def pairs(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = one.sort_values("resource"), two.sort_values("resource")  # both sides of a block that meets itself come in any order
        known = np.unique(np.concatenate([*one["places"], *two["places"]]))
        dot = np.zeros((len(one), len(two)))
        sides = []
        for side in (one, two):
            at = np.repeat(np.arange(len(side)), [len(x) for x in side["places"]])
            sides.append((at, np.searchsorted(known, np.concatenate(side["places"].to_numpy())), np.concatenate(side["counts"].to_numpy()).astype("float64")))
        for low in range(0, len(known), WIDE):  # sums of whole numbers are exact
            dense = []
            for side, (at, place, n) in zip((one, two), sides, strict=True):
                m = np.zeros((len(side), min(WIDE, len(known) - low)))
                here = (place >= low) & (place < low + WIDE)
                m[at[here], place[here] - low] = n[here]
                dense.append(m)
            dot += dense[0] @ dense[1].T
        s, var = ([x[c].to_numpy() for x in (one, two)] for c in ("s", "var"))
        r = (dot - np.multiply.outer(s[0], s[1]) / one["t"].iloc[0]) / np.sqrt(np.multiply.outer(var[0], var[1]))
        i, j = np.nonzero(np.triu(r > threshold, 1) if key[0] == key[1] else r > threshold)
        return pd.DataFrame({"a": one["resource"].to_numpy()[i], "b": two["resource"].to_numpy()[j], "r": r[i, j]})

    return pairs


def similar_profiles(profile: DataFrame, threshold: float, tasks: DataFrame | None = None) -> DataFrame:
    """(x, y, r), x < y: pairs whose correlation is above ``threshold`` (0 or more), by products of blocks that share one of few tasks.

    With u the counts over the root of their variation and m their mean part, r = u.v - m_u m_v, and v is as long as the root of
    1 + m_v^2. Tasks are taken in one order, rare ones first; once the rest of u is so short that no v can bring the product
    above the threshold, it is left out. A pair above the threshold has its first common task among those kept of both sides,
    so only blocks of resources that share one meet; there all are compared by the whole counts. Resources of equal counts
    stand for each other and are put back at the end. ``tasks`` is one row with their number t, if there are more than in ``profile``.
    """
    t = F.col("t").cast("double")
    order = with_index(profile.groupBy("task").agg(F.count("*").alias("users")), "users", "task", name="place").select("task", "place")
    cells = profile.join(order, "task").groupBy("resource").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("cells"))
    cells = checkpointed(cells)
    groups = checkpointed(cells.groupBy("cells").agg(F.min("resource").alias("first")))
    members = checkpointed(cells.join(groups, "cells").select("first", "resource"))
    profile = groups.select(F.col("first").alias("resource"), F.explode("cells").alias("c")).select("resource", "c.place", "c.n")
    number = order.agg(F.count("*").alias("t")) if tasks is None else tasks
    sums = profile.groupBy("resource").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).join(F.broadcast(number))
    sums = sums.withColumn("var", F.col("q") - F.col("s") * F.col("s") / t).where("var > 1e-9").withColumn("m", F.col("s") / F.sqrt(t * F.col("var")))
    sums = checkpointed(sums)
    ends = sums.agg(F.min("m").alias("low"), F.max("m").alias("high"))
    rows = profile.join(sums, "resource").join(F.broadcast(ends))  # one row
    rest = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("resource").orderBy(F.desc("place"))) / F.col("var"))
    enough = lambda c: F.lit(threshold) + F.col("m") * F.col(c) - rest * F.sqrt(1 + F.col(c) * F.col(c)) >= 1e-9
    kept = rows.withColumn("out", enough("low") & enough("high")).where("NOT out").groupBy("resource").agg(F.array_sort(F.collect_list("place")).alias("kept"))
    blocks = with_index(kept.withColumn("rarest", F.col("kept")[0]), "rarest", "resource").withColumn("block", F.floor(F.col("idx") / BLOCK))
    whole = blocks.join(groups.withColumnRenamed("first", "resource"), "resource").join(sums, "resource")
    whole = checkpointed(whole.select("block", "kept", "resource", F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"), F.col("s").cast("double").alias("s"), "var", t.alias("t")))
    shared = whole.select("block", F.explode("kept").alias("place")).distinct()
    met = shared.withColumnRenamed("block", "i").join(shared.withColumnRenamed("block", "j"), "place").where("i <= j").select("i", "j").distinct()
    met, whole = checkpointed(met), whole.drop("kept")
    side = lambda c: met.join(whole.withColumnRenamed("block", c), c).select("i", "j", *whole.columns[1:]).toDF("i", "j", *whole.columns[1:])
    found = side("i").groupBy("i", "j").cogroup(side("j").groupBy("i", "j")).applyInPandas(_block_pairs(threshold), "a string, b string, r double")
    one, two = members.toDF("a", "x1"), members.toDF("b", "y1")
    apart = found.join(one, "a").join(two, "b").select(F.least("x1", "y1").alias("x"), F.greatest("x1", "y1").alias("y"), "r")
    equal = sums.select(F.col("resource").alias("first"), ((F.col("q") - F.col("s") * F.col("s") / t) / F.sqrt(F.col("var") * F.col("var"))).alias("r")).where(F.col("r") > threshold)
    alike = members.toDF("first", "x").join(members.toDF("first", "y"), "first").where("x < y").join(equal, "first").select("x", "y", "r")
    return apart.unionByName(alike)


def discover_roles(log: EventLog, similarity: float = 0.7) -> DataFrame:
    """(resource, role): roles are components of resources whose profiles correlate above ``similarity``.

    Roles are numbered by size, largest first, equal ones by their smallest member. Resources with equal shares of tasks stand
    for each other, as all who do one task only, so they make no pairs; different profiles meet by ``similar_profiles``.
    """
    profile = checkpointed(resource_profile(log))
    shares = profile.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("resource")))
    shares = shares.groupBy("resource").agg(F.array_sort(F.collect_list(F.struct("task", "share"))).alias("shares"))
    tasks = profile.agg(F.count_distinct("task").alias("t"))
    even = (F.size("shares") == F.col("t")) & (F.array_min("shares.share") == F.array_max("shares.share"))  # correlates with nobody
    stands = shares.join(F.broadcast(tasks)).where(~even)
    first = stands.groupBy("shares").agg(F.min("resource").alias("x"))
    alike = checkpointed(stands.join(first, "shares").select("x", F.col("resource").alias("y")))
    some = profile.join(alike.select(F.col("x").alias("resource")).distinct(), "resource")
    edges = alike.where("x <> y").unionByName(similar_profiles(some, similarity, tasks).select("x", "y"))
    found = components(profile.select(F.col("resource").alias("vertex")).distinct(), edges)
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    ranked = with_index(sizes.withColumn("less", -F.col("size")), "less", "root", name="place").select("root", (F.col("place") + 1).alias("role"))
    return found.join(ranked, "root").select(F.col("vertex").alias("resource"), "role")


def roles_from_column(df: DataFrame, column: str, separator: str) -> DataFrame:
    """(role, resources, n) from values ``user<separator>role``."""
    parts = F.split(F.col(column), F.lit(f"\\Q{separator}\\E"))
    return df.select(F.try_element_at(parts, F.lit(1)).alias("user"), F.try_element_at(parts, F.lit(2)).alias("role")).groupBy("role").agg(F.count_distinct("user").alias("resources"), F.count("*").alias("n"))


def role_of_tasks(log: EventLog, roles: DataFrame) -> DataFrame:
    """(task, role): the largest role number of the resources that do a task."""
    joined = log.df.select(as_category(log.spec.resource).alias("resource"), as_category(log.spec.activity).alias("task")).distinct().join(roles, "resource")
    return joined.groupBy("task").agg(F.max("role").alias("role"))


def with_roles(log: EventLog, roles: DataFrame) -> DataFrame:
    """Replace the resource by its role (null if it has none)."""
    r = log.spec.resource
    return log.df.withColumn("_r", as_category(r)).join(roles.select(F.col("resource").alias("_r"), "role"), "_r", "left").drop("_r", r).withColumnRenamed("role", r)


def pairs_of(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))
