"""Models that are tables, scores from them, and predictions."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from caselake.functions.columns import log_space
from caselake.functions.edit import edit_distance
from caselake.operators import classify, density, methods, similarity, structure, suffix
from caselake.operators import context as cx
from caselake.operators import metrics as me
from caselake.operators import model as mo
from caselake.operators import predict as pd_
from caselake.operators import prepare as pr
from caselake.operators import replay as rp
from caselake.operators import stats as st
from caselake.operators.statistics import CountStore
from caselake.plans.log import EventLog
from caselake.plans.order import checkpointed, with_index
from caselake.queries.common import dialog, events, folder, long_text, ordering, r6, shipping
from caselake.registry import query

P2 = ["activity_Prev0", "activity_Prev1"]
CTX = """WITH c AS (SELECT case_id, tie, time, activity, resource, value, coalesce(lag(activity, 1) OVER w, '0') AS p0, coalesce(lag(activity, 2) OVER w, '0') AS p1, coalesce(lag(resource, 1) OVER w, '0') AS q0 FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie))"""


def context(spark, d):
    return cx.k_context(events(spark, d), 2, ["activity", "resource"])


@query(
    CTX + """, n AS (SELECT p0 || ',' || p1 AS parents, activity AS value, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT parents, value, n, CAST(sum(n) OVER (PARTITION BY parents) AS BIGINT) AS n_parents, round(n / sum(n) OVER (PARTITION BY parents), 6) + 0.0 AS p, round(sum(n) OVER (PARTITION BY parents) / sum(n) OVER (), 6) + 0.0 AS p_parents FROM n""",
    "ev",
)
def s068_conditional_table(spark, d):
    """Counts and probabilities of an activity given the two before (68, 69)."""
    t = mo.conditional_table(context(spark, d), "activity", P2)
    return t.select(long_text("parents").alias("parents"), "value", "n", "n_parents", r6("p").alias("p"), r6("p_parents").alias("p_parents"))


@query("WITH n AS (SELECT activity || ',' || status AS parents, count(*) AS n FROM od WHERE price IS NOT NULL GROUP BY 1) SELECT parents, n AS n_parents, round(n / sum(n) OVER (), 6) + 0.0 AS p_parents FROM n", "od")
def s069_parent_probabilities(spark, d):
    """How likely each tuple of parents is: priorities with the status of an order."""
    t = mo.conditional_table(ordering(spark, d).df.where("price IS NOT NULL"), "case_id", ["activity", "status"])
    return t.select(long_text("parents").alias("parents"), "n_parents", r6("p_parents").alias("p_parents")).distinct()


@query(CTX + " SELECT round(count(DISTINCT p0 || ',' || p1) / count(*), 6) + 0.0 AS rate FROM c", "ev")
def s070_new_relation_rate(spark, d):
    return mo.new_relation_rate(context(spark, d), P2).select(r6("rate").alias("rate"))


@query(CTX + " SELECT p0 AS parents, activity AS value, count(*) AS n FROM c GROUP BY 1, 2", "ev")
def s071_update_table(spark, d):
    """Tables of two halves, added."""
    df = context(spark, d)
    old, new = (mo.conditional_table(df.where(f"tie % 2 = {i}"), "activity", P2[:1]) for i in (0, 1))
    return mo.update_table(old, new).select(long_text("parents").alias("parents"), "value", "n")


@query("SELECT resource AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM ev GROUP BY resource", "ev")
def s072_value_frequency(spark, d):
    return mo.value_frequency(events(spark, d).df, "resource").withColumn("share", r6("share"))


@query(
    """WITH n AS (SELECT resource AS parent_value, activity AS value, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY parent_value ORDER BY n DESC, value) AS k, sum(n) OVER (PARTITION BY parent_value) AS a FROM n),
    t AS (SELECT * FROM r WHERE k = 1) SELECT parent_value, value, round((SELECT (sum(a) - sum(n)) / sum(a) FROM t), 6) + 0.0 AS violation FROM t""",
    "ev",
)
def s073_dependency_table(spark, d):
    return mo.dependency_table(events(spark, d).df, "resource", "activity").withColumn("violation", r6("violation"))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM ev), b AS (SELECT CAST(least(greatest(ceil((value - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS BIGINT) AS bin FROM ev, e) SELECT CAST(bin AS VARCHAR) AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM b GROUP BY bin", "ev")
def s074_binned_frequency(spark, d):
    df = events(spark, d).df
    return mo.value_frequency(pr.discretize(df, "value", pr.bin_edges(df, "value", 10), 10, "bin"), "bin").withColumn("share", r6("share"))


STRUCTURE = {"activity": (P2, []), "resource": (["resource_Prev0"], ["activity"])}
SCORES = (
    CTX
    + """, t AS (SELECT * FROM c WHERE tie % 2 = 0), s AS (SELECT * FROM c WHERE tie % 2 = 1), n AS (SELECT count(*)::DOUBLE AS n FROM t),
    ra AS (SELECT count(DISTINCT p0 || ',' || p1) / count(*) AS r, count(DISTINCT activity) / count(*) AS v FROM t), rr AS (SELECT count(DISTINCT q0) / count(*) AS r, count(DISTINCT resource) / count(*) AS v FROM t),
    ka AS (SELECT p0, p1, count(*)::DOUBLE AS m FROM t GROUP BY 1, 2), ca AS (SELECT p0, p1, activity, count(*) AS m FROM t GROUP BY 1, 2, 3),
    kr AS (SELECT q0, count(*)::DOUBLE AS m FROM t GROUP BY 1), cr AS (SELECT q0, resource, count(*) AS m FROM t GROUP BY 1, 2),
    f AS (SELECT activity, resource, m, row_number() OVER (PARTITION BY activity ORDER BY m DESC, resource) AS k, sum(m) OVER (PARTITION BY activity) AS a FROM (SELECT activity, resource, count(*) AS m FROM t GROUP BY 1, 2)),
    fd AS (SELECT activity, resource FROM f WHERE k = 1), fv AS (SELECT (sum(a) - sum(m)) / sum(a) AS v FROM f WHERE k = 1),
    z AS (SELECT s.case_id, s.tie,
      ln(greatest((CASE WHEN ka.m IS NULL THEN ra.r ELSE (1 - ra.r) * coalesce(ca.m / ka.m, ra.r) END) * (CASE WHEN s.activity IN (SELECT activity FROM t) THEN 1 - ra.v ELSE ra.v END), 1e-10)) AS score_activity,
      ln(greatest((CASE WHEN fd.resource IS NULL OR fd.resource = s.resource THEN 1 - fv.v ELSE fv.v END) * (CASE WHEN kr.m IS NULL THEN rr.r ELSE (1 - rr.r) * coalesce(cr.m / kr.m, rr.r) END) * (CASE WHEN s.resource IN (SELECT resource FROM t) THEN 1 - rr.v ELSE rr.v END), 1e-10)) AS score_resource
      FROM s CROSS JOIN ra CROSS JOIN rr CROSS JOIN fv LEFT JOIN ka USING (p0, p1) LEFT JOIN ca ON ca.p0 = s.p0 AND ca.p1 = s.p1 AND ca.activity = s.activity LEFT JOIN kr ON kr.q0 = s.q0 LEFT JOIN cr ON cr.q0 = s.q0 AND cr.resource = s.resource LEFT JOIN fd ON fd.activity = s.activity)"""
)


def scored(spark, d):
    df = context(spark, d)
    return mo.score_events(df.where("tie % 2 = 1"), mo.train(df.where("tie % 2 = 0"), STRUCTURE))


@query(SCORES + " SELECT tie, round(score_activity, 6) + 0.0 AS score_activity, round(score_resource, 6) + 0.0 AS score_resource FROM z", "ev")
def s093_event_scores(spark, d):
    """Table look-ups on parents and value, dependencies, unknown values (93, 42, 43, 97)."""
    return scored(spark, d).select("tie", r6("score_activity").alias("score_activity"), r6("score_resource").alias("score_resource"))


@query(
    CTX + """, n AS (SELECT p0 || ',' || p1 AS parents, activity AS value, count(*)::DOUBLE AS n FROM c WHERE tie % 2 = 0 GROUP BY 1, 2), m AS (SELECT parents, sum(n) AS m FROM n GROUP BY 1)
    SELECT tie, CASE WHEN m IS NULL THEN 'no row' WHEN n IS NULL THEN 'no value' ELSE 'known' END AS found, round(coalesce(n / m, 0), 6) + 0.0 AS p FROM c LEFT JOIN m ON m.parents = p0 || ',' || p1 LEFT JOIN n ON n.parents = p0 || ',' || p1 AND n.value = activity""",
    "ev",
)
def s042_conditional_lookup(spark, d):
    """Each event looked up in a conditional table: by the tuple of its parents, then by its value."""
    df = context(spark, d)
    table = mo.conditional_table(df.where("tie % 2 = 0"), "activity", P2)
    rows = df.select("tie", mo.key_of(P2).alias("parents"), F.col("activity").alias("value"))
    found = rows.join(table.select("parents").distinct().withColumn("row", F.lit(True)), "parents", "left").join(table.select("parents", "value", "p"), ["parents", "value"], "left")
    return found.select("tie", F.when(F.col("row").isNull(), "no row").when(F.col("p").isNull(), "no value").otherwise("known").alias("found"), r6(F.coalesce("p", F.lit(0.0))).alias("p"))


@query(
    """WITH k AS (SELECT l_partkey AS part, l_suppkey AS supplier, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2), b AS (SELECT part, supplier, row_number() OVER (PARTITION BY part ORDER BY n DESC, CAST(supplier AS VARCHAR)) AS i FROM k),
    f AS (SELECT part, supplier FROM b WHERE i = 1), q AS (SELECT CASE WHEN f.part IS NULL THEN 'unknown' WHEN f.supplier = l_suppkey THEN 'as expected' ELSE 'violated' END AS found FROM lineitem LEFT JOIN f ON f.part = l_partkey WHERE l_linenumber = 1)
    SELECT found, count(*) AS n FROM q GROUP BY found"""
)
def s043_dependency_lookup(spark, d):
    """First lines of orders looked up in the table of a dependency, part to supplier, that is learned from the others."""
    df = shipping(spark, d).df
    table = mo.dependency_table(df.where("line > 1"), "part", "resource").select(F.col("parent_value").alias("_p"), F.col("value").alias("_v"))
    rows = df.where("line = 1").join(table, F.col("part").cast("string") == F.col("_p"), "left")
    found = F.when(F.col("_v").isNull(), "unknown").when(F.col("_v") == F.col("resource").cast("string"), "as expected").otherwise("violated")
    return rows.groupBy(found.alias("found")).agg(F.count("*").alias("n"))


@query(SCORES + ", r AS (SELECT case_id, round(avg(score_activity) + avg(score_resource), 6) AS score FROM z GROUP BY case_id) SELECT case_id, CAST(row_number() OVER (ORDER BY score, case_id) AS BIGINT) AS rank FROM r", "ev")
def s156_rank_of_cases(spark, d):
    """The rank of every case by its score, most anomalous first: a global order by ranges, no window over all cases."""
    scores = mo.case_scores(scored(spark, d), "case_id").select("case_id", F.round("score", 6).alias("score"))
    return with_index(scores, "score", "case_id").select("case_id", (F.col("idx") + 1).alias("rank"))


@query(CTX + ", n AS (SELECT p0 AS given, resource AS value, count(*) AS n FROM c GROUP BY 1, 2) SELECT given, arg_min(value, (-n, value)) AS likeliest, max(n) AS n FROM n GROUP BY given", "ev")
def s157_likeliest_resource(spark, d):
    """The likeliest resource after each activity; ties: the smallest."""
    table = mo.conditional_table(context(spark, d), "resource", ["activity_Prev0"]).select(F.col("parents")[0].alias("given"), "value", "p", "n")
    top = pd_.most_likely(table, ["given"])
    return top.join(table.select("given", F.col("value").alias("predicted"), "n"), ["given", "predicted"]).select("given", F.col("predicted").alias("likeliest"), "n")


@query(
    SCORES + """, m AS (SELECT case_id, avg(score_activity) AS a, avg(score_resource) AS r FROM z GROUP BY case_id), l AS (SELECT case_id, unnest(['activity', 'resource']) AS attribute, unnest([a, r]) AS score FROM m)
    SELECT attribute, round(min(score), 6) + 0.0 AS lowest, round(avg(score), 6) + 0.0 AS mean, round(max(score), 6) + 0.0 AS highest, count(*) AS cases FROM l GROUP BY attribute""",
    "ev",
)
def s163_detailed_scores(spark, d):
    """Range of the cases' scores, attribute by attribute."""
    long = mo.scores_by_attribute(mo.case_scores(scored(spark, d), "case_id"), "case_id")
    return long.groupBy("attribute").agg(r6(F.min("score")).alias("lowest"), r6(F.avg("score")).alias("mean"), r6(F.max("score")).alias("highest"), F.count("*").alias("cases"))


@query(SCORES + " SELECT 'activity' AS attribute, count(*) AS events, round(avg(score_activity), 6) + 0.0 AS score FROM z UNION ALL SELECT 'resource', count(*), round(avg(score_resource), 6) + 0.0 FROM z", "ev")
def s097_score_log(spark, d):
    """All events of a log scored, without regard to cases: the mean of each attribute."""
    rows = scored(spark, d)
    long = rows.select("tie", *mo.score_columns(rows)).unpivot("tie", mo.score_columns(rows), "attribute", "score")
    return long.groupBy(F.regexp_replace("attribute", "^score_", "").alias("attribute")).agg(F.count("*").alias("events"), r6(F.avg("score")).alias("score"))


@query(SCORES + " SELECT case_id, count(*) AS events, round(avg(score_activity), 6) + 0.0 AS score_activity, round(avg(score_resource), 6) + 0.0 AS score_resource, round(avg(score_activity) + avg(score_resource), 6) + 0.0 AS score FROM z GROUP BY case_id", "ev")
def s098_case_scores(spark, d):
    out = mo.case_scores(scored(spark, d), "case_id")
    return out.withColumns({c: r6(c) for c in ("score_activity", "score_resource", "score")})


@query(SCORES + " SELECT case_id, 'activity' AS attribute, round(avg(score_activity), 6) + 0.0 AS score FROM z GROUP BY case_id UNION ALL SELECT case_id, 'resource', round(avg(score_resource), 6) + 0.0 FROM z GROUP BY case_id", "ev")
def s099_scores_by_attribute(spark, d):
    """Detailed scores (99, 163)."""
    return mo.scores_by_attribute(mo.case_scores(scored(spark, d), "case_id"), "case_id").withColumn("score", r6("score"))


@query(SCORES + ", r AS (SELECT case_id, round(avg(score_activity) + avg(score_resource), 6) + 0.0 AS score FROM z GROUP BY case_id) SELECT case_id, score, l.label FROM r JOIN (SELECT case_id, arg_min(activity, (time, tie)) AS label FROM ev GROUP BY case_id) l USING (case_id) ORDER BY score, case_id LIMIT 10", "ev")
def s100_ranked_report(spark, d):
    scores = mo.case_scores(scored(spark, d), "case_id").withColumn("score", r6("score"))
    return mo.ranked_report(scores, pr.case_labels(events(spark, d), "activity").withColumnRenamed("activity", "label"), "case_id", "label", 10)


@query(SCORES + ", r AS (SELECT case_id, avg(score_activity) + avg(score_resource) AS score FROM z GROUP BY case_id) SELECT round(avg(score), 6) + 0.0 AS mean, round(stddev_pop(score), 6) + 0.0 AS std FROM r", "ev")
def s100_reference_level(spark, d):
    return mo.reference_level(mo.case_scores(scored(spark, d), "case_id")).select(r6("mean").alias("mean"), r6("std").alias("std"))


@query(SCORES + " SELECT tie, round(score_activity, 6) + 0.0 AS score_activity FROM z", "ev")
def s017_save_and_load_model(spark, d):
    """The tables of a model written, read and used."""
    df, at = context(spark, d), folder(spark, "model")
    mo.save(mo.train(df.where("tie % 2 = 0"), STRUCTURE), at)
    return mo.score_events(df.where("tie % 2 = 1"), mo.load(spark, at)).select("tie", r6("score_activity").alias("score_activity"))


def _family(node: str, parents: str, columns: str) -> str:
    given = columns or "1"
    return f"SELECT '{node}' AS node, '{parents}' AS parents, round(sum(n * ln(n / m)), 4) + 0.0 AS loglik, count(DISTINCT g) AS tuples FROM (SELECT {given} AS g, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {given}) AS m FROM c GROUP BY {given}, {node})"


@query(CTX + " " + _family("activity", "activity_Prev0", "p0") + " UNION ALL " + _family("activity", "activity_Prev0,activity_Prev1", "p0 || ',' || p1") + " UNION ALL " + _family("resource", "activity", "activity"), "ev")
def s088_family_scores(spark, d):
    out = structure.family_scores(context(spark, d), [("activity", ("activity_Prev0",)), ("activity", tuple(P2)), ("resource", ("activity",))])
    return out.withColumn("loglik", F.round("loglik", 4) + 0.0)


@query(
    CTX + """, a AS (SELECT sum(n * ln(n / m)) - count(DISTINCT g) AS s FROM (SELECT p0 AS g, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY p0) AS m FROM c GROUP BY p0, activity)),
    b AS (SELECT sum(n * ln(n / m)) - count(DISTINCT g) AS s FROM (SELECT p0 || ',' || p1 AS g, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY p0 || ',' || p1) AS m FROM c GROUP BY p0 || ',' || p1, activity)),
    e AS (SELECT sum(n * ln(n / m)) - 1 AS s FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS m FROM c GROUP BY activity))
    SELECT 'activity_Prev1' AS parent, 'activity' AS node, round(b.s - a.s, 4) + 0.0 AS delta FROM a, b UNION ALL SELECT 'activity_Prev0', 'activity', round(e.s - a.s, 4) + 0.0 FROM a, e""",
    "ev",
)
def s089_edge_deltas(spark, d):
    """One addition and one removal, in one job."""
    out = structure.edge_deltas(context(spark, d), {"activity": ("activity_Prev0",)}, [("activity_Prev1", "activity"), ("activity_Prev0", "activity")])
    return out.withColumn("delta", F.round("delta", 4) + 0.0)


@query(CTX + ", f AS (" + _family("activity", "x", "p0") + " UNION ALL " + _family("resource", "x", "activity") + ") SELECT round(sum(loglik), 3) + 0.0 AS loglik, CAST(sum(tuples) AS BIGINT) AS complexity FROM f", "ev")
def s091_model_score(spark, d):
    out = structure.model_score(context(spark, d), {"activity": ("activity_Prev0",), "resource": ("activity",)})
    return out.select((F.round("loglik", 3) + 0.0).alias("loglik"), "complexity")


@query(None)
def s086_generate_model(spark, d):
    """Dependencies, search and tables of the ordering log, as an edge list (86, 90)."""
    log = ordering(spark, d)
    _, edges, dependencies = structure.generate_model(log.with_df(log.df, k=1))
    rows = [(a, b, "conditional") for a, b in edges] + [(a, b, "functional") for a, b in dependencies]
    return spark.createDataFrame(rows, "parent string, child string, kind string")


@query(None)
def s092_update_model(spark, d):
    log = ordering(spark, d)
    log = log.with_df(log.df, k=1)
    nodes, edges = structure.update_model(log, [("activity_Prev0", "activity")], [])
    del nodes
    return spark.createDataFrame([(a, b) for a, b in edges], "parent string, child string")


#: Numeric columns of the shipping log: bandwidth and width of a cell.
SHIPPED = {"quantity": (4.0, 2.0), "price": (4000.0, 2000.0)}


def shipped(spark, d):
    log = shipping(spark, d)
    numbers = {c: F.col(c).cast("double") for c in SHIPPED}
    return EventLog(log.df.withColumns(numbers), replace(log.spec, categorical=("activity",), k=1))


@query(None)
def s090_mixed_search(spark, d):
    """Edges among activities, quantities and prices; numeric nodes are scored by conditional densities (90, 96)."""
    _, edges = structure.generate_mixed_model(shipped(spark, d), SHIPPED)
    return spark.createDataFrame(edges, "parent string, child string")


# -- numeric densities ---------------------------------------------------------------------------------------------------

H, DELTA = 4.0, 1.0
DENSITY = f"""WITH t AS (SELECT CAST(round(value / {DELTA}) AS BIGINT) AS bin, count(*) AS n, activity FROM ev WHERE tie % 2 = 0 GROUP BY 1, activity), m AS (SELECT activity, sum(n)::DOUBLE AS total FROM t GROUP BY 1),
    q AS (SELECT tie, activity, value AS x FROM ev WHERE tie % 2 = 1),
    p AS (SELECT q.tie, sum(n * exp(-((x - bin * {DELTA}) / {H}) * ((x - bin * {DELTA}) / {H}) / 2)) / any_value(total) / CAST({H * math.sqrt(2 * math.pi)} AS DOUBLE) AS d
    FROM q JOIN t USING (activity) JOIN m USING (activity) WHERE abs(CAST(round(x / {DELTA}) AS BIGINT) - bin) <= {math.ceil(8 * H / DELTA)} GROUP BY q.tie)"""


@query(DENSITY + " SELECT q.tie, round(ln(greatest(coalesce(d, 0), 1e-10)), 6) + 0.0 AS log_density FROM q LEFT JOIN p USING (tie)", "ev")
def s094_log_density(spark, d):
    df = events(spark, d).df
    bins = density.grid(df.where("tie % 2 = 0"), "value", ["activity"], DELTA)
    return density.log_density(df.where("tie % 2 = 1"), bins, "value", ["activity"], ["tie"], H, DELTA).withColumn("log_density", r6("log_density"))


def _conditional(rows: str, test: str, train: str, columns: list[str], widths: list[float], deltas: list[float]) -> str:
    """ln p(last column | the others), each by an exact cross join of test rows and training cells."""
    bin_ = lambda c, d: f"CAST(round({c} / {d}) AS BIGINT)"

    def sums(k: int, name: str) -> str:
        cells = ", ".join(f"{bin_(c, d)} AS b{i}" for i, (c, d) in enumerate(zip(columns[:k], deltas, strict=False)))
        squares = " + ".join(f"pow((q.{c} - b{i} * {d}) / {h}, 2)" for i, (c, d, h) in enumerate(zip(columns[:k], deltas, widths, strict=False)))
        within = " AND ".join(f"abs({bin_('q.' + c, d)} - b{i}) <= {math.ceil(8 * h / d)}" for i, (c, d, h) in enumerate(zip(columns[:k], deltas, widths, strict=False)))
        area = math.prod(h * math.sqrt(2 * math.pi) for h in widths[:k])
        return f"""{name}c AS (SELECT activity, {cells}, count(*) AS n FROM tr GROUP BY ALL), {name}t AS (SELECT activity, sum(n)::DOUBLE AS total FROM {name}c GROUP BY activity),
    {name} AS (SELECT q.tie, sum(n * exp(-({squares}) / 2)) / any_value(total) / CAST({area} AS DOUBLE) AS d FROM te q JOIN {name}c USING (activity) JOIN {name}t USING (activity) WHERE {within} GROUP BY q.tie)"""

    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""WITH rows_ AS ({rows}), tr AS (SELECT * FROM rows_ WHERE {train} AND {full}), te AS (SELECT * FROM rows_ WHERE {test} AND {full}), {sums(len(columns), "j")}, {sums(len(columns) - 1, "k")}
    SELECT rows_.tie, round(ln(greatest(coalesce(j.d / k.d, 0), 1e-10)), 6) + 0.0 AS log_density FROM rows_ LEFT JOIN j USING (tie) LEFT JOIN k USING (tie) WHERE {test}"""


TWO_PARENTS, WIDTHS, DELTAS = ["value_Prev0", "value_Prev1", "value"], [12.0, 12.0, 9.0], [4.0, 4.0, 3.0]


def lagged_values(spark, d):
    """Events with the values of the two events before them."""
    log = events(spark, d)
    w = log.window()
    return log.df.select("tie", "activity", "value", *(F.lag("value", i + 1).over(w).alias(f"value_Prev{i}") for i in range(2)))


@query(_conditional("SELECT tie, activity, value, lag(value, 1) OVER w AS value_Prev0, lag(value, 2) OVER w AS value_Prev1 FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "tie % 2 = 1", "tie % 2 = 0", TWO_PARENTS, WIDTHS, DELTAS), "ev")
def s094_two_continuous_parents(spark, d):
    """The value given the two before it, numeric parents, and the activity, a categorical one."""
    df = lagged_values(spark, d)
    node = density.numeric_node(df.where("tie % 2 = 0"), "value", TWO_PARENTS[:2], ["activity"], WIDTHS, DELTAS)
    return node.add_score(df.where("tie % 2 = 1"), "log_density").select("tie", r6("log_density").alias("log_density"))


#: Lines of a few orders are asked; equal ones once.
ASKED = "activity || '|' || CAST(quantity AS BIGINT) || '|' || CAST(round(price * 100) AS BIGINT)"
ONE_ROWS = f"SELECT DISTINCT ON (tie) * FROM (SELECT *, {ASKED} AS tie FROM sh WHERE case_id % 40 = 1) UNION ALL SELECT *, NULL FROM sh WHERE case_id % 40 <> 1"


@query(_conditional(ONE_ROWS, "tie IS NOT NULL", "tie IS NULL", ["quantity", "price"], [1.5, 900.0], [0.5, 300.0]).replace("rows_ AS (", "rows_ AS (SELECT tie, activity, quantity::DOUBLE AS quantity, price::DOUBLE AS price FROM (", 1).replace("), tr AS", ")), tr AS", 1), "sh")
def s094_one_continuous_parent(spark, d):
    """The price given the quantity, as part of event scores: a numeric node of the shipping log beside a categorical one (97)."""
    df = shipping(spark, d).df.selectExpr("case_id % 40 = 1 AS asked", "activity", "cast(quantity AS double) AS quantity", "cast(price AS double) AS price")
    train, test = df.where("NOT asked"), df.where("asked").withColumn("tie", F.expr(ASKED)).dropDuplicates(["tie"])
    nodes = mo.train(train, {"activity": ([], [])}) | {"price": density.numeric_node(train, "price", ["quantity"], ["activity"], [1.5, 900.0], [0.5, 300.0])}
    return mo.score_events(test, nodes).select("tie", r6("score_price").alias("log_density"))


BANDWIDTHS = ", ".join(f"{h!r}::DOUBLE" for h in log_space(-1.0, 1.5, 20))


@query(
    f"""WITH t AS (SELECT CAST(round(value / 2.0) AS BIGINT) AS bin, CAST(CAST('0x' || substr(md5(CAST(tie AS VARCHAR)), 1, 8) AS UBIGINT) % 2 AS BIGINT) AS fold, count(*) AS n FROM ev WHERE value IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT unnest([{BANDWIDTHS}]) AS h), o AS (SELECT fold, (SELECT sum(n) FROM t) - sum(n) AS others FROM t GROUP BY fold),
    k AS (SELECT h, a.fold, a.bin, a.n AS m, coalesce(sum(b.n * exp(-pow((a.bin - b.bin) * 2.0, 2) / (2 * h * h))), 0) AS k FROM h CROSS JOIN t a LEFT JOIN t b ON b.fold <> a.fold AND abs(a.bin - b.bin) <= {math.ceil(8 * 10**1.5 / 2)} GROUP BY ALL)
    SELECT round(h, 6) + 0.0 AS bandwidth, round(sum(m * ln(greatest(k / others / (h * sqrt(2 * pi())), 1e-10))), 3) + 0.0 AS loglik FROM k JOIN o USING (fold) GROUP BY h""",
    "ev",
)
def s095_choose_bandwidth(spark, d):
    found = density.choose_bandwidth(events(spark, d).df.select("tie", "value"), "value", 2.0, keys=["tie"])
    return found.select(r6("bandwidth").alias("bandwidth"), (F.round("loglik", 3) + 0.0).alias("loglik"))


@query(
    f"""WITH t AS (SELECT CAST(round(value / {DELTA}) AS BIGINT) AS bin, count(*) AS n, activity FROM ev GROUP BY 1, activity), m AS (SELECT activity, sum(n)::DOUBLE AS total FROM t GROUP BY 1), q AS (SELECT activity, value AS x, count(*) AS k FROM ev GROUP BY 1, 2),
    p AS (SELECT activity, x, sum(n * exp(-((x - bin * {DELTA}) / {H}) * ((x - bin * {DELTA}) / {H}) / 2)) / any_value(total) / CAST({H * math.sqrt(2 * math.pi)} AS DOUBLE) AS d
    FROM q JOIN t USING (activity) JOIN m USING (activity) WHERE abs(CAST(round(x / {DELTA}) AS BIGINT) - bin) <= {math.ceil(8 * H / DELTA)} GROUP BY activity, x)
    SELECT round(sum(k * ln(greatest(coalesce(d, 0), 1e-10))), 3) + 0.0 AS loglik, count(DISTINCT activity) AS complexity FROM q LEFT JOIN p USING (activity, x)""",
    "ev",
)
def s096_numeric_score(spark, d):
    out = density.numeric_score(events(spark, d).df, "value", ["activity"], ["tie"], H, DELTA)
    return out.select((F.round("loglik", 3) + 0.0).alias("loglik"), "complexity")


# -- predictions ---------------------------------------------------------------------------------------------------------

BACKOFF = (
    CTX
    + """, t AS (SELECT * FROM c WHERE tie % 3 <> 0 AND NOT (p0 = 'click' AND p1 = 'view') AND p1 <> 'search'), s AS (SELECT * FROM c WHERE tie % 3 = 0),
    f AS (SELECT p0, p1, activity AS value, count(*) / sum(count(*)) OVER (PARTITION BY p0, p1) AS p FROM t GROUP BY 1, 2, 3),
    a AS (SELECT p0, activity AS value, count(*) / sum(count(*)) OVER (PARTITION BY p0) AS p FROM t GROUP BY 1, 2), b AS (SELECT p1, activity AS value, count(*) / sum(count(*)) OVER (PARTITION BY p1) AS p FROM t GROUP BY 1, 2),
    z AS (SELECT activity AS value, count(*) / sum(count(*)) OVER () AS p FROM t GROUP BY 1),
    k AS (SELECT tie, activity, s.p0, s.p1, EXISTS (SELECT 1 FROM f WHERE f.p0 = s.p0 AND f.p1 = s.p1) AS exact, EXISTS (SELECT 1 FROM a WHERE a.p0 = s.p0) AS h0, EXISTS (SELECT 1 FROM b WHERE b.p1 = s.p1) AS h1 FROM s),
    o AS (SELECT tie, value, p, 1 AS parts FROM k JOIN f USING (p0, p1) WHERE exact UNION ALL SELECT tie, value, p, 1 FROM k JOIN a USING (p0) WHERE NOT exact AND h0 AND NOT h1 UNION ALL SELECT tie, value, p, 1 FROM k JOIN b USING (p1) WHERE NOT exact AND h1 AND NOT h0
    UNION ALL SELECT tie, value, p, 1 FROM k, z WHERE NOT h0 AND NOT h1 UNION ALL SELECT tie, value, p, 2 FROM k JOIN b USING (p1) WHERE NOT exact AND h0 AND h1 UNION ALL SELECT tie, value, p, 2 FROM k JOIN a USING (p0) WHERE NOT exact AND h0 AND h1),
    d AS (SELECT tie, value, sum(p) / any_value(parts) AS p FROM o GROUP BY tie, value),
    r AS (SELECT k.tie, k.activity AS expected, (SELECT value FROM d WHERE d.tie = k.tie ORDER BY round(p, 12) DESC, value LIMIT 1) AS predicted, coalesce((SELECT p FROM d WHERE d.tie = k.tie AND d.value = k.activity), 0) AS p_expected, (SELECT max(p) FROM d WHERE d.tie = k.tie) AS p_predicted FROM k)"""
)


def halves(spark, d):
    df = context(spark, d)
    return df.where("tie % 3 <> 0 AND NOT (activity_Prev0 = 'click' AND activity_Prev1 = 'view') AND activity_Prev1 <> 'search'"), df.where("tie % 3 = 0")


def predicted(spark, d):
    train, test = halves(spark, d)
    return pd_.next_event(train, test, "activity", P2, ["tie"])


@query(BACKOFF + " SELECT tie, expected, predicted, round(p_expected, 6) + 0.0 AS p_expected, round(p_predicted, 6) + 0.0 AS p_predicted FROM r", "ev")
def s103_next_event(spark, d):
    """All three kinds of back-off occur: some pairs and one value are kept out of training (103, 157)."""
    return predicted(spark, d).withColumns({c: r6(c) for c in ("p_expected", "p_predicted")})


@query(BACKOFF + ", e AS (SELECT tie, activity AS expected FROM s), y AS (SELECT tie, value, p FROM d UNION ALL SELECT tie, z.value, z.p FROM s, z), v AS (SELECT tie, value, sum(p) / 2 AS p FROM y GROUP BY 1, 2) SELECT tie, (SELECT value FROM v WHERE v.tie = e.tie ORDER BY round(p, 12) DESC, value LIMIT 1) AS predicted FROM e", "ev")
def s104_average_of_models(spark, d):
    train, test = halves(spark, d)
    models = [pd_.predict(test, pd_.backoff_tables(train, "activity", p), p, ["tie"]) for p in (P2, [])]
    return pd_.most_likely(pd_.average_models(models, ["tie"]), ["tie"]).select("tie", "predicted")


@query(
    """WITH f AS (SELECT case_id, tie, time, activity, CASE WHEN max(value) OVER (PARTITION BY case_id) > 200 THEN 'high' ELSE 'low' END AS label FROM ev),
    n AS (SELECT activity, label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY activity) AS p FROM f WHERE case_id % 2 = 0 GROUP BY 1, 2), v AS (SELECT case_id, n.label AS value, round(sum(p), 12) AS p FROM f JOIN n USING (activity) WHERE case_id % 2 = 1 GROUP BY 1, 2)
    SELECT case_id, any_value(f.label) AS expected, (SELECT value FROM v WHERE v.case_id = f.case_id ORDER BY p DESC, value LIMIT 1) AS predicted FROM f WHERE case_id % 2 = 1 GROUP BY case_id""",
    "ev",
)
def s114_outcome(spark, d):
    from pyspark.sql import Window

    df = events(spark, d).df.withColumn("label", F.when(F.max("value").over(Window.partitionBy("case_id")) > 200, "high").otherwise("low"))
    return pd_.predict_outcome(df.where("case_id % 2 = 0"), df.where("case_id % 2 = 1"), "label", ["activity"], ["tie"], "case_id")


@query(
    CTX + """, e AS (SELECT *, weekofyear(time) AS batch FROM c), t AS (SELECT x.batch, y.p0, y.p1, y.activity AS value, count(*) AS n FROM (SELECT DISTINCT batch FROM e) x JOIN e y ON y.batch < x.batch GROUP BY 1, 2, 3, 4),
    b AS (SELECT batch, p0, p1, arg_min(value, (-n, value)) AS v FROM t GROUP BY 1, 2, 3), m AS (SELECT batch, arg_min(value, (-n, value)) AS v FROM (SELECT batch, value, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1)
    SELECT CAST(e.batch AS INTEGER) AS batch, round(avg(CAST(e.activity = coalesce(b.v, m.v, '0') AS INTEGER)), 6) + 0.0 AS accuracy FROM e LEFT JOIN b ON b.batch = e.batch AND b.p0 = e.p0 AND b.p1 = e.p1 LEFT JOIN m ON m.batch = e.batch GROUP BY e.batch""",
    "ev",
)
def s105_predict_then_update(spark, d):
    """Each week is predicted by the counts of the weeks before and then added to them."""
    df = context(spark, d).withColumn("batch", F.weekofyear("time"))
    return me.accuracy(rp.test_then_train(df, "activity", P2, ["tie"]), ["batch"]).withColumn("accuracy", r6("accuracy"))


@query(None)
def s106_predict_then_relearn(spark, d):
    """The parents of the activity are searched again on each week's data, then its table is learned again.

    All weeks after the first are predicted; any attribute's history may be a parent.
    """
    # the weeks before are in the store as counts, so a week costs its own rows, which are read twice
    df = checkpointed(context(spark, d).withColumn("batch", F.weekofyear("time")))
    weeks = [r[0] for r in df.select("batch").distinct().orderBy("batch").collect()]  # calendar weeks
    log = events(spark, d)
    allowed = [(f"{a}_Prev{i}", "activity") for a in log.attributes() for i in range(log.spec.k)]
    store, edges, at = CountStore(spark, {c for e in allowed for c in e}), [], folder(spark, "weeks")
    for i, w in enumerate(weeks):
        week, parents = df.where(F.col("batch") == w), [a for a, _ in edges]
        if i:
            tables = checkpointed(pd_.backoff_tables(store.counts(["activity", *parents]), "activity", parents, "_rows"))  # used several times
            found = pd_.results(week, pd_.predict(week, tables, parents, ["tie"]), "activity", ["tie"])
            me.accuracy(found).select(F.lit(w).alias("batch"), F.lit(",".join(parents)).alias("parents"), "accuracy").write.mode("append").parquet(at)
        store.add(week)
        edges = structure.learn_from_counts(store, allowed, start=edges)
    return spark.read.schema("batch int, parents string, accuracy double").parquet(at)


def suffixes(log, parents, k):
    """Cases of odd numbers rolled forward from every prefix by a model of the even ones, with bounded repeats."""
    train = log.with_df(log.df.where("case_id % 2 = 0"))
    context_ = cx.k_context(train, k, list(parents))
    found = suffix.predict_suffixes(log.with_df(log.df.where("case_id % 2 = 1")), context_, parents, st.repeat_lengths(train), k, longest=100)
    return pd_.suffix_similarity(found).select("case_id", "prefix_size", long_text("predicted").alias("predicted"), r6("similarity").alias("similarity"))


@query(None)
def s108_suffixes(spark, d):
    """Roles of a conversation, given the last two (108, 110)."""
    return suffixes(cx.add_end_events(dialog(spark, d)), {"activity": P2}, 2)


@query(None)
def s108_suffixes_of_all_attributes(spark, d):
    """Priorities of a customer's orders, given the last one and its status, which is rolled forward too."""
    log = cx.add_end_events(ordering(spark, d))
    return suffixes(log, {"activity": ["activity_Prev0", "status_Prev0"], "status": ["activity", "status_Prev0"]}, 1)


@query(
    """WITH p AS (SELECT case_id, row_number() OVER w AS prefix_size, list(activity) OVER (PARTITION BY case_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a, list(activity) OVER w AS b FROM di WINDOW w AS (PARTITION BY case_id ORDER BY turn))
    SELECT case_id, prefix_size, round(1 - levenshtein(list_aggregate(list_transform(coalesce(a, []), lambda x: chr(CAST(64 + list_position(v, x) AS INTEGER))), 'string_agg', ''), list_aggregate(list_transform(b, lambda x: chr(CAST(64 + list_position(v, x) AS INTEGER))), 'string_agg', '')) / greatest(len(coalesce(a, [])), len(b)), 6) + 0.0 AS levenshtein,
    round(len(list_intersect(list_distinct(coalesce(a, [])), list_distinct(b))) / len(list_distinct(list_concat(coalesce(a, []), b))), 6) + 0.0 AS jaccard FROM p, (SELECT list(DISTINCT activity ORDER BY activity) AS v FROM di) WHERE len(coalesce(a, [])) > 0""",
    "di",
)
def s111_text_similarity(spark, d):
    """Prefix against suffix, with a letter for each activity, and as sets."""
    p = cx.prefixes_and_suffixes(dialog(spark, d)).where(F.size("suffix") > 0)
    out = pd_.text_similarity(p, "suffix", "prefix")
    return out.select("case_id", "prefix_size", r6("levenshtein").alias("levenshtein"), r6("jaccard").alias("jaccard"))


def _rows_of_distances(cost: str) -> str:
    """The table of distances of pairs p (case_id, a, b), row by row: d holds row i of it, from 1, and the row before.

    ``cost`` is what keeping or replacing a[i] by b[j] costs; {j} stands for the place in b.
    """
    j = "CAST(x[1] AS INTEGER)"
    keep = cost.format(j=j)
    return f"""d AS (SELECT case_id, 1 AS i, list_transform(range(0, len(b) + 1), lambda j: CAST(j AS DOUBLE)) AS last, CAST(NULL AS DOUBLE[]) AS before FROM p
        UNION ALL
        SELECT case_id, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS DOUBLE)]), lambda r, x: list_append(r, least(
            last[{j} + 1] + 1, r[len(r)] + 1, last[{j}] + {keep},
            CASE WHEN i > 1 AND x[1] > 1 AND a[i] = b[{j} - 1] AND a[i - 1] = b[{j}] THEN before[{j} - 1] + {keep} END)), [CAST(i AS DOUBLE)]), last
        FROM d JOIN p USING (case_id) WHERE i <= len(a)),
    r AS (SELECT case_id, 1 - last[len(last)] / greatest(len(a), len(b)) AS similarity FROM d JOIN p USING (case_id) WHERE i = len(a) + 1)"""


@query(
    """WITH RECURSIVE t AS (SELECT case_id, list(activity ORDER BY turn)[2:] AS s FROM di GROUP BY case_id HAVING count(*) > 1),
    p AS (SELECT t.case_id, t.s AS a, o.s AS b FROM t JOIN t o ON o.case_id = t.case_id + 1), """
    + _rows_of_distances("CASE WHEN a[i] = b[{j}] THEN 0 ELSE 1 END") + " SELECT case_id, round(similarity, 6) + 0.0 AS similarity FROM r",
    "di",
)
def s110_suffix_similarity(spark, d):
    """What follows the first turn of a conversation against what follows that of the next one, as if that were predicted."""
    t = cx.traces(dialog(spark, d)).where(F.size("activity") > 1).select("case_id", F.slice("activity", 2, F.size("activity") - 1).alias("suffix"))
    both = t.join(t.select((F.col("case_id") - 1).alias("case_id"), F.col("suffix").alias("predicted")), "case_id")
    return pd_.suffix_similarity(both).select("case_id", r6("similarity").alias("similarity"))


@query(
    """WITH RECURSIVE x AS (SELECT case_id, time, tie, activity, coalesce((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6, 0) AS gap FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    t AS (SELECT case_id, list(activity ORDER BY time, tie) AS a, list(gap ORDER BY time, tie) AS g, row_number() OVER (ORDER BY case_id) AS i FROM x GROUP BY case_id),
    p AS (SELECT u.case_id, u.a, u.g, v.a AS b, v.g AS h, nullif(greatest(list_max(u.g), list_max(v.g)), 0) AS most FROM t u JOIN t v ON v.i = u.i + 1), """
    + _rows_of_distances("CASE WHEN a[i] = b[{j}] THEN coalesce(abs(g[i] - h[{j}]) / most, 0) ELSE 1 END") + " SELECT case_id, round(similarity, 6) + 0.0 AS similarity FROM r",
    "ev",
)
def s112_timed_similarity(spark, d):
    """Each case against the next one in order of their ids (112)."""
    log = events(spark, d)
    w = log.window()
    gap = F.coalesce((F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.lag("time").over(w).cast("timestamp"))) / 1e6, F.lit(0.0))
    t = cx.traces(log.with_df(log.df.withColumn("gap", gap)), ["activity", "gap"])
    t = with_index(t, "case_id")
    both = t.join(t.select((F.col("idx") - 1).alias("idx"), F.col("activity").alias("a2"), F.col("gap").alias("g2")), "idx")
    return pd_.timed_similarity(both, "activity", "a2", "gap", "g2").select("case_id", r6("similarity").alias("similarity"))


#: Conversations as text, a letter for a role, so that distances can be said in SQL.
LETTERS = """WITH t AS (SELECT case_id, string_agg(CASE activity WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 's' END, '' ORDER BY turn) AS t, string_agg(activity, ',' ORDER BY turn) AS names FROM di GROUP BY case_id)"""


@query(
    LETTERS + """, v AS (SELECT names, any_value(t) AS t, count(*) AS cases FROM t WHERE case_id % 2 = 0 GROUP BY names), o AS (SELECT DISTINCT names, t FROM t WHERE case_id % 2 = 1),
    p AS (SELECT v.names AS variant, v.cases, o.names AS nearest, damerau_levenshtein(v.t, o.t) AS distance, greatest(length(v.t), length(o.t)) AS size, string_split(o.names, ',') AS items FROM v CROSS JOIN o),
    r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY distance, items) AS i FROM p)
    SELECT variant, cases, nearest, CAST(distance AS DOUBLE) AS distance, round(1 - distance / size, 6) + 0.0 AS similarity FROM r WHERE i = 1""",
    "di",
)
def s046_nearest_variants(spark, d):
    """Nearest variant among the other half of the cases."""
    t = cx.traces(dialog(spark, d))
    out = similarity.nearest_variants(t.where("case_id % 2 = 0"), t.where("case_id % 2 = 1"))
    return out.select(long_text("variant").alias("variant"), "cases", long_text("nearest").alias("nearest"), "distance", r6("similarity").alias("similarity"))


@query(None)
def s113_similarity_of_logs(spark, d):
    """Customers' orders of one half matched with those of the other, each used once; times are days between orders."""
    log = ordering(spark, d)
    day = F.datediff(F.col("time").cast("date"), F.lag(F.col("time").cast("date")).over(log.window()))
    t = cx.traces(log.with_df(log.df.withColumn("gap", F.coalesce(day, F.lit(0)).cast("double"))), ["activity", "gap", "time"]).withColumn("start", F.col("time")[0])
    out = similarity.match_logs(t.where("case_id % 2 = 0"), t.where("case_id % 2 = 1"))
    return out.select("case_id", "other_case", "distance", r6("similarity").alias("similarity"), r6("timed_similarity").alias("timed_similarity"), "time_error")


@query(
    LETTERS + " SELECT t.case_id, CAST(damerau_levenshtein(t.t, o.t) AS DOUBLE) AS distance FROM t JOIN t o ON o.case_id = t.case_id + 1",
    "di",
)
def s197_edit_distance(spark, d):
    """Each conversation against the next one."""
    t = cx.traces(dialog(spark, d))
    both = t.join(t.select((F.col("case_id") - 1).alias("case_id"), F.col("activity").alias("other")), "case_id")
    return both.select("case_id", edit_distance("activity", "other", free=True).alias("distance"))


@query(None)
def s115_linear_classifier(spark, d):
    df = context(spark, d)
    model = classify.train_linear(df.where("tie % 3 <> 0"), "activity", P2)
    return classify.test_linear(model, df.where("tie % 3 = 0"), "activity", P2, ["tie"]).select("tie", "expected", "predicted")


@query(None)
def s116_updated_classifier(spark, d):
    """Each week is predicted by a classifier fitted on the week before, and by one on all weeks before; accuracy of both (116)."""
    df = checkpointed(context(spark, d).withColumn("batch", F.weekofyear("time")))
    found = None
    for kept in (1, None):
        results = classify.test_and_update(df, "batch", "activity", P2, ["tie", "batch"], kept)
        part = me.accuracy(results, ["batch"]).select("batch", F.lit("last" if kept else "all").alias("kept"), r6("accuracy").alias("accuracy"))
        found = part if found is None else found.unionByName(part)
    return found


@query(None)
def s117_embeddings(spark, d):
    found = classify.co_occurrence_embedding(events(spark, d).df, "activity", "resource")
    return found.select("kind", "value", F.posexplode("embedding").alias("dimension", "weight"))


@query(BACKOFF + ", q AS (SELECT *, row_number() OVER (PARTITION BY tie ORDER BY p DESC, value) AS k FROM (SELECT d.tie, d.value, round(d.p, 12) AS p, s.activity FROM d JOIN s USING (tie))), h AS (SELECT tie, max(CASE WHEN k <= 2 AND value = activity THEN 1 ELSE 0 END) AS hit FROM q GROUP BY tie) SELECT round(avg(hit), 6) + 0.0 AS accuracy FROM h", "ev")
def s118_top_two_accuracy(spark, d):
    train, test = halves(spark, d)
    p = pd_.predict(test, pd_.backoff_tables(train, "activity", P2), P2, ["tie"]).withColumn("p", F.round("p", 12))
    return me.top_accuracy(p.join(test.select("tie", F.col("activity").alias("expected")), "tie"), ["tie"]).select(r6("accuracy").alias("accuracy"))


@query(BACKOFF + " SELECT expected, predicted, count(*) AS n FROM r WHERE expected <> predicted GROUP BY 1, 2", "ev")
def s118_mistakes(spark, d):
    return me.confusion(predicted(spark, d), mistakes_only=True)


@query(
    """WITH c AS (SELECT tie, activity, coalesce((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6, 0) AS s, coalesce(lag(activity) OVER w, '0') AS p0 FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    m AS (SELECT p0, avg(s) AS m FROM c WHERE tie % 2 = 0 GROUP BY 1) SELECT activity, round(avg(abs(s - coalesce(m, (SELECT avg(s) FROM c WHERE tie % 2 = 0)))), 3) + 0.0 AS mae, count(*) AS n FROM c LEFT JOIN m USING (p0) WHERE tie % 2 = 1 GROUP BY activity""",
    "ev",
)
def s119_duration_error(spark, d):
    log = events(spark, d)
    df = cx.k_context(log.with_df(cx.duration_context(log, 1)), 1, ["activity"])
    r = pd_.mean_duration(df.where("tie % 2 = 0"), df.where("tie % 2 = 1"), "duration_0", ["activity_Prev0"], ["tie", "activity"])
    return pd_.absolute_error(r, ["activity"]).withColumn("mae", F.round("mae", 3) + 0.0)


FOLDS = CTX + """, g AS (SELECT *, ntile(3) OVER (ORDER BY time, tie, case_id) - 1 AS fold FROM c), t AS (SELECT k.fold, p0, activity AS value, count(*) AS n FROM g JOIN (SELECT DISTINCT fold FROM g) k ON g.fold <> k.fold GROUP BY 1, 2, 3),
    b AS (SELECT fold, p0, arg_min(value, (-n, value)) AS predicted FROM t GROUP BY 1, 2),
    m AS (SELECT fold, arg_min(value, (-n, value)) AS predicted FROM (SELECT fold, value, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1)"""


@query(
    BACKOFF + """, m AS (SELECT expected AS c, count(*)::DOUBLE AS n FROM r GROUP BY 1), q AS (SELECT predicted AS c, count(*)::DOUBLE AS n, count_if(expected = predicted)::DOUBLE AS hit FROM r GROUP BY 1)
    SELECT 'accuracy' AS metric, round(avg(CAST(expected = predicted AS INTEGER)), 6) + 0.0 AS value FROM r UNION ALL SELECT 'brier', round(avg(1 - p_expected), 6) + 0.0 FROM r
    UNION ALL SELECT 'precision', round(sum(m.n * hit / q.n) / (SELECT count(*) FROM r), 6) + 0.0 FROM q JOIN m USING (c) UNION ALL SELECT 'recall', round(sum(m.n * coalesce(hit, 0) / m.n) / (SELECT count(*) FROM r), 6) + 0.0 FROM m LEFT JOIN q USING (c)""",
    "ev",
)
def s195_registered_metrics(spark, d):
    """Every metric of the registry on one set of predictions, as a user adds them by name."""
    found = checkpointed(predicted(spark, d))
    out = None
    for name, metric in methods.METRICS.items():
        value = metric(found)
        row = value.select(F.lit(name).alias("metric"), r6(F.col(value.columns[-1])).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query(BACKOFF + " SELECT 'counts' AS method, count(*) AS predictions, round(avg(CAST(expected = predicted AS INTEGER)), 6) + 0.0 AS accuracy FROM r", "ev")
def s194_registered_method(spark, d):
    """A method of the registry by its name: train on some events, test on the others."""
    train, test = halves(spark, d)
    method = methods.METHODS["counts"]
    found = method.test(method.train(train), test, ["tie"])
    return found.agg(F.lit("counts").alias("method"), F.count("*").alias("predictions"), r6(F.avg((F.col("expected") == F.col("predicted")).cast("int"))).alias("accuracy"))


@query(FOLDS + " SELECT g.fold, round(avg(CAST(g.activity = coalesce(b.predicted, m.predicted) AS INTEGER)), 6) + 0.0 AS accuracy FROM g LEFT JOIN b ON g.fold = b.fold AND g.p0 = b.p0 LEFT JOIN m ON m.fold = g.fold GROUP BY g.fold", "ev")
def s142_cross_validation(spark, d):
    """Three folds of the registered method of counts, context 1 (142, 194, 195)."""
    from dataclasses import replace

    log = events(spark, d)
    folded = pr.folds(log.with_df(cx.k_context(log, 1, ["activity"])), 3)
    return methods.cross_validate(replace(methods.METHODS["counts"], parameters={"k": 1}), folded, 3, ["tie"]).withColumn("accuracy", r6("accuracy"))


def entry(spark, d):
    """Flagship: next activity given the two before, learned on two thirds, accuracy on the rest."""
    df = context(spark, d)
    return me.accuracy(pd_.next_event(df.where("tie % 3 <> 0"), df.where("tie % 3 = 0"), "activity", P2, ["tie"]))
