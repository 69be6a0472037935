"""What a log looks like: sizes, entropy, dependencies, relations, roles, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import graph as gr
from caselake.operators import stats as st
from caselake.plans.log import EventLog, LogSpec
from caselake.queries.common import dialog, events, ordering, r6, shipping
from caselake.registry import query


@query(
    """WITH c AS (SELECT case_id, count(*) AS n FROM ev GROUP BY case_id)
    SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS cases, round(avg(n), 6) + 0.0 AS avg_case_length, max(n) AS max_case_length, min(n) AS min_case_length, (SELECT count(DISTINCT activity) FROM ev) AS activities FROM c""",
    "ev",
)
def s052_characteristics(spark, d):
    return st.characteristics(events(spark, d)).withColumn("avg_case_length", r6("avg_case_length"))


@query(
    """WITH a AS (SELECT 'activity' AS attribute, count(DISTINCT activity) AS "values" FROM od UNION ALL SELECT 'status', count(DISTINCT coalesce(status, 'nan')) FROM od)
    SELECT attribute, "values", min("values") OVER () AS lowest, max("values") OVER () AS highest FROM a""",
    "od",
)
def s053_attribute_dimensions(spark, d):
    return st.attribute_dimensions(ordering(spark, d))


@query("SELECT activity, count(*) AS n FROM sh GROUP BY activity", "sh")
def s054_activity_distribution(spark, d):
    return st.activity_distribution(shipping(spark, d))


@query("WITH v AS (SELECT case_id, string_agg(activity, '>' ORDER BY time, line, part, resource, quantity, price) AS variant, count(*) AS length FROM sh GROUP BY case_id) SELECT variant, count(*) AS cases, min(length) AS length FROM v GROUP BY variant", "sh")
def s055_variants(spark, d):
    return st.variants(shipping(spark, d))


@query("SELECT activity, count(*) AS cases FROM (SELECT case_id, arg_min(activity, turn) AS activity FROM di GROUP BY case_id) GROUP BY activity", "di")
def s056_first_activities(spark, d):
    return st.first_activities(dialog(spark, d))


ROLES = "WITH r AS (SELECT resource, CAST(resource AS BIGINT) % 4 AS role FROM (SELECT DISTINCT coalesce(resource, 'nan') AS resource FROM ev))"


def numbered_roles(spark, d):
    """A given assignment of resources to roles."""
    return events(spark, d).df.select(F.coalesce("resource", F.lit("nan")).alias("resource")).distinct().withColumn("role", F.expr("CAST(resource AS BIGINT) % 4"))


@query(ROLES + " SELECT tie, role AS resource FROM ev LEFT JOIN r USING (resource)", "ev")
def s037_resource_to_role(spark, d):
    """Left join of events and roles (37, 41)."""
    return st.with_roles(events(spark, d), numbered_roles(spark, d)).select("tie", "resource")


@query(ROLES + " SELECT activity AS task, max(role) AS role FROM ev JOIN r USING (resource) GROUP BY activity", "ev")
def s057_role_of_tasks(spark, d):
    return st.role_of_tasks(events(spark, d), numbered_roles(spark, d))


def _entropy(column: str, table: str) -> str:
    return f"SELECT '{column}' AS \"column\", round(-sum(n / t * ln(n / t)), 6) + 0.0 AS entropy FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM {table} GROUP BY {column})"


@query(_entropy("activity", "ev") + " UNION ALL " + _entropy("resource", "ev"), "ev")
def s058_entropy(spark, d):
    return st.entropy(events(spark, d).df, ["activity", "resource"]).select("column", r6("entropy").alias("entropy"))


MI = """WITH j AS (SELECT activity AS x, status AS y, count(*)::DOUBLE AS n FROM od GROUP BY 1, 2),
    m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j),
    v AS (SELECT sum(n / t * ln(n * t / (nx * ny))) AS mi, -sum(n / t * ln(nx / t)) AS hx, -sum(n / t * ln(ny / t)) AS hy FROM m)"""


@query(MI + " SELECT 'activity' AS x, 'status' AS y, round(hx, 6) + 0.0 AS hx, round(hy, 6) + 0.0 AS hy, round(mi, 6) + 0.0 AS mi FROM v", "od")
def s059_mutual_information(spark, d):
    return st.mutual_information(ordering(spark, d).df, [("activity", "status")]).select("x", "y", r6("hx").alias("hx"), r6("hy").alias("hy"), r6("mi").alias("mi"))


@query(MI + " SELECT round(mi / hy, 6) + 0.0 AS uncertainty, mi / hy >= 0.99 AS mapped FROM v", "od")
def s060_uncertainty_coefficient(spark, d):
    m = st.mutual_information(ordering(spark, d).df, [("activity", "status")])
    return m.select(r6("uncertainty").alias("uncertainty"), (F.col("uncertainty") >= 0.99).alias("mapped"))


@query("SELECT 'activity' AS parent, 'flag' AS child, 1.0::DOUBLE AS uncertainty FROM sh UNION SELECT 'activity', 'state', 1.0::DOUBLE FROM sh", "sh")
def s061_functional_dependencies(spark, d):
    """Activity is made of flag and state, so it determines both; neither determines it."""
    df = shipping(spark, d).df.withColumn("flag", F.substring("activity", 1, 1)).withColumn("state", F.substring("activity", 2, 1))
    found = st.functional_dependencies(df, ["activity", "flag", "state"], ["activity", "flag", "state"])
    return found.select("parent", "child", r6("uncertainty").alias("uncertainty"))


@query("SELECT 'activity' AS \"column\", round(count(DISTINCT activity) / count(*), 6) + 0.0 AS rate FROM ev UNION ALL SELECT 'resource', round(count(DISTINCT coalesce(resource, 'nan')) / count(*), 6) + 0.0 FROM ev", "ev")
def s062_new_value_rate(spark, d):
    return st.new_value_rate(events(spark, d).df, ["activity", "resource"]).select("column", r6("rate").alias("rate"))


@query(
    """WITH f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY resource ORDER BY time, tie, case_id) = 1 THEN 1 ELSE 0 END AS n FROM ev)
    SELECT tie, row_number() OVER o AS position, round(sum(n) OVER o / row_number() OVER o, 6) + 0.0 AS rate FROM f WINDOW o AS (ORDER BY time, tie, case_id)""",
    "ev",
)
def s063_running_new_value_rate(spark, d):
    return st.running_new_value_rate(events(spark, d), "resource").select("tie", "position", r6("rate").alias("rate"))


FOLLOWS = """WITH o AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY time, tie) AS i FROM ev),
    f AS (SELECT DISTINCT x.case_id, x.i, x.activity AS a, y.activity AS b FROM o x JOIN o y ON x.case_id = y.case_id AND y.i > x.i AND y.i <= x.i + {w})"""


@query(FOLLOWS.format(w=3) + " SELECT a, b, count(*) AS n FROM f GROUP BY a, b", "ev")
def s064_follows(spark, d):
    return st.follows(events(spark, d), 3)


@query(FOLLOWS.format(w=1_000_000) + " SELECT a, b, count(*) AS n FROM f GROUP BY a, b", "ev")
def s064_eventually_follows(spark, d):
    return st.follows(events(spark, d))


@query(FOLLOWS.format(w=1) + " SELECT a, b, count(*) AS n FROM f GROUP BY a, b", "ev")
def s044_directly_follows(spark, d):
    """Next events of a case (44)."""
    return st.follows(events(spark, d), 1)


RELATIONS = """, c AS (SELECT activity AS a, count(*) AS total FROM ev GROUP BY 1), p AS (SELECT a, b, count(*) AS n FROM f WHERE a <> b GROUP BY a, b),
    r AS (SELECT c.a AS activity, count(*) FILTER (WHERE n = total) AS always, count(*) FILTER (WHERE n < total) AS sometimes, (SELECT count(*) FROM c) - 1 AS others FROM c LEFT JOIN p USING (a) GROUP BY c.a)"""


@query(FOLLOWS.format(w=2) + RELATIONS + " SELECT activity, always, sometimes, others - always - sometimes AS never FROM r", "ev")
def s065_relations(spark, d):
    return st.relations(events(spark, d), 2)


@query(
    FOLLOWS.format(w=2) + RELATIONS + """, q AS (SELECT activity, always, sometimes, others - always - sometimes AS never, others::DOUBLE AS t FROM r)
    SELECT activity, round(CASE WHEN always > 0 THEN -always / t * log2(always / t) ELSE 0 END + CASE WHEN sometimes > 0 THEN -sometimes / t * log2(sometimes / t) ELSE 0 END + CASE WHEN never > 0 THEN -never / t * log2(never / t) ELSE 0 END, 6) + 0.0 AS entropy FROM q""",
    "ev",
)
def s066_relation_entropy(spark, d):
    return st.relation_entropy(events(spark, d), 2).select("activity", r6("entropy").alias("entropy"))


@query(
    FOLLOWS.format(w=5) + """, n AS (SELECT case_id, activity, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id) AS p FROM n),
    g AS (SELECT case_id, a, b, count(*) AS m FROM f GROUP BY 1, 2, 3),
    q AS (SELECT x.case_id, x.activity AS a, y.activity AS b, x.p AS pa, y.p AS pb, coalesce(m, 0) / x.n AS q FROM s x JOIN s y USING (case_id) LEFT JOIN g ON g.case_id = x.case_id AND g.a = x.activity AND g.b = y.activity)
    SELECT case_id, a, b, round(pa * (CASE WHEN q > 0 AND pb > 0 THEN q * log2(q / pb) ELSE 0 END + CASE WHEN 1 - q > 0 AND 1 - pb > 0 THEN (1 - q) * log2((1 - q) / (1 - pb)) ELSE 0 END), 6) + 0.0 AS j FROM q""",
    "ev",
)
def s067_j_measure(spark, d):
    return st.j_measure(events(spark, d)).select("case_id", "a", "b", r6("j").alias("j"))


@query(
    """WITH l AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(activity) OVER w <> activity THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY case_id ORDER BY time, tie) AS run FROM l), g AS (SELECT case_id, run, any_value(activity) AS activity, count(*) AS c FROM r GROUP BY 1, 2),
    m AS (SELECT *, max(run) OVER (PARTITION BY case_id) AS last FROM g) SELECT activity, CAST(floor(avg(c) + 1) AS BIGINT) AS length FROM m WHERE run < last AND c > 1 GROUP BY activity""",
    "ev",
)
def s075_repeat_lengths(spark, d):
    return st.repeat_lengths(events(spark, d))


@query("SELECT coalesce(resource, 'nan') AS resource, activity AS task, count(*) AS n FROM ev GROUP BY 1, 2", "ev")
def s076_resource_profile(spark, d):
    return st.resource_profile(events(spark, d))


@query(
    """WITH p AS (SELECT resource, activity AS task, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2), t AS (SELECT count(DISTINCT task)::DOUBLE AS t FROM p), s AS (SELECT resource, sum(n) AS s, sum(n * n) AS q FROM p GROUP BY 1),
    d AS (SELECT a.resource AS x, b.resource AS y, sum(a.n * b.n) AS xy FROM p a JOIN p b USING (task) WHERE a.resource < b.resource GROUP BY 1, 2)
    SELECT x, y, round(CASE WHEN sqrt((u.q - u.s * u.s / t) * (v.q - v.s * v.s / t)) > 1e-9 THEN (xy - u.s * v.s / t) / sqrt((u.q - u.s * u.s / t) * (v.q - v.s * v.s / t)) END, 6) + 0.0 AS r
    FROM d JOIN s u ON u.resource = x JOIN s v ON v.resource = y, t""",
    "ev",
)
def s077_resource_correlation(spark, d):
    """Pairs of resources that share a task (77, 45)."""
    return st.resource_correlation(st.resource_profile(events(spark, d))).select("x", "y", r6("r").alias("r"))


@query(
    """WITH p AS (SELECT resource, part % 20 AS task, count(*)::DOUBLE AS n FROM sh GROUP BY 1, 2), t AS (SELECT count(DISTINCT task)::DOUBLE AS t FROM p), s AS (SELECT resource, sum(n) AS s, sum(n * n) AS q FROM p GROUP BY 1),
    d AS (SELECT a.resource AS x, b.resource AS y, sum(a.n * b.n) AS xy FROM p a JOIN p b USING (task) GROUP BY 1, 2),
    r AS (SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y, (xy - u.s * v.s / t) / sqrt((u.q - u.s * u.s / t) * (v.q - v.s * v.s / t)) AS r FROM d JOIN s u ON u.resource = x JOIN s v ON v.resource = y, t WHERE (u.q - u.s * u.s / t) > 1e-9 AND (v.q - v.s * v.s / t) > 1e-9)
    SELECT x, y, round(r, 6) + 0.0 AS r FROM r WHERE x < y AND r > 0.5""",
    "sh",
)
def s045_similar_resources(spark, d):
    """Pairs of suppliers whose parts' groups correlate above one half: only pairs that share a rare enough group are compared (45, 77)."""
    log = shipping(spark, d)
    profile = st.resource_profile(log.with_df(log.df.withColumn("activity", F.col("part") % 20)))
    return st.similar_profiles(profile, 0.5).select("x", "y", r6("r").alias("r"))


@query(
    """WITH RECURSIVE p AS (SELECT resource, activity AS task, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2), t AS (SELECT count(DISTINCT task)::DOUBLE AS t FROM p), s AS (SELECT resource, sum(n) AS s, sum(n * n) AS q FROM p GROUP BY 1),
    c AS (SELECT a.resource AS x, b.resource AS y, sum(a.n * b.n) AS xy FROM p a JOIN p b USING (task) WHERE a.resource <> b.resource GROUP BY 1, 2),
    e AS (SELECT x, y FROM c JOIN s u ON u.resource = x JOIN s v ON v.resource = y, t WHERE sqrt(abs((u.q - u.s * u.s / t) * (v.q - v.s * v.s / t))) > 1e-9 AND (xy - u.s * v.s / t) / sqrt(abs((u.q - u.s * u.s / t) * (v.q - v.s * v.s / t))) > 0.9),
    w(v, r) AS (SELECT resource, resource FROM s UNION SELECT e.y, w.r FROM w JOIN e ON e.x = w.v),
    k AS (SELECT v AS resource, min(r) AS root FROM w GROUP BY v), z AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS role FROM k GROUP BY root)
    SELECT resource, role FROM k JOIN z USING (root)""",
    "ev",
)
def s078_discover_roles(spark, d):
    return st.discover_roles(events(spark, d), 0.9)


@query("SELECT CAST(case_id % 5 AS VARCHAR) AS role, count(DISTINCT resource) AS resources, count(*) AS n FROM ev GROUP BY 1", "ev")
def s079_roles_from_column(spark, d):
    df = events(spark, d).df.withColumn("both", F.concat("resource", F.lit("|"), (F.col("case_id") % 5).cast("string")))
    return st.roles_from_column(df, "both", "|")


STEPS = """WITH s AS (SELECT case_id, row_number() OVER w AS position, activity AS a, 'r_' || resource AS r, 'wd_' || CAST(isodow(time) - 1 AS VARCHAR) AS w, coalesce(lead(activity) OVER w, 'END') AS next FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie))"""
GRAPH = (
    STEPS
    + """, g AS (SELECT DISTINCT 'begin' AS kind, NULL::VARCHAR AS a, NULL::VARCHAR AS r, NULL::VARCHAR AS w, a AS target, 1.0::DOUBLE AS likelihood FROM s WHERE position = 1
    UNION ALL SELECT 'resource', a, NULL, NULL, r, count(*) / sum(count(*)) OVER (PARTITION BY a) FROM s GROUP BY a, r
    UNION ALL SELECT 'weekday', a, r, NULL, w, count(*) / sum(count(*)) OVER (PARTITION BY a, r) FROM s GROUP BY a, r, w
    UNION ALL SELECT 'next', a, r, w, next, l FROM (SELECT a, r, w, next, count(*) / sum(count(*)) OVER (PARTITION BY a, r, w) AS l FROM s GROUP BY a, r, w, next) WHERE next <> 'END')"""
)


@query(
    STEPS + """, e AS (SELECT a AS source, next AS target FROM s UNION ALL SELECT 'START', a FROM s WHERE position = 1)
    SELECT source, target, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) + 0.0 AS likelihood FROM e GROUP BY 1, 2""",
    "ev",
)
def s080_basic_graph(spark, d):
    return gr.basic_edges(events(spark, d)).withColumn("likelihood", r6("likelihood"))


@query(GRAPH + " SELECT kind, a, r, w, target, round(likelihood, 6) + 0.0 AS likelihood FROM g", "ev")
def s080_extended_graph(spark, d):
    return gr.edges(events(spark, d)).withColumn("likelihood", r6("likelihood"))


PATHS = (
    GRAPH
    + """, q AS (SELECT *, lag(a) OVER c AS pa, lag(r) OVER c AS pr, lag(w) OVER c AS pw FROM s WINDOW c AS (PARTITION BY case_id ORDER BY position)),
    p AS (SELECT q.case_id, q.position, q.a, (CASE WHEN q.position = 1 THEN coalesce(b.likelihood, 0) ELSE coalesce(n.likelihood, 0) END) * coalesce(x.likelihood, 0) * coalesce(y.likelihood, 0) AS step FROM q
    LEFT JOIN g b ON b.kind = 'begin' AND b.target = q.a LEFT JOIN g n ON n.kind = 'next' AND n.a = q.pa AND n.r = q.pr AND n.w = q.pw AND n.target = q.a
    LEFT JOIN g x ON x.kind = 'resource' AND x.a = q.a AND x.target = q.r LEFT JOIN g y ON y.kind = 'weekday' AND y.a = q.a AND y.r = q.r AND y.target = q.w)"""
)


@query(PATHS + " SELECT a, position, round(ln(min(running)), 6) + 0.0 AS log_likelihood FROM (SELECT *, product(step) OVER (PARTITION BY case_id ORDER BY position) AS running FROM p) WHERE running > 0 GROUP BY a, position", "ev")
def s081_least_likelihood(spark, d):
    log = events(spark, d)
    out = gr.least_likelihood(gr.path_likelihoods(log, gr.edges(log)))
    return out.select("a", "position", r6(F.ln("likelihood")).alias("log_likelihood"))


@query("WITH o AS (SELECT activity, value, row_number() OVER (PARTITION BY activity ORDER BY value) AS i, count(*) OVER (PARTITION BY activity) AS n FROM ev) SELECT activity, round(sum((2 * i - n - 1) * value) / (any_value(n) * sum(value)), 6) + 0.0 AS gini FROM o GROUP BY activity", "ev")
def s082_gini(spark, d):
    return gr.gini(events(spark, d).df, ["activity"], "value").withColumn("gini", r6("gini"))


@query(
    STEPS + """, n AS (SELECT count(DISTINCT r)::DOUBLE AS nr, count(DISTINCT w)::DOUBLE AS nw, count(DISTINCT a)::DOUBLE AS na FROM s),
    c AS (SELECT a, count(DISTINCT r) AS resources, count(DISTINCT w) AS weekdays, count(DISTINCT CASE WHEN next <> 'END' THEN next END) AS successors FROM s GROUP BY a)
    SELECT a, resources, weekdays, successors, round(resources / nr, 6) + 0.0 AS resource_share, round(weekdays / nw, 6) + 0.0 AS weekday_share, round(successors / na, 6) + 0.0 AS successor_share FROM c, n""",
    "ev",
)
def s083_class_likelihood(spark, d):
    out = gr.class_likelihood(events(spark, d))
    return out.withColumns({c: r6(c) for c in ("resource_share", "weekday_share", "successor_share")})


@query(
    GRAPH + """, x AS (SELECT * FROM g WHERE kind = 'resource'), y AS (SELECT * FROM g WHERE kind = 'weekday'), z AS (SELECT * FROM g WHERE kind = 'next'),
    o AS (SELECT a, 'resource' AS type, target, likelihood AS l FROM x UNION ALL SELECT x.a, 'weekday', y.target, x.likelihood * y.likelihood FROM x JOIN y ON y.a = x.a AND y.r = x.target
    UNION ALL SELECT x.a, 'activity', z.target, x.likelihood * y.likelihood * z.likelihood FROM x JOIN y ON y.a = x.a AND y.r = x.target JOIN z ON z.a = x.a AND z.r = x.target AND z.w = y.target)
    SELECT a, type, target, round(sum(l), 6) + 0.0 AS likelihood FROM o GROUP BY 1, 2, 3""",
    "ev",
)
def s084_reachable_nodes(spark, d):
    return gr.reachable(gr.edges(events(spark, d))).withColumn("likelihood", r6("likelihood"))


def _class(found: str, total: str) -> str:
    """Class likelihood, see ``graph.scaled_class``."""
    raw = f"(CAST({found} AS DOUBLE) / {total})"
    return f"CASE WHEN {total} > 1 THEN (CASE WHEN {raw} > 0.5 THEN 1 - {raw} ELSE {raw} END - 1 / ({total} + 1.0)) / (0.5 - 1 / ({total} + 1.0)) ELSE 0 END"


def _walk(train: str) -> str:
    """All cases of the log walked, event by event, through the graph of the rows of ``ev`` for which ``train`` holds."""
    return STEPS.replace("WITH s AS", "WITH RECURSIVE s AS") + f""",
    t AS (SELECT case_id, row_number() OVER w AS position, activity AS a, 'r_' || resource AS r, 'wd_' || CAST(isodow(time) - 1 AS VARCHAR) AS w, lead(activity) OVER w AS next
        FROM ev WHERE {train} WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    gr AS (SELECT a, r, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p, count(*) AS n, count(DISTINCT next) AS s FROM t GROUP BY a, r),
    gw AS (SELECT a, r, w, count(*) / sum(count(*)) OVER (PARTITION BY a, r) AS p FROM t GROUP BY a, r, w),
    ga AS (SELECT * FROM (SELECT a, r, w, next AS target, count(*) / sum(count(*)) OVER (PARTITION BY a, r, w) AS p FROM t GROUP BY a, r, w, next) WHERE target IS NOT NULL),
    gb AS (SELECT DISTINCT a AS target, 1.0::DOUBLE AS p FROM t WHERE position = 1),
    aw AS (SELECT a, w, count(DISTINCT next) AS s FROM t GROUP BY a, w),
    re AS (SELECT a, 'r' AS type, r AS target, p FROM gr
        UNION ALL SELECT gr.a, 'w', gw.w, sum(gr.p * gw.p) FROM gr JOIN gw USING (a, r) GROUP BY gr.a, gw.w
        UNION ALL SELECT gr.a, 'a', target, sum(gr.p * gw.p * ga.p) FROM gr JOIN gw USING (a, r) JOIN ga USING (a, r, w) GROUP BY gr.a, target),
    gi AS (SELECT a, type, 1 - sum((2 * i - n - 1) * p) / (any_value(n) * sum(p)) AS even
        FROM (SELECT *, row_number() OVER (PARTITION BY a, type ORDER BY p) AS i, count(*) OVER (PARTITION BY a, type) AS n FROM re) GROUP BY a, type),
    ac AS (SELECT a, count(DISTINCT r) AS cr, count(DISTINCT w) AS cw, count(DISTINCT next) AS na FROM t GROUP BY a),
    al AS (SELECT count(DISTINCT r) AS nr, count(DISTINCT w) AS nw FROM t),
    m AS (SELECT ac.a, na, nw, coalesce(gia.even, 1) AS ea, coalesce(giw.even, 1) AS ew, coalesce(gir.even, 1) * (1 - ({_class("cr", "nr")})) AS miss_r, coalesce(giw.even, 1) * (1 - ({_class("cw", "nw")})) AS miss_w
        FROM ac CROSS JOIN al LEFT JOIN gi gia ON gia.a = ac.a AND gia.type = 'a' LEFT JOIN gi giw ON giw.a = ac.a AND giw.type = 'w' LEFT JOIN gi gir ON gir.a = ac.a AND gir.type = 'r'),
    walk AS (
        SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS position, NULL::VARCHAR AS a0, NULL::VARCHAR AS r0, NULL::VARCHAR AS w0, NULL::VARCHAR AS last, CAST(0 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS least FROM s
        UNION ALL
        SELECT case_id, position, a0, r0, w0, last, l3, least(least, l3) FROM (
            SELECT *, CASE WHEN to_w THEN ln(pw) + l2 WHEN last IS NULL THEN 2 * l2 + ln(0.95)
                ELSE ln(0.95 * coalesce(reach_w, CASE WHEN r0 IS NULL THEN miss_w ELSE ew * (1 - ({_class("n_ar", "nw")})) END)) + l2 END AS l3
            FROM (SELECT y.*, y.w0_before IS NULL AND gw.p IS NOT NULL AS to_w, gw.p AS pw, coalesce(y.w0_before, CASE WHEN gw.p IS NOT NULL THEN y.w END) AS w0, re.p AS reach_w, gr.n AS n_ar
                FROM (SELECT x.*, CASE WHEN r0_before IS NULL AND gr.p IS NOT NULL THEN ln(gr.p) + l1 WHEN last IS NULL THEN 2 * l1 + ln(0.95) ELSE ln(0.95 * miss_r) + l1 END AS l2, coalesce(r0_before, CASE WHEN gr.p IS NOT NULL THEN x.r END) AS r0
                    FROM (SELECT s.case_id, s.position, s.a, s.r, s.w, k.least, here.miss_r, here.miss_w, here.ew, here.nw, here.a AS last, coalesce(here.a, k.a0) AS a0,
                            CASE WHEN here.a IS NULL THEN k.r0 END AS r0_before, CASE WHEN here.a IS NULL THEN k.w0 END AS w0_before,
                            CASE WHEN coalesce(CASE WHEN k.a0 IS NULL THEN gb.p END, ga.p) IS NOT NULL THEN ln(coalesce(CASE WHEN k.a0 IS NULL THEN gb.p END, ga.p)) + k.l
                                WHEN k.last IS NULL THEN 2 * k.l + ln(0.9)
                                ELSE ln(0.9 * coalesce(re.p, there.ea * (1 - (CASE WHEN k.w0 IS NOT NULL THEN {_class("aw.s", "there.na")} WHEN k.r0 IS NOT NULL THEN {_class("ar.s", "there.na")} ELSE {_class("0", "there.na")} END)))) + k.l END AS l1
                        FROM walk k JOIN s ON s.case_id = k.case_id AND s.position = k.position + 1 LEFT JOIN m here ON here.a = s.a LEFT JOIN m there ON there.a = k.last
                        LEFT JOIN gb ON gb.target = s.a LEFT JOIN ga ON ga.a = k.a0 AND ga.r = k.r0 AND ga.w = k.w0 AND ga.target = s.a
                        LEFT JOIN re ON re.a = k.last AND re.type = 'a' AND re.target = s.a LEFT JOIN aw ON aw.a = k.last AND aw.w = k.w0 LEFT JOIN gr ar ON ar.a = k.last AND ar.r = k.r0) x
                    LEFT JOIN gr ON gr.a = x.a0 AND gr.r = x.r) y
                LEFT JOIN gw ON gw.a = y.a0 AND gw.r = y.r0 AND gw.w = y.w LEFT JOIN re ON re.a = y.last AND re.type = 'w' AND re.target = y.w LEFT JOIN gr ON gr.a = y.a0 AND gr.r = y.r0))),
    f AS (SELECT case_id, CASE WHEN isfinite(min(least)) THEN min(least) END AS log_likelihood FROM walk GROUP BY case_id)"""


TRAINED, UNSEEN = "case_id % 2 = 0", "case_id % 2 = 0 AND activity <> 'purchase' AND CAST(resource AS INTEGER) % 3 > 0"


def walked(spark, d, train: str):
    log = events(spark, d)
    return gr.case_likelihood(log, gr.likelihood_model(log.with_df(log.df.where(train))))


@query(_walk(TRAINED) + " SELECT case_id, round(log_likelihood, 6) + 0.0 AS log_likelihood FROM f", "ev")
def s101_case_likelihood(spark, d):
    """Cases walked through the graph of half of the cases, with penalties where an edge is missing."""
    return walked(spark, d, TRAINED).withColumn("log_likelihood", r6("log_likelihood"))


@query(_walk(UNSEEN) + " SELECT case_id, round(log2(1 - log_likelihood), 6) + 0.0 AS depth FROM f", "ev")
def s101_unseen_values(spark, d):
    """The same where an activity and a third of the resources are unknown: likelihoods are squared, so their logarithm is large."""
    return walked(spark, d, UNSEEN).select("case_id", r6(F.log2(1 - F.col("log_likelihood"))).alias("depth"))


@query(_walk(TRAINED) + ", k AS (SELECT case_id, round(log_likelihood, 6) AS l FROM f) SELECT case_id, row_number() OVER (ORDER BY l, case_id) AS rank FROM k ORDER BY l, case_id LIMIT 10", "ev")
def s102_case_ranking(spark, d):
    """The ten least likely cases (102, 156)."""
    from pyspark.sql import Window

    top = walked(spark, d, TRAINED).select("case_id", F.round("log_likelihood", 6).alias("l")).orderBy("l", "case_id").limit(10)
    return top.select("case_id", F.row_number().over(Window.orderBy("l", "case_id")).cast("long").alias("rank"))


@query("SELECT case_id, max(value) - min(value) > 100 AS wide FROM ev GROUP BY case_id", "ev")
def s198_per_case_function(spark, d):
    """A user's function on each case."""
    import pandas as pd

    log = events(spark, d)

    def wide(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"case_id": [pdf["case_id"].iloc[0]], "wide": [bool(pdf["value"].max() - pdf["value"].min() > 100)]})

    return gr.per_case(log.with_df(log.df.select("case_id", "time", "tie", "value")), wide, "case_id long, wide boolean")


@query("SELECT CAST(l_partkey AS VARCHAR) AS parent_value, p_brand AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def s061_dependency_across_tables(spark, d):
    """Part determines brand: the attribute joined to the log is a functional dependency."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("value"))
    log = EventLog(shipping(spark, d).df.select("part").join(part, "part"), LogSpec(order=("part",)))
    return log.df.groupBy(F.col("part").cast("string").alias("parent_value"), "value").agg(F.count("*").alias("n"))
