"""Metrics, rankings, drift, replay, prefix features and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import context as cx
from caselake.operators import drift as dr
from caselake.operators import features as fe
from caselake.operators import methods
from caselake.operators import metrics as me
from caselake.operators import model as mo
from caselake.operators import prepare as pr
from caselake.operators import replay as rp
from caselake.queries.common import events, folder, long_text, ordering, r6
from caselake.queries.models import CTX, P2, SCORES, context
from caselake.registry import query
from caselake.streaming import logs as sl

#: Results of a simple predictor: the activity before is expected to come again.
RESULTS = """WITH c AS (SELECT case_id, tie, time, activity AS expected, coalesce(lag(activity) OVER w, '0') AS predicted, value FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)), r AS (SELECT *, CAST(expected = predicted AS INTEGER) AS hit, 1.0 / (1 + value) AS p_expected FROM c)"""


def results(spark, d):
    df = cx.k_context(events(spark, d), 1, ["activity"])
    return df.select("case_id", "tie", "time", F.col("activity").alias("expected"), F.col("activity_Prev0").alias("predicted"), (1 / (1 + F.col("value"))).alias("p_expected"))


@query(RESULTS + " SELECT round(avg(hit), 6) + 0.0 AS accuracy FROM r", "ev")
def s169_accuracy(spark, d):
    return me.accuracy(results(spark, d)).select(r6("accuracy").alias("accuracy"))


@query(RESULTS + " SELECT time, tie, row_number() OVER o AS position, round(avg(hit) OVER o, 6) + 0.0 AS accuracy FROM r WINDOW o AS (ORDER BY time, tie)", "ev")
def s170_cumulative_accuracy(spark, d):
    return me.cumulative_accuracy(results(spark, d), ["time", "tie"]).withColumn("accuracy", r6("accuracy"))


@query(RESULTS + ", o AS (SELECT hit, (row_number() OVER (ORDER BY time, tie) - 1) // 100 AS period FROM r) SELECT CAST(period AS BIGINT) AS period, count(*) AS rows, round(avg(hit), 6) + 0.0 AS accuracy FROM o GROUP BY period", "ev")
def s171_period_accuracy(spark, d):
    return me.period_accuracy(results(spark, d), ["time", "tie"]).withColumn("accuracy", r6("accuracy"))


@query(RESULTS + ", o AS (SELECT row_number() OVER (ORDER BY time, tie) - 1 AS position, avg(hit) OVER (ORDER BY time, tie ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS a FROM r) SELECT position, round(a, 6) + 0.0 AS accuracy FROM o WHERE position >= 250", "ev")
def s133_rolling_accuracy(spark, d):
    return me.rolling_accuracy(results(spark, d), ["time", "tie"], 250).withColumn("accuracy", r6("accuracy"))


@query("SELECT tie, round(avg(value) OVER (PARTITION BY case_id ORDER BY time, tie ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 1e-9, 6) + 0.0 AS mean FROM ev", "ev")
def s134_moving_mean(spark, d):
    return me.moving_mean(events(spark, d).df, ["time", "tie"], "value", 100, ["case_id"]).select("tie", r6(F.col("mean") + 1e-9).alias("mean"))


@query(RESULTS + " SELECT round(avg(1 - p_expected), 6) + 0.0 AS brier FROM r", "ev")
def s172_brier(spark, d):
    return me.brier(results(spark, d)).select(r6("brier").alias("brier"))


@query("WITH n AS (SELECT activity AS value, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM ev GROUP BY 1) SELECT tie, round(sum((p - CAST(value = activity AS INTEGER)) ^ 2), 6) + 0.0 AS brier FROM (SELECT tie, activity FROM ev), n GROUP BY tie", "ev")
def s173_brier_multi(spark, d):
    df = events(spark, d).df
    shares = mo.value_frequency(df, "activity").select("value", F.col("share").alias("p"))
    rows = df.select("tie", F.col("activity").alias("expected")).join(F.broadcast(shares))  # as many values as activities
    return me.brier_multi(rows, ["tie"]).withColumn("brier", r6("brier"))


REPORT = RESULTS + """, a AS (SELECT expected AS k, count(*) AS support, sum(hit) AS correct FROM r GROUP BY 1), b AS (SELECT predicted AS k, count(*) AS predicted FROM r GROUP BY 1),
    j AS (SELECT coalesce(a.k, b.k) AS class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, CAST(coalesce(correct, 0) AS BIGINT) AS correct FROM a FULL JOIN b ON a.k = b.k),
    m AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN correct / support ELSE 0 END AS recall FROM j)"""


@query(REPORT + " SELECT class, support, predicted, correct, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) + 0.0 AS f1 FROM m", "ev")
def s176_class_report(spark, d):
    return me.class_report(results(spark, d)).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(REPORT + " SELECT round(sum(support * precision) / sum(support), 6) + 0.0 AS precision FROM m", "ev")
def s174_weighted_precision(spark, d):
    return me.weighted_precision(results(spark, d)).select(r6("precision").alias("precision"))


@query(REPORT + " SELECT round(sum(support * recall) / sum(support), 6) + 0.0 AS recall FROM m", "ev")
def s175_weighted_recall(spark, d):
    return me.weighted_recall(results(spark, d)).select(r6("recall").alias("recall"))


SCORED = """WITH s AS (SELECT doc_id AS case_id, n_chars::DOUBLE AS score, 1 - quality AS label, CAST(source AS VARCHAR) AS method FROM documents JOIN labels USING (doc_id)),
    p AS (SELECT *, row_number() OVER w AS rank, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp, sum(label) OVER () AS np, sum(1 - label) OVER () AS nn FROM s WINDOW w AS (ORDER BY score, case_id)),
    g AS (SELECT *, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp, sum(label) OVER (PARTITION BY method) AS np, sum(1 - label) OVER (PARTITION BY method) AS nn FROM s WINDOW w AS (PARTITION BY method ORDER BY score, case_id))"""


def scored(spark, d):
    """Length as a score of low quality: short documents come first."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("case_id"), F.col("n_chars").cast("double").alias("score"), (1 - F.col("quality")).alias("label"), F.col("source").alias("method"))


@query(SCORED + " SELECT rank, round(fp / nn, 6) + 0.0 AS fpr, round(tp / np, 6) + 0.0 AS tpr FROM p")
def s177_roc(spark, d):
    return me.roc(scored(spark, d)).select("rank", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(SCORED + " SELECT round(sum(tp / np) / any_value(nn), 6) + 0.0 AS auc FROM p WHERE label = 0")
def s177_roc_auc(spark, d):
    return me.roc_auc(scored(spark, d)).select(r6("auc").alias("auc"))


@query(SCORED + " SELECT rank, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / np, 6) + 0.0 AS recall FROM p")
def s178_precision_recall(spark, d):
    return me.precision_recall(scored(spark, d)).select("rank", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(SCORED + " SELECT round(sum(tp / (tp + fp)) / any_value(np), 6) + 0.0 AS area FROM p WHERE label = 1")
def s178_average_precision(spark, d):
    return me.average_precision(scored(spark, d)).select(r6("area").alias("area"))


@query(SCORED + ", f AS (SELECT count(*) FILTER (WHERE score < 800 AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score < 800) AS f, count(*) FILTER (WHERE label = 1) AS p FROM s) SELECT round(tp / f, 6) + 0.0 AS precision, round(tp / p, 6) + 0.0 AS recall, round(2 * tp / (f + p), 6) + 0.0 AS f1 FROM f")
def s179_flagged_report(spark, d):
    return me.flagged_report(scored(spark, d), F.col("score") < 800).select(r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(SCORED + " SELECT method, round(sum(tp / np) / any_value(nn), 6) + 0.0 AS auc FROM g WHERE label = 0 AND np > 0 GROUP BY method")
def s180_compared_auc(spark, d):
    return me.roc_auc(scored(spark, d), ["method"]).where("auc IS NOT NULL").select("method", r6("auc").alias("auc"))


@query(SCORED + ", a AS (SELECT method, sum(tp / np) / any_value(nn) AS auc FROM g WHERE label = 0 AND np > 0 GROUP BY method) SELECT round(avg(auc), 6) + 0.0 AS mean, round(median(auc), 6) + 0.0 AS median, round(var_pop(auc), 6) + 0.0 AS variance FROM a")
def s181_run_summary(spark, d):
    a = me.roc_auc(scored(spark, d), ["method"]).where("auc IS NOT NULL")
    return me.run_summary(a, "auc", []).select(r6("mean").alias("mean"), r6("median").alias("median"), r6("variance").alias("variance"))


@query("WITH a AS (SELECT status AS setting, activity AS method, round(avg(price), 6) AS accuracy FROM od GROUP BY 1, 2) SELECT setting, method, row_number() OVER (PARTITION BY setting ORDER BY accuracy DESC, method) AS rank FROM a", "od")
def s135_rank_methods(spark, d):
    a = ordering(spark, d).df.groupBy(F.col("status").alias("setting"), F.col("activity").alias("method")).agg(F.round(F.avg("price"), 6).alias("accuracy"))
    return me.rank_methods(a, ["setting"]).select("setting", "method", F.col("rank").cast("long").alias("rank"))


@query("SELECT activity, round(avg(price) FILTER (WHERE status = 'F'), 4) + 0.0 AS \"F\", round(avg(price) FILTER (WHERE status = 'O'), 4) + 0.0 AS \"O\", round(avg(price) FILTER (WHERE status = 'P'), 4) + 0.0 AS \"P\" FROM od GROUP BY activity", "od")
def s183_result_table(spark, d):
    """Means by row and column (183)."""
    out = me.result_table(ordering(spark, d).df, ["activity"], "status", ["F", "O", "P"], "price")
    return out.select("activity", *((F.round(c, 4) + 0.0).alias(c) for c in "FOP"))


FLAGS = """WITH f AS (SELECT case_id, tie, 'activity' AS attribute, CAST(activity = 'purchase' AS INTEGER) AS truth, CAST(tie % 7 = 0 OR activity = 'purchase' AND tie % 3 > 0 AS INTEGER) AS predicted FROM ev
    UNION ALL SELECT case_id, tie, 'value', CAST(value > 150 AS INTEGER), CAST(value > 120 AND tie % 5 > 0 AS INTEGER) FROM ev),"""
AXES = " UNION ALL ".join(f"SELECT '{axis}' AS axis, attribute, max(truth) AS t, max(predicted) AS p FROM f GROUP BY attribute, {by}" for axis, by in (("attribute", "case_id, tie"), ("event", "case_id, tie"), ("case", "case_id")))


@query(
    FLAGS + f""" a AS ({AXES.replace("SELECT 'event' AS axis, attribute,", "SELECT 'event' AS axis, 'any' AS attribute,").replace("GROUP BY attribute, case_id, tie UNION ALL SELECT 'case'", "GROUP BY case_id, tie UNION ALL SELECT 'case'")}), l AS (SELECT unnest([0, 1]) AS label),
    c AS (SELECT axis, attribute, label, count_if(t = label AND p = label) AS hit, count_if(p = label) AS said, count_if(t = label) AS is_ FROM a, l GROUP BY ALL)
    SELECT axis, attribute, label, round(coalesce(hit / nullif(said, 0), 0), 6) + 0.0 AS precision, round(coalesce(hit / nullif(is_, 0), 0), 6) + 0.0 AS recall, round(coalesce(2 * hit / nullif(said + is_, 0), 0), 6) + 0.0 AS f1 FROM c""",
    "ev",
)
def s182_report_by_axis(spark, d):
    """Flags of attributes of events, judged by attribute, by event and by attribute over the case (182)."""
    df = events(spark, d).df
    purchase, flag = F.col("activity") == "purchase", lambda c: c.cast("int")
    one = df.select("case_id", "tie", F.lit("activity").alias("attribute"), flag(purchase).alias("truth"), flag((F.col("tie") % 7 == 0) | purchase & (F.col("tie") % 3 > 0)).alias("predicted"))
    two = df.select("case_id", "tie", F.lit("value").alias("attribute"), flag(F.col("value") > 150).alias("truth"), flag((F.col("value") > 120) & (F.col("tie") % 5 > 0)).alias("predicted"))
    out = me.report_by_axis(one.unionByName(two), {"attribute": ["case_id", "tie", "attribute"], "event": ["case_id", "tie"], "case": ["case_id", "attribute"]})
    return out.select("axis", "attribute", "label", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT status, round(avg(price), 4) + 0.0 AS mean, round(stddev_samp(price), 4) + 0.0 AS std, count(*) AS batches FROM od GROUP BY status", "od")
def s184_timing(spark, d):
    out = me.timing(ordering(spark, d).df, ["status"], "price")
    return out.select("status", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("std", 4) + 0.0).alias("std"), "batches")


@query("SELECT DISTINCT activity, resource FROM (SELECT DISTINCT activity FROM ev), (SELECT DISTINCT resource FROM ev) EXCEPT SELECT activity, resource FROM ev WHERE tie % 2 = 0", "ev")
def s185_missing_experiments(spark, d):
    """The grid is every resource with every activity; activities are the settings, at most a thousand (185)."""
    df = events(spark, d).df
    settings = [r[0] for r in df.select("activity").distinct().limit(1001).collect()]
    if len(settings) > 1000:
        raise ValueError("more than a thousand settings")
    grid = df.select("resource").distinct().withColumn("activity", F.explode(F.array(*map(F.lit, settings))))
    return me.missing_experiments(grid, df.where("tie % 2 = 0"), ["activity", "resource"])


@query(
    CTX + """, o AS (SELECT *, row_number() OVER (ORDER BY time, tie, case_id) - 1 AS i, count(*) OVER () AS n FROM c), e AS (SELECT split, CAST(percentage AS DOUBLE) AS percentage FROM (SELECT unnest(['train-test', 'test-train']) AS split), (SELECT unnest([50, 80]) AS percentage)),
    g AS (SELECT o.*, e.*, CASE WHEN split = 'train-test' THEN i < ceil(n * (percentage / 100)) ELSE i >= ceil(n * (1 - percentage / 100)) END AS train FROM o, e), t AS (SELECT split, percentage, p0, activity AS value, count(*) AS m FROM g WHERE train GROUP BY ALL),
    b AS (SELECT split, percentage, p0, arg_min(value, (-m, value)) AS predicted FROM t GROUP BY ALL), a AS (SELECT split, percentage, arg_min(value, (-m, value)) AS predicted FROM (SELECT split, percentage, value, sum(m) AS m FROM t GROUP BY ALL) GROUP BY ALL)
    SELECT split, percentage, 'counts' AS method, round(avg(CAST(g.activity = coalesce(b.predicted, a.predicted) AS INTEGER)), 6) + 0.0 AS accuracy FROM g LEFT JOIN b USING (split, percentage, p0) JOIN a USING (split, percentage) WHERE NOT train GROUP BY split, percentage""",
    "ev",
)
def s148_experiment_grid(spark, d):
    """Two splits and two percentages, each prepared, trained and tested (148)."""
    settings = methods.experiments(split=["train-test", "test-train"], percentage=[50.0, 80.0], k=[1])
    return methods.run_experiments(events(spark, d), settings, ["counts"], ["tie"]).select("split", "percentage", "method", r6("accuracy").alias("accuracy"))


# -- drift ------------------------------------------------------------------------------------------------------------------

P = """CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x))))) END"""
KS = """, c AS (SELECT {by} AS k, value AS v, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM t GROUP BY 1, 2),
    u AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY k) AS n, sum(b) OVER (PARTITION BY k) AS m FROM c WINDOW w AS (PARTITION BY k ORDER BY v)),
    q AS (SELECT k, max(abs(ca / n - cb / m)) AS d, any_value(n)::DOUBLE AS n, any_value(m)::DOUBLE AS m FROM u WHERE n > 0 AND m > 0 GROUP BY k), y AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS x FROM q)"""


@query("WITH t AS (SELECT activity, value, tie % 2 AS side FROM ev)" + KS.format(by="activity") + f" SELECT k AS activity, round(d, 6) + 0.0 AS d, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round({P}, 5) + 0.0 AS p FROM y", "ev")
def s161_two_sample_test(spark, d):
    t = events(spark, d).df.withColumn("side", F.col("tie") % 2)
    return dr.ks_test(t, ["activity"]).select("activity", r6("d").alias("d"), "n", "m", (F.round("p", 5) + 0.0).alias("p"))


SERIES = """WITH z AS (SELECT case_id, avg(price) / 1e5 * count(*) AS score, count(*) AS events, min(time) AS began FROM od GROUP BY case_id),
    i AS (SELECT case_id, CASE WHEN score = 0 THEN -5 ELSE score / events END AS value, row_number() OVER (ORDER BY began, case_id) - 1 AS idx FROM z)"""


def series(spark, d):
    log = ordering(spark, d)
    scores = log.df.groupBy("case_id").agg((F.avg("price") / 1e5 * F.count("*")).alias("score"), F.count("*").alias("events"))
    return dr.score_series(scores, log)


@query(SERIES + " SELECT case_id, idx, round(value + 1e-9, 6) + 0.0 AS value FROM i", "od")
def s160_score_series(spark, d):
    return series(spark, d).withColumn("value", r6(F.col("value") + 1e-9))


@query(
    SERIES + """, e AS (SELECT max(idx) + 1 AS n FROM i), w AS (SELECT unnest(range(0, (SELECT n FROM e) - 60, 1)) AS start), t AS (SELECT start, round(value, 9) AS value, CASE WHEN idx < start + 30 THEN 0 ELSE 1 END AS side FROM w JOIN i ON idx >= start AND idx < start + 60)"""
    + KS.format(by="start") + f", r AS (SELECT k AS start, d, {P} AS p FROM y) SELECT CAST(start AS BIGINT) AS start, round(d, 6) + 0.0 AS d, round(p, 5) + 0.0 AS p FROM r",
    "od",
)
def s162_sliding_drift(spark, d):
    """Windows of 30 cases, each with the next 30, at every case (162, 49)."""
    out = dr.sliding_drift(series(spark, d).withColumn("value", F.round("value", 9)), 30, 1)
    return out.select("start", r6("d").alias("d"), (F.round("p", 5) + 0.0).alias("p"))


@query("WITH m AS (SELECT activity AS attribute, median(value) AS median FROM ev GROUP BY 1) SELECT attribute, round(any_value(median), 6) + 0.0 AS median, round(median(abs(value - median)) / 0.6745, 6) + 0.0 AS mad FROM ev JOIN m ON activity = attribute GROUP BY attribute", "ev")
def s164_median_and_mad(spark, d):
    out = dr.median_and_mad(events(spark, d).df, "activity", "value")
    return out.select(F.col("activity").alias("attribute"), r6("median").alias("median"), r6("mad").alias("mad"))


@query(
    """WITH s AS (SELECT activity AS attribute, value, isoyear(time) * 100 + weekofyear(time) AS period FROM ev), g AS (SELECT DISTINCT period FROM s), pr AS (SELECT a.period AS pa, b.period AS pb FROM g a JOIN g b ON a.period < b.period),
    t AS (SELECT attribute || '|' || pa || '|' || pb AS k0, value, CASE WHEN period = pa THEN 0 ELSE 1 END AS side FROM s JOIN pr ON period = pa OR period = pb)"""
    + KS.format(by="k0") + f" SELECT split_part(k, '|', 1) AS attribute, CAST(split_part(k, '|', 2) AS BIGINT) AS period_a, CAST(split_part(k, '|', 3) AS BIGINT) AS period_b, round(d, 6) + 0.0 AS d, round({P}, 5) + 0.0 AS p FROM y",
    "ev",
)
def s165_attribute_drift(spark, d):
    rows = events(spark, d).df.withColumn("period", (F.expr("extract(YEAROFWEEK FROM time)") * 100 + F.weekofyear("time")).cast("long"))
    return dr.attribute_drift(rows, "period", "activity", "value").select(F.col("activity").alias("attribute"), "period_a", "period_b", r6("d").alias("d"), (F.round("p", 5) + 0.0).alias("p"))


@query("SELECT CAST(CASE WHEN value > 200 THEN -1 WHEN value > 100 THEN 0 WHEN value > 50 THEN 1 WHEN value > 10 THEN 2 ELSE 4 END AS BIGINT) AS band, count(*) AS cases FROM ev GROUP BY 1", "ev")
def s167_score_bands(spark, d):
    return dr.score_bands(events(spark, d).df, [200.0, 100.0, 50.0, 10.0], "value")


@query(
    """WITH s AS (SELECT value, isoyear(time) * 100 + weekofyear(time) AS b FROM ev), g AS (SELECT DISTINCT b FROM s), pr AS (SELECT x.b AS batch, y.b AS past FROM g x JOIN g y ON y.b < x.b),
    t AS (SELECT batch * 1000000 + past AS k0, value, CASE WHEN b = batch THEN 0 ELSE 1 END AS side FROM s JOIN pr ON b = batch OR b = past)"""
    + KS.format(by="k0") + f", l AS (SELECT k // 1000000 AS batch, k % 1000000 AS past, ln({P} + 0.0001) AS lp FROM y) SELECT CAST(batch AS BIGINT) AS batch, CAST(past AS BIGINT) AS past, lp >= avg(lp) OVER (PARTITION BY batch) AS keep FROM l",
    "ev",
)
def s168_adaptive_window(spark, d):
    rows = events(spark, d).df.withColumn("week", (F.expr("extract(YEAROFWEEK FROM time)") * 100 + F.weekofyear("time")).cast("long"))
    return dr.adaptive_window(rows, "week").select("batch", "past", "keep")


@query(SCORES.replace("tie % 2 = 0", "case_id % 2 = 0").replace("WHERE tie % 2 = 1", "") + " SELECT case_id, count(*) AS events, round(avg(score_activity), 6) + 0.0 AS score FROM z GROUP BY case_id", "ev")
def s159_parameters_of_another_log(spark, d):
    """Structure from one half of the cases, tables from the other, scores of both (159)."""
    df = context(spark, d)
    nodes = mo.train(df.where("case_id % 2 = 0"), {"activity": (P2, [])})
    return mo.case_scores(mo.score_events(df, nodes), "case_id").select("case_id", "events", r6("score").alias("score"))


@query(
    SCORES.replace("tie % 2 = 0", "right(resource, 1) = '0'").replace("WHERE tie % 2 = 1", "")
    + " SELECT right(resource, 1) AS department, count(*) AS events, round(avg(score_activity), 6) + 0.0 AS score FROM z JOIN c USING (tie) GROUP BY 1",
    "ev",
)
def s166_scores_by_department(spark, d):
    """A model of one department (resources ending in 0) scores all departments (166)."""
    df = context(spark, d).withColumn("department", F.expr("substring(resource, -1, 1)"))
    scored_ = mo.score_events(df, mo.train(df.where("department = '0'"), {"activity": (P2, [])}))
    return scored_.groupBy("department").agg(F.count("*").alias("events"), r6(F.avg("score_activity")).alias("score"))


# -- replay -----------------------------------------------------------------------------------------------------------------


def _replay(past: str) -> str:
    return (
        CTX
        + f""", e AS (SELECT *, dense_rank() OVER (ORDER BY isoyear(time), weekofyear(time)) - 1 AS batch FROM c), t AS (SELECT x.batch, y.p0, y.activity AS value, count(*) AS n FROM (SELECT DISTINCT batch FROM e) x JOIN e y ON {past} GROUP BY 1, 2, 3),
    b AS (SELECT batch, p0, arg_min(value, (-n, value)) AS v FROM t GROUP BY 1, 2), m AS (SELECT batch, arg_min(value, (-n, value)) AS v FROM (SELECT batch, value, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1)
    SELECT e.tie, CAST(e.batch AS BIGINT) AS batch, e.activity AS expected, coalesce(b.v, m.v, '0') AS predicted FROM e LEFT JOIN b ON b.batch = e.batch AND b.p0 = e.p0 LEFT JOIN m ON m.batch = e.batch"""
    )


def weekly(spark, d):
    log = events(spark, d)
    return pr.batches(log.with_df(context(spark, d)), "week")


@query(_replay("y.batch < x.batch"), "ev")
def s186_test_then_train(spark, d):
    return rp.test_then_train(weekly(spark, d), "activity", P2[:1], ["tie"]).select("tie", "batch", "expected", "predicted")


@query(_replay("y.batch < x.batch AND y.batch >= x.batch - 2"), "ev")
def s186_test_then_train_window(spark, d):
    return rp.test_then_train(weekly(spark, d), "activity", P2[:1], ["tie"], window=2).select("tie", "batch", "expected", "predicted")


@query(_replay("y.batch < x.batch AND y.batch >= CASE WHEN x.batch > 2 THEN 2 ELSE 0 END"), "ev")
def s187_replay_with_drifts(spark, d):
    return rp.test_then_train(weekly(spark, d), "activity", P2[:1], ["tie"], drifts=[2], reset=True).select("tie", "batch", "expected", "predicted")


@query(_replay("y.batch = x.batch - 1"), "ev")
def s188_batch_by_batch(spark, d):
    return rp.test_then_train(weekly(spark, d), "activity", P2[:1], ["tie"], window=1).select("tie", "batch", "expected", "predicted")


# -- prefix features ---------------------------------------------------------------------------------------------------------

@query("SELECT case_id, row_number() OVER w AS position, round(coalesce(ln(1 + (epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6), 0), 6) + 0.0 AS g FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "ev")
def s127_log_gaps(spark, d):
    return fe.log_gaps(events(spark, d)).select("case_id", "position", r6(F.col("gaps")[0]).alias("g"))


@query("SELECT case_id, row_number() OVER w AS position, lag(activity, 3, '0') OVER w || ',' || lag(activity, 2, '0') OVER w || ',' || lag(activity, 1, '0') OVER w AS gram, activity AS next FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "ev")
def s128_padded_ngrams(spark, d):
    return fe.padded_ngrams(events(spark, d)).select("case_id", "position", long_text("gram_activity").alias("gram"), F.col("next_activity").alias("next"))


@query(
    """WITH o AS (SELECT *, row_number() OVER w AS position, (epoch_us(time) - epoch_us(first_value(time) OVER w)) / 86400e6 AS since FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie))
    SELECT case_id, position, count(*) FILTER (WHERE activity = 'click') OVER w AS n_click, round(coalesce(max(since) FILTER (WHERE activity = 'click') OVER w, 0), 6) + 0.0 AS t_click FROM o WINDOW w AS (PARTITION BY case_id ORDER BY position)""",
    "ev",
)
def s129_count_time_matrix(spark, d):
    out = fe.count_time_matrix(events(spark, d), ["view", "click"])
    return out.select("case_id", "position", F.col("counts")[1].alias("n_click"), r6(F.col("times")[1]).alias("t_click"))


@query("WITH o AS (SELECT case_id, row_number() OVER w AS position, lag(activity, 2) OVER w || ',' || lag(activity, 1) OVER w || ',' || activity AS window_, lead(activity) OVER w AS next FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)) SELECT case_id, position, window_ AS \"window\", next FROM o WHERE window_ IS NOT NULL AND next IS NOT NULL", "ev")
def s130_sliding_windows(spark, d):
    return fe.sliding_windows(events(spark, d), 3).select("case_id", "position", long_text("window").alias("window"), "next")


@query("SELECT tie, CAST(activity = 'click' AS INTEGER) AS is_click, CAST(activity = 'view' AS INTEGER) AS is_view FROM ev", "ev")
def s130_one_hot(spark, d):
    return fe.one_hot(events(spark, d), ["click", "view"]).select("tie", "is_click", "is_view")


@query(
    """WITH o AS (SELECT *, row_number() OVER w AS length, (epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6 AS gap, (epoch_us(time) - epoch_us(first_value(time) OVER w)) / 86400e6 AS days FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie))
    SELECT case_id, length, round(days, 6) + 0.0 AS days, round(coalesce(avg(gap) OVER w, 0) + 1e-7, 4) + 0.0 AS mean_gap, round(coalesce(min(gap) OVER w, 0) + 1e-7, 4) + 0.0 AS min_gap, round(coalesce(max(gap) OVER w, 0) + 1e-7, 4) + 0.0 AS max_gap,
    round(coalesce(median(gap) OVER w, 0) + 1e-7, 4) + 0.0 AS median_gap, count(*) FILTER (WHERE activity = 'view') OVER w AS n_view, count(DISTINCT resource) OVER w AS resources FROM o WINDOW w AS (PARTITION BY case_id ORDER BY length)""",
    "ev",
)
def s131_prefix_features(spark, d):
    out = fe.prefix_features(events(spark, d), ["view", "click"])
    four = lambda c: (F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c)
    return out.select("case_id", "length", r6("days").alias("days"), four("mean_gap"), four("min_gap"), four("max_gap"), four("median_gap"), "n_view", "resources")


@query("SELECT case_id, row_number() OVER w AS position, round(isodow(time) / 7.0 - 1 / 7.0, 6) + 0.0 AS weekday, CAST(activity = 'click' AS INTEGER)::DOUBLE AS click, CAST(least(row_number() OVER w, 3) AS DOUBLE) AS place FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "ev")
def s126_sequence_features(spark, d):
    """The last row of each tensor: one-hot activity, place in the window, weekday."""
    x = fe.sequence_features(events(spark, d), ["view", "click"], 3)
    last = F.element_at("x", -1)
    return x.select("case_id", "position", r6(last[6]).alias("weekday"), last[1].alias("click"), last[2].alias("place"))


@query("WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM ev WHERE tie % 2 = 0) SELECT tie, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) + 0.0 AS value FROM ev, l", "ev")
def s125_min_max_scaling(spark, d):
    df = events(spark, d).df
    return fe.scale(df, ["value"], fe.min_max(df.where("tie % 2 = 0"), ["value"])).select("tie", r6("value").alias("value"))


@query("SELECT tie, round(value, 4) + 0.0 AS value FROM ev", "ev")
def s125_scaling_and_back(spark, d):
    df = events(spark, d).df
    limits = fe.min_max(df, ["value"])
    out = fe.unscale(fe.scale(df, ["value"], limits, "log"), "value", limits, "log")
    return out.select("tie", (F.round("value", 4) + 0.0).alias("value"))


@query("WITH l AS (SELECT max(value) AS hi, min(value) AS lo FROM ev), v AS (SELECT tie, CAST(floor(greatest(0, least(1, (value - lo) / (hi - lo))) * 16777215) AS BIGINT) AS x FROM ev, l) SELECT tie, CAST(x >> 16 AS INTEGER) AS red, CAST((x >> 8) & 255 AS INTEGER) AS green, CAST(x & 255 AS INTEGER) AS blue, 4 AS pixels FROM v", "ev")
def s132_image(spark, d):
    df = events(spark, d).df.withColumn("other", F.col("value")).withColumn("third", F.lit(0.0) * F.col("value"))
    limits = fe.min_max(df, ["value", "other", "third"])
    out = fe.image(fe.scale(df, ["value", "other", "third"], limits), ["value", "other", "third"])
    first = F.col("image")[0]
    return out.select("tie", first[0].alias("red"), first[1].alias("green"), first[2].alias("blue"), F.size("image").alias("pixels"))


# -- streams ------------------------------------------------------------------------------------------------------------------


def streamed(spark, d, table: str):
    """A table as a stream of its files; a table that is one file is found by its name in its folder."""
    path = f"{d}/{table}.parquet"
    files = spark.read.parquet(path)
    one = files.inputFiles()[0].rstrip("/").endswith(f"/{table}.parquet")
    reader = spark.readStream.schema(files.schema).format("parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").load(d) if one else reader.load(path)


#: A gap after which a case of the batch form, which knows none, would start anew.
NEVER = "36500 days"


def log_stream(spark, d):
    raw = streamed(spark, d, "events")
    log = events(spark, d)
    return log.with_df(raw.selectExpr("user_id AS case_id", "event_type AS activity", "ts AS time", "get_json_object(props, '$.k') AS resource", "value", "event_id AS tie"))


@query("SELECT activity AS value, count(*) AS n FROM ev GROUP BY activity", "ev")
def s189_stream_counts(spark, d):
    """Counts kept by a stream, as after its last micro-batch."""
    at = folder(spark, "stream")

    def sink(df, _):
        df.write.mode("overwrite").parquet(f"{at}/out")

    sl.run_available(sl.stream_counts(log_stream(spark, d).df, "activity", []).select("value", "n"), at, "complete", sink)
    return spark.read.parquet(f"{at}/out")


@query("SELECT CAST(case_id AS VARCHAR) AS case_id, tie, activity AS value, lag(activity, 1, '0') OVER w || ',' || lag(activity, 2, '0') OVER w AS prev FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)", "ev")
def s190_stream_context(spark, d):
    """Context held in state by case; events come out in order of time, whatever the order of arrival."""
    at = folder(spark, "stream")
    log, end = sl.end_of_log(log_stream(spark, d), f"{at}/end")
    out = sl.run_to_end(sl.stream_context(log, 2, idle=NEVER), end, spark, at)
    return out.select("case_id", "tie", "value", long_text("prev").alias("prev"))


#: Score of each event (x) under a table of half of the events, and its place in its case.
EVENT_SCORES = (
    CTX
    + """, k AS (SELECT p0, p1, activity, count(*) AS n FROM c WHERE tie % 2 = 0 GROUP BY 1, 2, 3),
    m AS (SELECT p0, p1, sum(n)::DOUBLE AS m FROM k GROUP BY 1, 2),
    r AS (SELECT count(DISTINCT p0 || ',' || p1) / count(*) AS r FROM c WHERE tie % 2 = 0),
    x AS (SELECT c.case_id, time, tie, ln(greatest(CASE WHEN m IS NULL THEN r ELSE (1 - r) * coalesce(n / m, r) END, 1e-10)) AS x
        FROM c CROSS JOIN r LEFT JOIN m USING (p0, p1) LEFT JOIN k ON k.p0 = c.p0 AND k.p1 = c.p1 AND k.activity = c.activity)"""
)
ALERT_BELOW, ALERT_AFTER = -1.65, 3


def streamed_scores(spark, d, threshold: float, least: int):
    """Scores after each event, by two state machines in one stream, against a table of half of the events."""
    at, train = folder(spark, "stream"), context(spark, d).where("tie % 2 = 0")
    table, rate = mo.conditional_table(train, "activity", P2), mo.new_relation_rate(train, P2).first()[0]
    log, end = sl.end_of_log(log_stream(spark, d), f"{at}/end")
    return sl.run_to_end(sl.stream_scores(sl.stream_context(log, 2, idle=NEVER), table, rate, threshold, least, NEVER), end, spark, at)


@query(EVENT_SCORES + " SELECT CAST(case_id AS VARCHAR) AS case_id, count(*) AS events, round(avg(x), 6) + 0.0 AS score FROM x GROUP BY case_id", "ev")
def s191_stream_scores(spark, d):
    """Score of each case after its last event."""
    last = streamed_scores(spark, d, float("-inf"), 1).groupBy("case_id").agg(F.max_by("score", "events").alias("score"), F.max("events").alias("events"))
    return last.withColumn("score", r6("score"))


@query(
    EVENT_SCORES + f""", y AS (SELECT *, row_number() OVER w AS events, avg(x) OVER (PARTITION BY case_id ORDER BY time, tie ROWS UNBOUNDED PRECEDING) AS score FROM x WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    z AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY events) AS i FROM y WHERE events >= {ALERT_AFTER} AND score < {ALERT_BELOW})
    SELECT CAST(case_id AS VARCHAR) AS case_id, tie, events, round(score, 6) + 0.0 AS score FROM z WHERE i = 1""",
    "ev",
)
def s191_stream_alerts(spark, d):
    """The event of each case at which its mean score first falls below a threshold: one alert a case."""
    alerts = streamed_scores(spark, d, ALERT_BELOW, ALERT_AFTER).where("alert")
    return alerts.select("case_id", "tie", "events", r6("score").alias("score"))
