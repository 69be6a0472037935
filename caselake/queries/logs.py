"""Preparation: sources, filters, dictionaries, context, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators import context as cx
from caselake.operators import inject as ij
from caselake.operators import prepare as pr
from caselake.plans.log import EventLog, LogSpec, Setting, column_kinds, get_all_logs
from caselake.plans.order import with_index
from caselake.queries.common import dialog, events, folder, long_text, ordering, r6, shipping
from caselake.registry import DI, EV, SH, query
from caselake.sources import logs as src
from caselake.sources import results as rs

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@query("SELECT case_id, activity, time, tie, round(value, 6) + 0.0 AS value FROM ev", "ev")
def s001_load_delimited(spark, d):
    """Write the log as delimited text and load it again under a schema."""
    at = folder(spark, "csv")
    log = events(spark, d).df.select("case_id", "activity", "time", "tie", "value")
    log.write.options(header=True, timestampNTZFormat=MICROS).csv(at)
    return src.read_delimited(spark, at, "case_id long, activity string, time timestamp_ntz, tie long, value double", time_format=MICROS).withColumn("value", r6("value"))


@query("SELECT * FROM (VALUES ('case_id', 'categorical'), ('activity', 'categorical'), ('time', 'categorical'), ('resource', 'categorical'), ('value', 'numeric'), ('tie', 'categorical')) t(name, kind), (SELECT count(*) AS n FROM events)")
def s002_column_kinds(spark, d):
    log = events(spark, d)
    kinds = spark.createDataFrame(list(column_kinds(log.df).items()), "name string, kind string")
    return kinds.join(log.df.agg(F.count("*").alias("n")))


@query("SELECT case_id, activity, time, resource, line FROM sh", "sh")
def s003_named_log(spark, d):
    return shipping(spark, d).df.select("case_id", "activity", "time", "resource", "line")


@query(
    """SELECT log, count(*) AS n, count(DISTINCT case_id) AS cases, count(price) AS prices FROM (
    SELECT 'events' AS log, case_id, NULL AS price FROM ev UNION ALL SELECT 'shipping', case_id, price FROM sh UNION ALL SELECT 'ordering', case_id, price FROM od UNION ALL SELECT 'dialog', case_id, NULL FROM di) GROUP BY log""",
    "ev", "sh", "od", "di",
)
def s004_all_logs(spark, d):
    return get_all_logs(spark, d).groupBy("log").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), F.count("price").alias("prices"))


@query(f"SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(row_number() OVER w - 1 AS BIGINT) AS position, activity, resource FROM ev {EV}", "ev")
def s005_xes_write_and_read(spark, d):
    """Write the log as XES and load it again (12, 5)."""
    at = folder(spark, "xes")
    src.write_xes(events(spark, d), at)
    return src.read_xes(spark, at).select("case_id", F.col("position").cast("long").alias("position"), "activity", "resource")


@query(f"SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(row_number() OVER w - 1 AS BIGINT) AS position, activity FROM ev {EV}", "ev")
def s006_xes_names(spark, d):
    at = folder(spark, "xes")
    src.write_xes(events(spark, d), at)
    return src.read_xes(spark, at, names_only=True).select("case_id", F.col("position").cast("long").alias("position"), "activity")


@query(f"SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(row_number() OVER w - 1 AS BIGINT) AS position, activity, 'complete' AS lifecycle, resource FROM ev {EV}", "ev")
def s007_mxml_write_and_read(spark, d):
    """Write the log as MXML and load it again (7)."""
    at = folder(spark, "mxml")
    src.write_mxml(events(spark, d), at)
    return src.read_mxml(spark, at).select("case_id", F.col("position").cast("long").alias("position"), "activity", "lifecycle", "resource")


@query("SELECT case_id, activity, time AS start, time + INTERVAL 1 HOUR AS \"end\" FROM ev", "ev")
def s008_start_end_columns(spark, d):
    at = folder(spark, "csv")
    one = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    log = events(spark, d).df
    log.select("tie", "activity", "case_id", one("time").alias("s"), one(F.col("time") + F.expr("INTERVAL 1 HOUR")).alias("e")).write.option("header", True).csv(at)
    out = src.read_start_end(spark, at, {"case_id": 2, "activity": 1, "start": 3, "end": 4}, time_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.withColumn("case_id", F.col("case_id").cast("long"))


@query("SELECT case_id, time, tie, round(value, 6) + 0.0 AS value FROM ev", "ev")
def s009_compressed_text(spark, d):
    at = folder(spark, "gz")
    events(spark, d).df.select("case_id", "time", "tie", "value").write.options(header=True, compression="gzip", timestampNTZFormat=MICROS).csv(at)
    return src.read_delimited(spark, at, "case_id long, time timestamp_ntz, tie long, value double", time_format=MICROS).withColumn("value", r6("value"))


@query("WITH d AS (SELECT activity, dense_rank() OVER (ORDER BY activity) AS activity_id FROM (SELECT DISTINCT activity FROM ev)) SELECT case_id, activity_id, date_trunc('second', time) AS time FROM ev JOIN d USING (activity)", "ev")
def s010_normalise(spark, d):
    log = events(spark, d).df.withColumn("t", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return src.normalise(log, "case_id", "activity", "t")


@query("WITH d AS (SELECT activity, dense_rank() OVER (ORDER BY activity) AS id FROM (SELECT DISTINCT activity FROM ev)), r AS (SELECT coalesce(resource, 'nan') AS resource, dense_rank() OVER (ORDER BY coalesce(resource, 'nan')) AS rid FROM (SELECT DISTINCT resource FROM ev)) SELECT tie, d.id AS activity, r.rid AS resource FROM ev JOIN d USING (activity) JOIN r ON coalesce(ev.resource, 'nan') = r.resource", "ev")
def s011_write_encoded(spark, d):
    at = folder(spark, "encoded")
    src.write_encoded(events(spark, d), at)
    return src.read_delimited(spark, at, "case_id long, activity long, time string, resource long, value double, tie long").select("tie", "activity", "resource")


@query("SELECT case_id, score, label FROM (SELECT CAST(case_id AS VARCHAR) AS case_id, round(avg(value), 6) + 0.0 AS score, CAST(max(value) > 99 AS INTEGER) AS label FROM ev GROUP BY case_id)", "ev")
def s013_write_and_read_scores(spark, d):
    """Write sorted scores and load them under a schema (13, 16)."""
    at = folder(spark, "scores")
    rs.write_scores(events(spark, d).df.groupBy("case_id").agg(r6(F.avg("value")).alias("score"), (F.max("value") > 99).cast("int").alias("label")), at)
    return rs.read_scores(spark, at)


@query("SELECT method, data, count(*) AS n FROM (SELECT 'counts' AS method, 'events' AS data FROM ev UNION ALL SELECT 'linear', 'ordering' FROM od) GROUP BY method, data", "ev", "od")
def s014_predictions_by_setting(spark, d):
    """Write results of experiments by setting, read them with pruning, and list what is missing (14, 15)."""
    at = folder(spark, "predictions")
    for method, name, log in (("counts", "events", events(spark, d)), ("linear", "ordering", ordering(spark, d))):
        rs.write_predictions(rs.tag(log.df.select("activity"), Setting(), method, name), at)
    return rs.read_predictions(spark, at).groupBy("method", "data").agg(F.count("*").alias("n"))


@query("SELECT 'events' AS data, m AS method FROM (VALUES ('linear'), ('other')) t(m), (SELECT count(*) FROM ev)", "ev")
def s015_unfinished_experiments(spark, d):
    at = folder(spark, "predictions")
    rs.write_predictions(rs.tag(events(spark, d).df.select("activity"), Setting(), "counts", "events"), at)
    grid = rs.tag(spark.createDataFrame([("counts",), ("linear",), ("other",)], "m string"), Setting(), "x", "events").withColumn("method", F.col("m"))
    return rs.unfinished(grid, spark, at).select("data", "method")


@query(f"SELECT tie, activity, coalesce(lag(activity) OVER w, '0') AS activity_Prev0 FROM ev {EV}", "ev")
def s018_cached_preparation(spark, d):
    at = folder(spark, "cache")
    setting = Setting(k=1)
    for _ in range(2):
        df = rs.cached(cx.k_context(events(spark, d), 1, ["activity"]), at, setting)
    return df.select("tie", "activity", "activity_Prev0")


@query("SELECT case_id, time, tie, activity FROM ev", "ev")
def s019_keep_attributes(spark, d):
    return pr.keep_attributes(events(spark, d), ["activity"]).df


@query("SELECT case_id, activity, time, tie FROM ev", "ev")
def s020_remove_attributes(spark, d):
    return pr.remove_attributes(events(spark, d), ["res", "val"]).df


@query("SELECT tie, value FROM ev WHERE value > 50 AND activity <> 'click'", "ev")
def s021_filter_rows(spark, d):
    return pr.filter_rows(events(spark, d), "value > 50 AND activity <> 'click'").df.select("tie", "value")


@query("SELECT case_id, line, part, resource, quantity, price FROM sh WHERE case_id IN (SELECT case_id FROM sh GROUP BY case_id HAVING count(*) > 4)", "sh")
def s023_case_length(spark, d):
    return pr.filter_case_length(shipping(spark, d), 4).df.select("case_id", "line", "part", "resource", "quantity", "price")


@query("SELECT 'activity' AS \"column\", activity AS value, dense_rank() OVER (ORDER BY activity) AS id FROM (SELECT DISTINCT activity FROM ev) UNION ALL SELECT 'resource', v, dense_rank() OVER (ORDER BY v) FROM (SELECT DISTINCT coalesce(resource, 'nan') AS v FROM ev)", "ev")
def s024_dictionary(spark, d):
    return pr.dictionary(events(spark, d).df, ["activity", "resource"])


@query(
    """WITH a AS (SELECT DISTINCT coalesce(resource, 'nan') AS v FROM ev WHERE tie < 60), k AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM a),
    n AS (SELECT v FROM (SELECT DISTINCT coalesce(resource, 'nan') AS v FROM ev) WHERE v NOT IN (SELECT v FROM a))
    SELECT 'resource' AS "column", v AS value, id FROM k UNION ALL SELECT 'resource', v, row_number() OVER (ORDER BY v) + (SELECT max(id) FROM k) FROM n""",
    "ev",
)
def s025_dictionary_growth(spark, d):
    df = events(spark, d).df
    return pr.dictionary(df, ["resource"], pr.dictionary(df.where("tie < 60"), ["resource"]))


@query("SELECT 'resource' AS \"column\", v AS value, row_number() OVER (ORDER BY m, v) AS id FROM (SELECT coalesce(resource, 'nan') AS v, min(tie) AS m FROM ev GROUP BY 1)", "ev")
def s026_first_seen_dictionary(spark, d):
    return pr.first_seen_dictionary(events(spark, d).df, ["resource"], ["tie"])


@query("WITH d AS (SELECT activity, dense_rank() OVER (ORDER BY activity) AS id FROM (SELECT DISTINCT activity FROM ev WHERE activity <> 'click')) SELECT tie, id AS activity, d.activity AS name FROM ev LEFT JOIN d USING (activity)", "ev")
def s027_value_and_id(spark, d):
    df = events(spark, d).df.select("tie", "activity")
    words = pr.dictionary(df.where("activity <> 'click'"), ["activity"])
    return pr.decode(pr.encode(df, ["activity"], words), "activity", words, "name")


@query("SELECT case_id, arg_min(activity, (time, tie)) AS activity FROM ev GROUP BY case_id", "ev")
def s029_case_labels(spark, d):
    return pr.case_labels(events(spark, d), "activity")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM ev WHERE tie % 2 = 0) SELECT tie, CAST(CASE WHEN value < lo OR value > hi THEN NULL ELSE least(greatest(ceil((value - lo) / ((hi - lo) / 25)) - 1, 0), 24) END AS BIGINT) AS bin FROM ev, e", "ev")
def s030_discretize(spark, d):
    df = events(spark, d).df
    return pr.discretize(df, "value", pr.bin_edges(df.where("tie % 2 = 0"), "value"), output="bin").select("tie", "bin")


@query("SELECT tie, 'r_' || coalesce(resource, 'nan') AS resource, 'wd_' || CAST(isodow(time) - 1 AS VARCHAR) AS weekday FROM ev", "ev")
def s031_prefix_and_weekday(spark, d):
    df = pr.add_prefix(events(spark, d).df, "resource", "r_").withColumn("weekday", F.weekday("time"))
    return pr.add_prefix(df, "weekday", "wd_").select("tie", "resource", "weekday")


@query("SELECT tie, CAST(case_id IN (SELECT case_id FROM ev GROUP BY case_id HAVING max(value) > 200) AS INTEGER) AS label FROM ev", "ev")
def s032_label_by_membership(spark, d):
    log = events(spark, d)
    return pr.label_by_membership(log, log.df.groupBy("case_id").agg(F.max("value").alias("m")).where("m > 200")).select("tie", "label")


@query("SELECT case_id, activity, time, tie FROM ev UNION ALL SELECT case_id, 'end', max(time), arg_max(tie, (time, tie)) FROM ev GROUP BY case_id", "ev")
def s033_end_events(spark, d):
    return cx.add_end_events(events(spark, d)).df.select("case_id", "activity", "time", "tie")


@query("SELECT case_id, activity, time FROM ev UNION ALL SELECT case_id, 'end', max(time) FROM ev GROUP BY case_id UNION ALL SELECT case_id, 'start', min(time) FROM ev GROUP BY case_id", "ev")
def s034_start_and_end_events(spark, d):
    return cx.add_end_events(events(spark, d), start=True).df.select("case_id", "activity", "time")


@query("WITH l AS (SELECT *, lag(activity) OVER w AS p, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)) SELECT tie, activity FROM l WHERE rn = 1 OR p <> activity", "ev")
def s035_drop_repeats(spark, d):
    return cx.drop_repeats(events(spark, d), ["activity"]).df.select("tie", "activity")


@query(
    """WITH l AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(activity) OVER w <> activity THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY case_id ORDER BY time, tie) AS BIGINT) AS run FROM l)
    SELECT case_id, run, any_value(activity) AS activity, min(time) AS start, max(time) AS "end", count(*) AS events FROM r GROUP BY case_id, run""",
    "ev",
)
def s036_reduce_loops(spark, d):
    return cx.reduce_loops(events(spark, d), ["activity"])


def _draw(most: int, *parts: str) -> str:
    """``functions.columns.draw`` in SQL."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) % {most} AS BIGINT)"


def _injected(where: str = "true") -> str:
    h = lambda salt: _draw(1_000_000, "42", f"'{salt}'", "case_id")
    return f"""x AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY case_id) AS n, {h("case")} < 100000 AS hit, {h("kind")} % 4 AS kind FROM ev WHERE {where} WINDOW w AS (PARTITION BY case_id ORDER BY time, tie)),
    y AS (SELECT *, {h("place")} % greatest(n - CASE WHEN kind = 0 THEN 1 ELSE 0 END, 1) + 1 AS place FROM x),
    z AS (SELECT case_id, tie, CASE WHEN hit AND kind = 0 AND pos = place AND n > 1 THEN lead(activity) OVER w WHEN hit AND kind = 0 AND pos = place + 1 THEN lag(activity) OVER w WHEN hit AND kind = 1 AND pos = place THEN 'new_' || activity ELSE activity END AS activity,
        CASE WHEN hit AND kind = 2 AND pos = place THEN time + to_days(CAST({h("days")} % 6 + 1 AS INTEGER)) ELSE time END AS time, CASE WHEN hit AND kind = 3 AND pos = place THEN 'new_' || resource ELSE resource END AS resource,
        CAST(hit AS INTEGER) AS anomaly, CASE WHEN NOT hit THEN 'none' ELSE ['swap', 'activity', 'weekday', 'resource'][kind + 1] END AS anomaly_kind FROM y WINDOW w AS (PARTITION BY case_id ORDER BY pos))"""


@query("WITH " + _injected() + " SELECT * FROM z", "ev")
def s038_inject_anomalies(spark, d):
    return ij.inject(events(spark, d)).select("case_id", "tie", "activity", "time", "resource", "anomaly", "anomaly_kind")


TEST_CASE = _draw(1_000_000, "42", "'split'", "case_id") + " >= 500000"


@query("WITH " + _injected(TEST_CASE) + f" SELECT *, 'test' AS split FROM z UNION ALL SELECT case_id, tie, activity, time, resource, 0, 'none', 'train' FROM ev WHERE NOT {TEST_CASE}", "ev")
def s039_injected_split(spark, d):
    return ij.injected_split(events(spark, d)).select("case_id", "tie", "activity", "time", "resource", "split", "anomaly", "anomaly_kind")


@query("SELECT CAST(case_id AS VARCHAR) AS case_id, activity, time, resource FROM ev", "ev")
def s012_write_xes(spark, d):
    """Times and resources as they were written; the order of events is that of their places in the trace."""
    at = folder(spark, "xes")
    src.write_xes(events(spark, d), at)
    return src.read_xes(spark, at).select("case_id", "activity", F.col("time").cast("timestamp_ntz").alias("time"), "resource")


@query("SELECT label, count(*) AS cases, round(min(score), 6) + 0.0 AS lowest, round(max(score), 6) + 0.0 AS highest FROM (SELECT round(sum(quantity), 6) AS score, CAST(count(*) > 4 AS INTEGER) AS label FROM sh GROUP BY case_id) GROUP BY label", "sh")
def s016_read_scores(spark, d):
    """Scores of another log, read under their schema and summed up by label."""
    at = folder(spark, "scores")
    scores = shipping(spark, d).df.groupBy("case_id").agg(r6(F.sum("quantity").cast("double")).alias("score"), (F.count("*") > 4).cast("int").alias("label"))
    rs.write_scores(scores, at)
    return rs.read_scores(spark, at).groupBy("label").agg(F.count("*").alias("cases"), r6(F.min("score")).alias("lowest"), r6(F.max("score")).alias("highest"))


@query("SELECT 'kept' AS log, count(*) AS n FROM ev WHERE resource IS NOT NULL AND CAST(resource AS INTEGER) < 50 UNION ALL SELECT 'all', count(*) FROM ev", "ev")
def s022_filter_to_copy(spark, d):
    """A filtered copy beside the log, which stays as it was."""
    log = events(spark, d)
    kept = pr.filter_rows(log, "resource IS NOT NULL AND CAST(resource AS INTEGER) < 50")
    count = lambda df, name: df.agg(F.lit(name).alias("log"), F.count("*").alias("n"))
    return count(kept.df, "kept").unionByName(count(log.df, "all"))


@query("SELECT case_id, part, line, CAST(resource AS BIGINT) AS supplier, s_nationkey AS role FROM sh LEFT JOIN supplier ON resource = s_suppkey", "sh")
def s041_events_with_roles(spark, d):
    """Lines of orders with the nation of their supplier, as the role of a resource (left equi-join)."""
    roles = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("resource"), F.col("s_nationkey").alias("role"))
    return shipping(spark, d).df.join(roles, "resource", "left").select("case_id", "part", "line", F.col("resource").cast("long").alias("supplier"), "role")


@query(f"SELECT tie, coalesce(lag(activity, 1) OVER w, '0') AS activity_Prev0, coalesce(lag(activity, 2) OVER w, '0') AS activity_Prev1, round(coalesce(lag(value, 1) OVER w, 0), 6) + 0.0 AS value_Prev0, case_id AS case_id_Prev1 FROM ev {EV}", "ev")
def s120_k_context(spark, d):
    df = cx.k_context(events(spark, d), 2)
    return df.select("tie", "activity_Prev0", "activity_Prev1", r6("value_Prev0").alias("value_Prev0"), "case_id_Prev1")


@query(f"SELECT line, part, resource, quantity, price, case_id, lag(activity, 1, '0') OVER w AS activity_Prev0 FROM sh {SH}", "sh")
def s040_context_of_shipping(spark, d):
    return cx.k_context(shipping(spark, d), 1, ["activity"]).select("line", "part", "resource", "quantity", "price", "case_id", "activity_Prev0")


@query(f"SELECT tie, round(coalesce((epoch_us(time) - epoch_us(lag(time, 1) OVER w)) / 1e6, 0), 3) + 0.0 AS duration_0, round(coalesce((epoch_us(time) - epoch_us(lag(time, 2) OVER w)) / 1e6, 0), 3) + 0.0 AS duration_1 FROM ev {EV}", "ev")
def s121_duration_context(spark, d):
    df = cx.duration_context(events(spark, d))
    return df.select("tie", (F.round("duration_0", 3) + 0.0).alias("duration_0"), (F.round("duration_1", 3) + 0.0).alias("duration_1"))


@query(f"SELECT tie, string_agg(activity, '>') OVER (PARTITION BY case_id ORDER BY time, tie) AS trace FROM ev", "ev")
def s122_trace_so_far(spark, d):
    return cx.trace_so_far(events(spark, d)).select("tie", "trace")


@query(
    """WITH a AS (SELECT *, coalesce(epoch(time) - epoch(lag(time) OVER (PARTITION BY case_id ORDER BY time, tie)), 0) / 86400 AS duration FROM ev)
    SELECT tie, round(duration, 6) + 0.0 AS duration, round(coalesce(sum(duration) OVER (PARTITION BY case_id ORDER BY time, tie ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) + 0.0 AS remaining FROM a""",
    "ev",
)
def s123_remaining_time(spark, d):
    return cx.remaining_time(events(spark, d)).select("tie", r6("duration").alias("duration"), r6("remaining").alias("remaining"))


@query(f"SELECT tie, round(value, 3) + 0.0 AS processing, round(coalesce((epoch_us(time) - epoch_us(lag(time + to_microseconds(CAST(round(value * 1000000) AS BIGINT))) OVER w)) / 1e6, 0), 3) + 0.0 AS waiting FROM ev {EV}", "ev")
def s124_processing_times(spark, d):
    df = events(spark, d).df.withColumn("end", F.col("time") + F.make_dt_interval(secs=F.round("value", 6).cast("decimal(18,6)")))
    out = cx.processing_times(df.withColumnRenamed("time", "start"), "case_id", ["start", "tie"])
    return out.select("tie", (F.round("processing", 3) + 0.0).alias("processing"), (F.round("waiting", 3) + 0.0).alias("waiting"))


@query("SELECT case_id, turn, string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY turn) AS prefix, coalesce(string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS suffix FROM di".replace("turn, string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY turn) AS prefix", "row_number() OVER (PARTITION BY case_id ORDER BY turn) AS prefix_size, string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY turn) AS prefix"), "di")
def s109_prefixes_and_suffixes(spark, d):
    return cx.prefixes_and_suffixes(dialog(spark, d)).select("case_id", "prefix_size", long_text("prefix").alias("prefix"), long_text("suffix").alias("suffix"))


@query("SELECT case_id, string_agg(activity, ',' ORDER BY time, tie) AS activity, count(*) AS length FROM ev GROUP BY case_id", "ev")
def s051_traces(spark, d):
    return cx.traces(events(spark, d)).select("case_id", long_text("activity").alias("activity"), "length")


PAIRS = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY time, tie) AS rn FROM ev),
    e AS (SELECT *, 'k' || CAST(((rn + 1) // 2) % 3 AS VARCHAR) AS task, CASE WHEN rn % 2 = 1 THEN 'start' ELSE 'complete' END AS kind FROM m)"""


def start_and_complete(spark, d):
    """Events in turn as starts and completions of one of three tasks."""
    log = events(spark, d)
    rn = F.row_number().over(log.window())
    return log.df.withColumn("task", F.concat(F.lit("k"), (F.floor((rn + 1) / 2) % 3).cast("string"))).withColumn("kind", F.when(rn % 2 == 1, "start").otherwise("complete"))


@query(
    PAIRS + """, n AS (SELECT case_id, task, kind, time, row_number() OVER (PARTITION BY case_id, task, kind ORDER BY time, tie) AS nth FROM e),
    a AS (SELECT * FROM n WHERE kind = 'start'), b AS (SELECT * FROM n WHERE kind = 'complete'),
    p AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.task, b.task) AS task, coalesce(a.nth, b.nth) AS nth, a.time AS start, b.time AS "end" FROM a FULL JOIN b ON a.case_id = b.case_id AND a.task = b.task AND a.nth = b.nth),
    w AS (SELECT case_id FROM p GROUP BY case_id HAVING bool_and(start IS NOT NULL AND "end" IS NOT NULL)) SELECT * FROM p WHERE case_id IN (SELECT case_id FROM w)""",
    "ev",
)
def s047_pair_start_complete(spark, d):
    df = start_and_complete(spark, d)
    return cx.pair_start_complete(df, "case_id", "task", "kind", ["time", "tie"], "time").withColumn("nth", F.col("nth").cast("long"))


@query(
    PAIRS + """, n AS (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY time, tie) AS nth FROM e)
    SELECT a.case_id, a.nth, a.task, a.time AS start, b.time AS "end" FROM n a JOIN n b ON a.case_id = b.case_id AND a.nth = b.nth WHERE a.kind = 'start' AND b.kind = 'complete'""",
    "ev",
)
def s048_pair_by_position(spark, d):
    df = start_and_complete(spark, d)
    return cx.pair_by_position(df, "case_id", "kind", ["time", "tie"], ["task"], "time").withColumn("nth", F.col("nth").cast("long"))


@query("SELECT tie FROM ev WHERE case_id IN (SELECT case_id FROM ev WHERE value > 200)", "ev")
def s050_keep_cases(spark, d):
    log = events(spark, d)
    return pr.keep_cases(log, log.df.where("value > 200")).df.select("tie")


ORDERED = "WITH o AS (SELECT *, row_number() OVER (ORDER BY time, tie, case_id) - 1 AS i, count(*) OVER () AS n FROM ev)"


@query(ORDERED + " SELECT tie, CASE WHEN i < ceil(n * 0.66) THEN 'train' ELSE 'test' END AS split FROM o", "ev")
def s136_split_events(spark, d):
    return pr.split_events(events(spark, d), 66).select("tie", "split")


@query(ORDERED + " SELECT tie, CASE WHEN i < ceil(n * (1 - 0.75)) THEN 'test' ELSE 'train' END AS split FROM o", "ev")
def s136_split_events_test_first(spark, d):
    return pr.split_events(events(spark, d), 75, "test-train").select("tie", "split")


CASES = "WITH c AS (SELECT case_id, row_number() OVER (ORDER BY m.time, m.tie, case_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT case_id, min({'time': time, 'tie': tie}) AS m FROM ev GROUP BY case_id))"


@query(CASES + " SELECT tie, CASE WHEN i < round_even(n * 0.7, 0) THEN 'train' ELSE 'test' END AS split FROM ev JOIN c USING (case_id)", "ev")
def s137_split_cases(spark, d):
    return pr.split_cases(events(spark, d), 70).select("tie", "split")


@query(CASES + " SELECT tie, CASE WHEN i < round_even(n * 0.3, 0) THEN 'test' ELSE 'train' END AS split FROM ev JOIN c USING (case_id)", "ev")
def s138_split_cases_test_first(spark, d):
    return pr.split_cases(events(spark, d), 30, test_first=True).select("tie", "split")


@query(f"SELECT tie, CASE WHEN share < 800 THEN 'train' WHEN share < 860 THEN 'valid' ELSE 'test' END AS split FROM (SELECT tie, {_draw(1000, '42', 'tie')} AS share FROM ev)", "ev")
def s139_split_three(spark, d):
    return pr.split_three(events(spark, d).df, ["tie"]).select("tie", "split")


@query("SELECT tie, CAST(ntile(3) OVER (ORDER BY time, tie, case_id) - 1 AS BIGINT) AS fold FROM ev", "ev")
def s140_folds(spark, d):
    return pr.folds(events(spark, d), 3).select("tie", "fold")


@query("SELECT fold = 1 AS held, count(*) AS n FROM (SELECT ntile(3) OVER (ORDER BY time, tie, case_id) - 1 AS fold FROM ev) GROUP BY 1", "ev")
def s141_fold_split(spark, d):
    return pr.fold_split(pr.folds(events(spark, d), 3), 1).groupBy((F.col("split") == "test").alias("held")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT tie, CAST(isoyear(time) AS VARCHAR) || '/' || lpad(CAST(weekofyear(time) AS VARCHAR), 2, '0') AS batch_id FROM ev) SELECT tie, batch_id, CAST(dense_rank() OVER (ORDER BY batch_id) - 1 AS BIGINT) AS batch FROM b", "ev")
def s143_weekly_batches(spark, d):
    return pr.batches(events(spark, d), "week").select("tie", "batch_id", "batch")


@query("SELECT case_id, tie, strftime(time, '%Y/%m') AS batch_id, CAST(dense_rank() OVER (ORDER BY strftime(time, '%Y/%m')) - 1 AS BIGINT) AS batch FROM od", "od")
def s143_monthly_batches(spark, d):
    return pr.batches(ordering(spark, d), "month").select("case_id", "tie", "batch_id", "batch")


@query("SELECT tie, CAST(isoyear(time) AS VARCHAR) || '/' || lpad(CAST(weekofyear(time) AS VARCHAR), 2, '0') || '/' || CAST(isodow(time) AS VARCHAR) AS batch_id FROM ev", "ev")
def s143_daily_batches(spark, d):
    return pr.batches(events(spark, d), "day").select("tie", "batch_id")


@query("WITH a AS (SELECT tie, isoyear(time) * 100 + weekofyear(time) AS w FROM ev) SELECT tie, CASE WHEN w = 202403 THEN 'test' ELSE 'train' END AS split FROM a WHERE w <= 202403 AND w >= 202402", "ev")
def s144_split_week(spark, d):
    return pr.split_week(events(spark, d), 2024, 3, (2024, 2)).select("tie", "split")


@query("SELECT batch, min(time) AS first_time, count(*) AS n FROM (SELECT time, CAST(dense_rank() OVER (ORDER BY isoyear(time), weekofyear(time)) - 1 AS BIGINT) AS batch FROM ev) GROUP BY batch", "ev")
def s145_batch_access(spark, d):
    return pr.batches(events(spark, d), "week").groupBy("batch").agg(F.min("time").alias("first_time"), F.count("*").alias("n"))


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY time, tie) - 1 AS i FROM ev) SELECT tie, CASE WHEN i < 5000 THEN 'train' ELSE 'test' END AS split FROM o WHERE i >= 5000 OR value <= 100", "ev")
def s146_first_rows_train(spark, d):
    return pr.first_rows_train(events(spark, d).df, ["time", "tie"], 5000, "value <= 100").select("tie", "split")


@query(
    """WITH f AS (SELECT * FROM ev WHERE case_id IN (SELECT case_id FROM ev GROUP BY case_id HAVING count(*) > 60)),
    e AS (SELECT case_id, activity, time, tie, 0 AS r FROM f UNION ALL SELECT case_id, 'end', max(time), arg_max(tie, (time, tie)), 1 FROM f GROUP BY case_id),
    k AS (SELECT *, coalesce(lag(activity) OVER (PARTITION BY case_id ORDER BY r, time, tie), '0') AS p FROM e),
    o AS (SELECT *, row_number() OVER (ORDER BY r, time, tie, case_id) - 1 AS i, count(*) OVER () AS n FROM k)
    SELECT case_id, activity, p AS activity_Prev0, tie, CASE WHEN i < ceil(n * 0.66) THEN 'train' ELSE 'test' END AS split FROM o""",
    "ev",
)
def s147_prepare(spark, d):
    log = pr.prepare(events(spark, d), Setting(k=1, add_end=True, longer_than=60))
    return log.df.select("case_id", "activity", "activity_Prev0", "tie", "split")


@query("SELECT case_id, tie FROM ev UNION ALL SELECT case_id, tie FROM od", "ev", "od")
def s150_append_logs(spark, d):
    return pr.combine([events(spark, d).df.select("case_id", "tie"), ordering(spark, d).df.select("case_id", "tie")])


@query("SELECT case_id, count(*) AS n FROM (SELECT case_id FROM ev UNION ALL SELECT case_id FROM od UNION ALL SELECT case_id FROM di) GROUP BY case_id", "ev", "od", "di")
def s151_combine_logs(spark, d):
    return pr.combine([f(spark, d).df.select(F.col("case_id").cast("long").alias("case_id")) for f in (events, ordering, dialog)]).groupBy("case_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT case_id FROM od WHERE case_id NOT IN (SELECT case_id FROM ev)", "ev", "od")
def s152_difference(spark, d):
    return pr.difference(ordering(spark, d).df.select("case_id").distinct(), events(spark, d).df, ["case_id"])


@query("SELECT round(count(*) FILTER (WHERE activity = 'click' AND value > 50)::DOUBLE / count(*) FILTER (WHERE value > 50), 6) + 0.0 AS p FROM ev", "ev")
def s153_conditional_probability(spark, d):
    return pr.conditional_probability(events(spark, d).df, "activity = 'click'", "value > 50").select(r6("p").alias("p"))


@query("SELECT DISTINCT activity, resource FROM ev", "ev")
def s154_distinct_configurations(spark, d):
    return events(spark, d).df.select("activity", "resource").dropDuplicates()


@query("SELECT tie, CAST(row_number() OVER (ORDER BY time, case_id, tie) - 1 AS BIGINT) AS idx FROM ev", "ev")
def s155_order_by_time(spark, d):
    return with_index(events(spark, d).df, "time", "case_id", "tie").select("tie", "idx")


@query("SELECT tie, time FROM ev ORDER BY time, tie LIMIT 100", "ev")
def s158_row_limit(spark, d):
    return events(spark, d).df.select("tie", "time").orderBy("time", "tie").limit(100)


@query("SELECT vec_id AS case_id, round(CAST(embedding[1] AS DOUBLE), 5) + 0.0 AS x FROM embeddings WHERE label = 1")
def s196_expression_filter_without_cases(spark, d):
    """A log without cases: each row is a unit (table of vectors)."""
    log = EventLog(spark.read.parquet(f"{d}/embeddings.parquet"), LogSpec(case=None, activity="label", order=("vec_id",), time=None, k=0))
    return pr.filter_rows(log, "label = 1").df.select(F.col("vec_id").alias("case_id"), (F.round(F.col("embedding")[0].cast("double"), 5) + 0.0).alias("x"))
