"""Results worked out by hand on logs of a few events."""

import datetime as dt
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselake.functions.columns import draw, parse_time
from caselake.functions.edit import damerau_between, damerau_distances, damerau_near, timed_distances
from caselake.operators import context as cx
from caselake.operators import classify, density, drift, graph, inject, methods, metrics, model, predict, prepare, similarity, statistics, stats, structure, suffix
from caselake.plans.log import EventLog, LogSpec, column_kinds
from caselake.plans.order import with_index, with_running
from caselake.queries import models
from caselake.sources import logs as sources


def log_of(spark, rows, k=2):
    """(case, activity[, resource]) rows in order of time."""
    start = dt.datetime(2024, 1, 1)
    data = [(r[0], r[1], r[2] if len(r) > 2 else "r", start + dt.timedelta(hours=i), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "case_id string, activity string, resource string, time timestamp_ntz, tie long")
    return EventLog(df, LogSpec(order=("time", "tie"), resource="resource", categorical=("activity", "resource"), k=k))


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_k_context_pads_with_zero_and_stays_in_the_case(spark):
    out = cx.k_context(log_of(spark, [("a", "x"), ("a", "y"), ("b", "z"), ("a", "w")]))
    assert table(out, "tie", "activity_Prev0", "activity_Prev1") == [(0, "0", "0"), (1, "x", "0"), (2, "0", "0"), (3, "y", "x")]


def test_kinds_by_type(spark):
    df = spark.createDataFrame([(1, 1.0, "a")], "i long, f double, s string")
    assert column_kinds(df) == {"i": "categorical", "f": "numeric", "s": "categorical"}
    assert column_kinds(df, numeric=("i",))["i"] == "numeric"


def test_case_length_is_strict(spark):
    log = log_of(spark, [("a", "x"), ("a", "y"), ("b", "z")])
    assert table(prepare.filter_case_length(log, 1).df, "case_id") == [("a",), ("a",)]
    assert prepare.filter_case_length(log, 2).df.count() == 0


def test_dictionary_keeps_old_ids(spark):
    log = log_of(spark, [("a", "m"), ("a", "c")])
    old = prepare.dictionary(log.df, ["activity"])
    new = prepare.dictionary(log_of(spark, [("a", "a"), ("a", "m"), ("a", "z")]).df, ["activity"], old)
    assert table(new, "value", "id") == [("a", 3), ("c", 1), ("m", 2), ("z", 4)]
    nothing = prepare.dictionary(log.df.limit(0), ["activity"])
    assert nothing.count() == 0


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (2.0,), (3.0,)], "x double")
    edges = spark.createDataFrame([(0.0, 2.0)], "low double, high double")
    assert [r.x_bin for r in prepare.discretize(df, "x", edges, 2).orderBy("x").collect()] == [0, 0, 1, 1, None]


def test_end_event_comes_last_even_at_equal_times(spark):
    log = cx.add_end_events(log_of(spark, [("a", "x"), ("a", "y")]), start=True)
    rows = log.df.withColumn("n", F.row_number().over(log.window()))
    assert [r.activity for r in rows.orderBy("n").collect()] == ["start", "x", "y", "end"]


def test_repeats_and_loops(spark):
    log = log_of(spark, [("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("a", "y"), ("a", "x")])
    assert table(cx.drop_repeats(log).df, "tie") == [(0,), (2,), (5,)]
    assert table(cx.reduce_loops(log), "run", "activity", "events") == [(1, "x", 2), (2, "y", 3), (3, "x", 1)]
    assert table(stats.repeat_lengths(log), "activity", "length") == [("x", 3), ("y", 4)]  # the last run isn't counted


def test_dependency_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a")], "parent string, child string")
    assert table(model.dependency_table(df, "parent", "child"), "parent_value", "value", "violation") == [("p", "a", 0.5)]


def test_probabilities_sum_to_one(spark):
    df = cx.k_context(log_of(spark, [("a", x) for x in "xyxyzzyx"]))
    t = model.conditional_table(df, "activity", ["activity_Prev0"])
    assert all(abs(r.s - 1) < 1e-9 for r in t.groupBy("parents").agg(F.sum("p").alias("s")).collect())


def test_update_adds_counts(spark):
    df = cx.k_context(log_of(spark, [("a", x) for x in "xyxyzzyx"]))
    parts = [model.conditional_table(df.where(f"tie % 2 = {i}"), "activity", ["activity_Prev0"]) for i in (0, 1)]
    whole = model.conditional_table(df, "activity", ["activity_Prev0"])
    assert table(model.update_table(*parts), "parents", "value", "n") == table(whole, "parents", "value", "n")


def test_scores_of_the_three_branches_and_no_side_effect(spark):
    train = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "b")], "parent string, x string")
    test = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "q", "a"), (4, "new", "a"), (5, "p", "c")], "id int, parent string, x string")
    nodes = model.train(train, {"x": (["parent"], [])})
    r, v = 0.5, 0.5
    want = {1: (1 - r) * 2 / 3 * (1 - v), 2: (1 - r) / 3 * (1 - v), 3: (1 - r) * r * (1 - v), 4: r * (1 - v), 5: (1 - r) * r * v}
    for _ in range(2):
        got = {x["id"]: x["score_x"] for x in model.score_events(test, nodes).collect()}
        assert all(abs(got[i] - math.log(w)) < 1e-9 for i, w in want.items())


def test_backoff_in_three_ways(spark):
    train = spark.createDataFrame([("a", "c", "v"), ("a", "c", "v"), ("a", "d", "w"), ("b", "d", "w")], "p string, q string, y string")
    test = spark.createDataFrame([(1, "a", "c"), (2, "b", "c"), (3, "new", "d"), (4, "new", "new")], "id int, p string, q string")
    p = predict.predict(test, predict.backoff_tables(train, "y", ["p", "q"]), ["p", "q"], ["id"])
    got = {(r["id"], r["value"]): round(r["p"], 9) for r in p.collect()}
    # 1 exact; 2 both seen, not together: mean of P(y|q=c) and P(y|p=b); 3 one unseen: P(y|q=d); 4 none seen: the marginal
    assert got == {(1, "v"): 1.0, (2, "v"): 0.5, (2, "w"): 0.5, (3, "w"): 1.0, (4, "v"): 0.5, (4, "w"): 0.5}
    top = predict.most_likely(p, ["id"])
    assert table(top, "id", "predicted") == [(1, "v"), (2, "v"), (3, "w"), (4, "v")]


def test_backoff_without_training_rows(spark):
    train = spark.createDataFrame([], "p string, y string")
    test = spark.createDataFrame([(1, "a")], "id int, p string")
    p = predict.predict(test, predict.backoff_tables(train, "y", ["p"]), ["p"], ["id"])
    assert table(p, "id", "value", "p") == [(1, "0", 0.0)]


def test_follows_in_a_case_of_many_events(spark):
    """Not in time square in the length of a case: every activity is followed by each other one but at the end."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("case_id"), F.concat(F.lit("a"), F.col("id") % 30).alias("activity"), F.col("id").alias("time"))
    got = {(r["a"], r["b"]): r["n"] for r in stats.follows(EventLog(df, LogSpec(order=("time",)))).collect()}
    assert got == {(f"a{x}", f"a{y}"): n // 30 - (y <= x) for x in range(30) for y in range(30)}


def test_follows_counts_each_follower_once(spark):
    log = log_of(spark, [("a", x) for x in "xyyx"])
    assert table(stats.follows(log), "a", "b", "n") == [("x", "x", 1), ("x", "y", 1), ("y", "x", 2), ("y", "y", 1)]
    assert table(stats.follows(log, 1), "a", "b", "n") == [("x", "y", 1), ("y", "x", 1), ("y", "y", 1)]


def test_uncertainty_of_a_function_is_one_and_of_a_constant_zero(spark):
    df = spark.createDataFrame([("a1", "a", "c"), ("a2", "a", "c"), ("b1", "b", "c")], "x string, y string, z string")
    m = {(r.x, r.y): r.uncertainty for r in stats.mutual_information(df, [("x", "y"), ("y", "x"), ("x", "z")]).collect()}
    assert abs(m["x", "y"] - 1) < 1e-9 and m["y", "x"] < 0.9 and m["x", "z"] == 0


def test_roles_are_components_by_size(spark):
    vertices = spark.createDataFrame([(x,) for x in "abcdefg"], "vertex string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("f", "e")], "x string, y string")
    assert table(stats.components(vertices, edges), "vertex", "root") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e"), ("g", "g")]


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.7, 0.95])
def test_similar_profiles_lose_no_pair(spark, threshold):
    """Resources of one task, of a common one and few rare ones, of equal shares, and of the same count of everything."""
    rng = random.Random(int(threshold * 100))
    counts = {f"u{i}": {t: rng.randint(1, 9) for t in rng.sample("abcdefghij", rng.randint(1, 5))} | ({"z": rng.randint(1, 20)} if i % 2 else {}) for i in range(40)}
    counts |= {f"v{i}": {"z": i + 1} for i in range(8)} | {f"w{i}": {"a": 2 * i + 2, "z": 3 * i + 3} for i in range(4)} | {f"e{i}": dict.fromkeys("abcdefghijz", 3) for i in range(2)}
    rows = [(r, t) for r, c in counts.items() for t, n in c.items() for _ in range(n)]
    df = spark.createDataFrame([(r, t, i) for i, (r, t) in enumerate(rows)], "resource string, activity string, time long")
    log = EventLog(df, LogSpec(order=("time",), resource="resource"))
    vectors = {r: np.array([c.get(t, 0) for t in "abcdefghijz"], float) for r, c in counts.items()}
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(list(vectors.values()))
    names = list(vectors)
    want = {(x, y): r[i, j] for i, x in enumerate(names) for j, y in enumerate(names) if x < y and r[i, j] > threshold}
    got = {(e["x"], e["y"]): e["r"] for e in stats.similar_profiles(stats.resource_profile(log), threshold).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
    root = {x: x for x in names}
    for _ in names:
        for x, y in want:
            root[x] = root[y] = min(root[x], root[y])
    groups = {}
    for x in names:
        groups.setdefault(root[x], []).append(x)
    roles = {x: i for i, g in enumerate(sorted(groups.values(), key=lambda g: (-len(g), min(g))), 1) for x in g}
    assert {e["resource"]: e["role"] for e in stats.discover_roles(log, threshold).collect()} == roles


def test_similar_profiles_meet_in_blocks(spark, monkeypatch):
    """Several blocks and several products a block, with copies of profiles; no plan joins pairs of resources by a task."""
    monkeypatch.setattr(stats, "BLOCK", 7)
    monkeypatch.setattr(stats, "WIDE", 3)
    rng = random.Random(3)
    counts = {f"u{i:02}": [rng.randint(0, 6) for _ in range(8)] for i in range(30)}
    counts |= {f"v{i:02}": counts[f"u{i % 10:02}"] for i in range(25)}
    profile = spark.createDataFrame([(r, str(t), n) for r, c in counts.items() for t, n in enumerate(c) if n], "resource string, task string, n long")
    r = np.corrcoef(np.array(list(counts.values()), float))
    want = {(x, y): r[i, j] for i, x in enumerate(counts) for j, y in enumerate(counts) if x < y and r[i, j] > 0.5}
    found = stats.similar_profiles(profile, 0.5)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().analyzed().toString()
    rows = found.collect()
    assert len(rows) == len(want) and all(e["r"] == pytest.approx(want[e["x"], e["y"]]) for e in rows)


def test_a_block_that_meets_itself_in_another_order():
    rows = pd.DataFrame({"resource": list("abcd"), "places": [[0, 1], [0, 1], [1, 2], [0, 2]], "counts": [[1, 5], [2, 7], [3, 4], [5, 1]], "t": 3.0})
    counts = np.array([[1, 5, 0], [2, 7, 0], [0, 3, 4], [5, 0, 1]], float)
    rows["s"], rows["var"] = counts.sum(axis=1), (counts**2).sum(axis=1) - counts.sum(axis=1) ** 2 / 3
    r = np.corrcoef(counts)
    want = {(x, y) for i, x in enumerate("abcd") for j, y in enumerate("abcd") if i < j and r[i, j] > 0.01}
    for order in ([0, 1, 2, 3], [3, 1, 0, 2], [1, 2, 3, 0]):
        found = stats._block_pairs(0.01)((0, 0), rows, rows.iloc[order])
        assert set(zip(found["a"], found["b"], strict=True)) == want and len(found) == len(want)


def test_graph_edges_and_penalties(spark):
    log = log_of(spark, [("c1", "a", "r1"), ("c1", "b", "r1"), ("c2", "a", "r2"), ("c2", "b", "r1")])
    g = graph.edges(log)
    assert table(g.where("kind = 'resource'"), "a", "target", "likelihood") == [("a", "r_r1", 0.5), ("a", "r_r2", 0.5), ("b", "r_r1", 1.0)]
    m = graph.likelihood_model(log)
    known = {r.case_id: r.log_likelihood for r in graph.case_likelihood(log, m).collect()}
    assert known["c1"] == pytest.approx(math.log(0.5))
    odd = graph.case_likelihood(log_of(spark, [("x", "z", "r9"), ("x", "z", "r9")]), m).first()["log_likelihood"]
    last = 0.0
    for pun in (0.9, 0.95, 0.95) * 2:  # nothing is known: squared each time
        last = 2 * last + math.log(pun)
    assert odd == pytest.approx(last)


class Walk:
    """Likelihood graph of (case, a, r, w) rows as dictionaries; one case at a time, step by step."""

    def __init__(self, cases):
        rows = [(a, r, w, c[i + 1][0] if i + 1 < len(c) else None) for c in cases for i, (a, r, w) in enumerate(c)]
        share = lambda pairs: {(x, y): n / sum(m for (z, _), m in pairs.items() if z == x) for (x, y), n in pairs.items()}
        self.rows = rows
        self.edges = {("START", c[0][0]): 1.0 for c in cases}
        self.edges |= {((a,), r): p for (a, r), p in share(Counter((a, r) for a, r, _, _ in rows)).items()}
        self.edges |= {((a, r), w): p for ((a, r), w), p in share(Counter(((a, r), w) for a, r, w, _ in rows)).items()}
        self.edges |= {(x, n): p for (x, n), p in share(Counter(((a, r, w), n) for a, r, w, n in rows)).items() if n}

    def reached(self, a, depth):
        """Value -> summed likelihood of paths of a length from an activity."""
        out = Counter()
        for (n1, r), p1 in self.edges.items():
            if n1 == (a,):
                if depth == 1:
                    out[r] += p1
                for (n2, w), p2 in self.edges.items():
                    if n2 == (a, r) and depth > 1:
                        if depth == 2:
                            out[w] += p1 * p2
                        else:
                            for (n3, x), p3 in self.edges.items():
                                if n3 == (a, r, w):
                                    out[x] += p1 * p2 * p3
        return out

    def class_likelihood(self, depth, a, node):
        own = [x for x in self.rows if x[0] == a]
        if depth == 1:
            total, found = len({x[1] for x in self.rows}), len({x[1] for x in own})
        elif depth == 2:
            total = len({x[2] for x in self.rows})
            found = len([x for x in own if x[1] == node[1]]) if len(node) == 2 else len({x[2] for x in own})
        else:
            total = len({x[3] for x in own} - {None})
            same = [x for x in own if len(node) == 2 and x[1] == node[1] or len(node) == 3 and x[2] == node[2]]
            found = len({x[3] for x in same} - {None})
        if total < 2:
            return 0.0
        raw = found / total
        return ((1 - raw if raw > 0.5 else raw) - 1 / (total + 1)) / (0.5 - 1 / (total + 1))

    def score(self, case):
        node, last, log_l, least = "START", None, 0.0, 0.0
        known = {x[0] for x in self.rows}
        for event in case:
            for i, f in enumerate(event):
                depth, pun = i or 3, 0.95 if i else 0.9
                if (node, f) in self.edges:
                    p = self.edges[node, f]
                    node = (f,) if i == 0 else (*node, f)
                    log_l += math.log(p)
                elif last is None:
                    log_l = 2 * log_l + math.log(pun)
                else:
                    there = self.reached(last, depth)
                    x = sorted(there.values())
                    gini = sum((2 * j - len(x) - 1) * v for j, v in enumerate(x, 1)) / (len(x) * sum(x)) if x else 0.0
                    p = there[f] if f in there else (1 - gini) * (1 - self.class_likelihood(depth, last, node))
                    log_l += math.log(p * pun) if p > 0 else -math.inf
                if i == 0:
                    last = f if f in known else None
                    node = (f,) if f in known else node
            least = min(least, log_l)
        return None if least == -math.inf else least


def test_walks_through_the_graph_step_by_step(spark):
    """Unknown activities, resources, and both, in random cases; against a walk in Python."""
    rng = random.Random(4)
    cases = lambda n, acts, res: [[(rng.choice(acts), f"r_{rng.choice(res)}", rng.randrange(7)) for _ in range(rng.randint(1, 8))] for _ in range(n)]

    def log(found):
        monday = dt.datetime(2024, 1, 1)
        data = [(c, a, r[2:], monday + dt.timedelta(days=7 * i + w), i) for c, events in enumerate(found) for i, (a, r, w) in enumerate(events)]
        df = spark.createDataFrame(data, "case_id long, activity string, resource string, time timestamp_ntz, tie long")
        return EventLog(df, LogSpec(order=("tie",), resource="resource", categorical=("activity", "resource")))

    train, test = cases(25, "abcd", "123"), cases(60, "abcdez", "1234") + cases(5, "z", "123") + cases(5, "a", "9")
    named = lambda found: [[(a, r, f"wd_{w}") for a, r, w in c] for c in found]
    walk = Walk(named(train))
    got = {r["case_id"]: r["log_likelihood"] for r in graph.case_likelihood(log(test), graph.likelihood_model(log(train))).collect()}
    want = {i: walk.score(c) for i, c in enumerate(named(test))}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-12) if want[i] is not None else got[i] is None for i in want)


def test_two_sample_distance_at_a_jump(spark):
    series = spark.createDataFrame([(i, float(i >= 20)) for i in range(40)], "idx long, value double")
    out = {r.start: (r.d, r.log_p) for r in drift.sliding_drift(series, 10).collect()}
    assert min(out) == 0 and max(out) == 19 and out[10][0] == 1.0 and out[0][0] == 0.0 and out[10][1] < -3
    assert drift.sliding_drift(series.limit(5), 10).count() == 0


def test_recall_is_accuracy(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "expected string, predicted string")
    assert metrics.weighted_recall(rows).first()[0] == pytest.approx(metrics.accuracy(rows).first()[0])


def test_areas_of_a_perfect_and_a_reversed_ranking(spark):
    good = spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 1), (3, 0.8, 0)], "case_id long, score double, label int")
    assert metrics.roc_auc(good).first()[0] == 1.0 and metrics.average_precision(good).first()[0] == 1.0
    assert metrics.roc_auc(good.withColumn("score", -F.col("score"))).first()[0] == 0.0


def test_running_sums_over_ranges(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 3)
    out = with_running(df, ["id"], {"s": "x"}).orderBy("id").collect()
    total = 0
    for r in out:
        total += r["id"] % 3
        assert (r["idx"], r["s"]) == (r["id"], total)
    assert with_index(df.limit(0), "id").count() == 0


def test_iso_weeks_around_new_year(spark):
    times = [dt.datetime(2024, 12, 29), dt.datetime(2024, 12, 30), dt.datetime(2025, 1, 5)]
    df = spark.createDataFrame([("a", "x", t, i) for i, t in enumerate(times)], "case_id string, activity string, time timestamp_ntz, tie long")
    log = EventLog(df, LogSpec(order=("time", "tie")))
    assert table(prepare.batches(log, "week"), "tie", "batch_id") == [(0, "2024/52"), (1, "2025/01"), (2, "2025/01")]
    assert table(prepare.split_week(log, 2025, 1), "tie", "split") == [(0, "train"), (1, "test"), (2, "test")]


@pytest.mark.parametrize(("window", "stride"), [(5, 1), (7, 3), (4, 11), (30, 2)])
def test_sliding_drift_equals_a_test_for_each_start(spark, window, stride):
    """Ties, missing values, strides longer than a window, starts at the edges of runs."""
    rng = random.Random(window)
    values = [rng.choice([None, 0.5, 1.0, 2.0, rng.random()]) for _ in range(97)]
    series = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "idx long, value double").repartition(3)
    got = {r["start"]: r["d"] for r in drift.sliding_drift(series, window, stride).collect()}
    want = {}
    for start in range(0, 97 - 2 * window, stride):
        a, b = ([v for v in values[start + k : start + k + window] if v is not None] for k in (0, window))
        if a and b:
            want[start] = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in a + b)
    assert got == pytest.approx(want)


def test_folds_partition_the_log(spark):
    out = prepare.folds(log_of(spark, [("a", "x")] * 8), 3)
    assert table(out.groupBy("fold").count(), "fold", "count") == [(0, 3), (1, 3), (2, 2)]


def test_search_finds_a_true_parent_and_cycles_are_seen(spark):
    df = spark.createDataFrame([("u" if i % 2 else "v", "x" if i % 2 else "y", "n") for i in range(100)], "a string, b string, c string")
    edges = structure.learn(df, [("a", "b"), ("b", "a"), ("c", "b")])
    assert len(edges) == 1 and set(edges[0]) == {"a", "b"}
    assert structure.creates_cycle({"b": {"a"}}, "b", "a") and not structure.creates_cycle({"b": {"a"}}, "a", "b")
    assert structure.without_cycles([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")]) == [("a", "b"), ("a", "c"), ("b", "c")]


def brute_score(rows, node, parents):
    """Log-likelihood less parent tuples of a categorical family, from rows as dictionaries."""
    pairs = Counter((tuple(r[p] for p in sorted(parents)), r[node]) for r in rows)
    given = Counter(tuple(r[p] for p in sorted(parents)) for r in rows)
    return sum(n * math.log(n / given[g]) for (g, _), n in pairs.items()) - len(given)


def brute_search(score, allowed, start=()):
    """Greedy search, one move at a time."""
    edges, memo = set(start), {}

    def of(node, change=None):
        parents = frozenset({a for a, b in edges if b == node} ^ ({change} if change else set()))
        if (node, parents) not in memo:
            memo[node, parents] = score(node, parents)
        return memo[node, parents]

    while True:
        ways = lambda a, b: a == b or any(ways(y, b) for x, y in edges if x == a)
        moves = [(a, b) for a, b in allowed if (a, b) in edges or not ways(b, a)]
        gain, *edge = max(((round(of(b, a) - of(b), 6), a, b) for a, b in moves), default=(0.0,))
        if gain <= 1e-10:
            return sorted(edges)
        edges ^= {tuple(edge)}


def as_text(df, columns):
    return [{c: "nan" if r[c] is None else str(r[c]) for c in columns} for r in df.collect()]


def test_counts_grow_by_batches_and_roll_up(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), rng.choice("xyz"), rng.choice([None, "u"]), rng.randint(0, 3), i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "a string, b string, c string, d int, batch int")
    store = statistics.CountStore(spark, "abcd")
    for i in range(3):
        store.add(df.where(F.col("batch") == i))
        store.ensure([("a", "b"), ("a",)] if i == 0 else [("a", "b", "c")])
        so_far = df.where(F.col("batch") <= i)
        rows = as_text(so_far, "abcd")
        families = [("a", ("b",)), ("b", ()), ("c", ("a", "b")), ("d", ("a", "b", "c"))][: 2 + i]
        assert store.scores(families) == pytest.approx({f: brute_score(rows, *f) for f in families})
    assert table(store.counts(["b", "d"]), "b", "d", "_rows") == sorted((b, d, n) for (b, d), n in Counter((r["b"], r["d"]) for r in as_text(df, "bd")).items())


def test_generated_and_updated_models_equal_a_search_in_python(spark):
    sf = "/root/testdata/sf0.001"
    log = models.ordering(spark, sf)
    attributes = log.attributes()
    rows = as_text(cx.k_context(log.with_df(log.df, k=1), columns=attributes), [*attributes, *(f"{a}_Prev0" for a in attributes)])
    score = lambda node, parents: brute_score(rows, node, parents)
    allowed = structure.allowed_edges(attributes, 1)
    found = models.s086_generate_model(spark, sf).collect()
    assert not [r for r in found if r["kind"] == "functional"]
    assert sorted((r["parent"], r["child"]) for r in found) == brute_search(score, allowed)
    updated = models.s092_update_model(spark, sf).collect()
    assert sorted((r["parent"], r["child"]) for r in updated) == brute_search(score, allowed, [("activity_Prev0", "activity")])


def test_mixed_search_equals_a_search_in_python(spark):
    """Numeric and categorical nodes; densities by sums over all pairs of rows."""
    rng = np.random.default_rng(8)
    n = 160
    g = rng.choice(["a", "b"], n)
    x = np.round(np.where(g == "a", 0, 12) + rng.normal(size=n) * 2)
    y = np.round(x + rng.normal(size=n) * 1.5)
    z = np.round(rng.normal(size=n) * 3)
    h = rng.choice(["p", "q"], n)
    df = spark.createDataFrame([(str(i), str(j), *map(float, v)) for i, j, *v in zip(g, h, x, y, z, strict=True)], "g string, h string, x double, y double, z double")
    values, labels, width = {"x": x, "y": y, "z": z}, {"g": g, "h": h}, 1.5
    allowed = [(a, b) for a in "ghxyz" for b in "ghxyz" if a != b]
    store = statistics.CountStore(spark, "gh", {c: (width, 1.0) for c in "xyz"})
    store.add(df.limit(50))
    store.add(df.exceptAll(df.limit(50)))
    rows = [dict(zip("gh", r, strict=True)) for r in zip(g, h, strict=True)]

    def score(node, parents):
        if node in labels:
            return brute_score(rows, node, parents)
        continuous, discrete = sorted(p for p in parents if p in values), sorted(p for p in parents if p in labels)
        same = np.ones((n, n), bool)
        for p in discrete:
            same &= labels[p][:, None] == labels[p][None]
        same |= (same.sum(1) <= density.LEAST_ROWS)[:, None]

        def dens(columns):
            k = np.ones((n, n))
            for c in columns:
                d = values[c][:, None] - values[c][None]
                k *= np.exp(-((d / width) ** 2) / 2) / (width * density.NORMAL) * (np.abs(d) <= math.ceil(8 * width))
            return (k * same).sum(1) / same.sum(1)

        below = dens(continuous) if continuous else 1.0
        return float(np.log(np.maximum(dens([*continuous, node]) / below, 1e-10)).sum()) - density.complexity(len(continuous) + 1, len(discrete))

    for f in [("x", ()), ("x", ("g",)), ("y", ("x",)), ("y", ("g", "x")), ("z", ("x", "y"))]:
        assert store.scores([f])[f] == pytest.approx(score(f[0], f[1]))
    possible = [(a, b) for a, b in allowed if a in labels or b in values]
    edges = structure.learn_from_counts(store, allowed)
    assert edges == brute_search(score, possible) and {("x", "y"), ("y", "x")} & set(edges)


def test_mixed_models_score_events(spark):
    sf = "/root/testdata/sf0.001"
    log = models.shipped(spark, sf)
    nodes, edges = structure.generate_mixed_model(log, models.SHIPPED)
    assert ("quantity", "price") in edges or ("price", "quantity") in edges
    scored = model.score_events(structure.mixed_context(log, list(models.SHIPPED)), nodes)
    columns = model.score_columns(scored)
    assert columns == ["score_activity", "score_quantity", "score_price"]
    assert scored.count() == log.df.count() and scored.where(" OR ".join(f"{c} IS NULL" for c in columns)).count() == 0


def test_injection_is_repeatable_and_labelled(spark):
    log = log_of(spark, [(f"c{i // 4}", "xyzw"[i % 4]) for i in range(80)])
    one, two = (inject.inject(log, 0.5).orderBy("tie").collect() for _ in range(2))
    assert one == two and {r.anomaly for r in one} == {0, 1}
    assert all(r.activity == "xyzw"[r.tie % 4] for r in one if r.anomaly == 0)


def test_density_of_a_far_value_is_the_floor(spark):
    train = spark.createDataFrame([(float(i % 3),) for i in range(60)], "x double")
    test = spark.createDataFrame([(1, 1.0), (2, 1e6)], "id int, x double")
    out = {r["id"]: r.log_density for r in density.log_density(test, density.grid(train, "x", [], 0.5), "x", [], ["id"], 1.0, 0.5).collect()}
    assert out[2] == pytest.approx(math.log(1e-10)) and out[1] > math.log(0.2)


@pytest.mark.parametrize("continuous", [[], ["u"], ["u", "v"]])
def test_conditional_density_equals_the_sum_over_all_training_rows(spark, continuous):
    """Values on the grid, so that cells are exact; a group too small for a density of its own; missing values; event scores."""
    rng = random.Random(len(continuous))
    rows = [(i, rng.choice("ab") if i else "rare", float(rng.randint(0, 12)), float(rng.randint(-5, 5)), float(rng.randint(-9, 9))) for i in range(150)]
    rows += [(200, "a", 1000.0, 0.0, 0.0), (201, "a", None, 0.0, 0.0), (202, "b", 1.0, float("nan"), 0.0), (203, "unknown", 3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, g string, x double, u double, v double")
    widths, columns = [0.6, 0.5, 0.7][-len(continuous) - 1 :], [*continuous, "x"]
    node = density.numeric_node(df.where("id < 150"), "x", continuous, ["g"], widths, 1.0)
    got = {r["id"]: r["score_x"] for r in model.score_events(df, {"x": node}).collect()}
    at = {"x": 2, "u": 3, "v": 4}

    def dens(row, names, hs):
        group = [r for r in rows[:150] if r[1] == row[1]]
        group = group if len(group) > density.LEAST_ROWS else rows[:150]
        kernel = lambda r: math.prod(math.exp(-(((row[at[c]] - r[at[c]]) / h) ** 2) / 2) / (h * density.NORMAL) if abs(row[at[c]] - r[at[c]]) <= math.ceil(8 * h) else 0 for c, h in zip(names, hs, strict=True))
        return sum(map(kernel, group)) / len(group)

    for row in rows:
        values = [row[at[c]] for c in columns]
        if any(v is None or math.isnan(v) for v in values):
            assert got[row[0]] == pytest.approx(math.log(1e-10))
            continue
        below = dens(row, continuous, widths[:-1]) if continuous else 1.0
        assert got[row[0]] == pytest.approx(math.log(max(dens(row, columns, widths) / below, 1e-10)) if below else math.log(1e-10), abs=1e-9)


@pytest.mark.parametrize("dimensions", [1, 2, 4])
def test_densities_sum_dimensions_out(spark, monkeypatch, dimensions):
    """Values off the grid, several blocks and pieces and small tables of partial sums, against all pairs; no row meets a cell in the plan."""
    monkeypatch.setattr(density, "PIECE", 5)
    monkeypatch.setattr(density, "ENTRIES", 40)
    rng = random.Random(dimensions)
    names = list("wxyz")[:dimensions]
    draw_ = lambda n: [(i, *(round(rng.gauss(0, 12) + rng.choice([0, 0, 90]), rng.choice([0, 2])) for _ in names)) for i in range(n)]
    schema = ", ".join(["id int", *(f"{c} double" for c in names)])
    train, test = draw_(80), draw_(60)
    widths, deltas = [1.5, 2.0, 3.0, 2.5][:dimensions], [0.5, 1.0, 2.0, 1.0][:dimensions]
    bins = density.grid(spark.createDataFrame(train, schema), names, [], deltas)
    found = density.add_density(spark.createDataFrame(test, schema), bins, names, [], widths, deltas, "d")
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().analyzed().toString()
    cell = lambda v, d: math.floor(abs(v) / d + 0.5) * (1 if v > 0 else -1)
    got = {r["id"]: r["d"] for r in found.collect()}
    assert len(got) == len(test)
    for i, *x in test:
        want = 0.0
        for _, *y in train:
            if all(abs(cell(u, d) - cell(v, d)) <= math.ceil(8 * h / d) for u, v, d, h in zip(x, y, deltas, widths, strict=True)):
                want += math.prod(math.exp(-(((u - cell(v, d) * d) / h) ** 2) / 2) / (h * density.NORMAL) for u, v, d, h in zip(x, y, deltas, widths, strict=True))
        assert got[i] == pytest.approx(want / len(train), rel=1e-9) if want else got[i] is None


def test_both_time_formats(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024/01/02 03:04:05.678",), ("no",)], "t string")
    assert [r[0] for r in df.select(parse_time("t")).collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 678000), None]


def test_mxml_and_xes_readers(spark, tmp_path):
    (tmp_path / "a.mxml").write_text("""<WorkflowLog><Process id="p"><ProcessInstance id="c1"><AuditTrailEntry><WorkflowModelElement>A</WorkflowModelElement><EventType>start</EventType><Timestamp>2024-01-01T00:00:00.000+00:00</Timestamp><Originator>u</Originator></AuditTrailEntry>
<AuditTrailEntry><WorkflowModelElement>A</WorkflowModelElement><EventType>complete</EventType><Timestamp>2024-01-01T01:00:00.000+00:00</Timestamp></AuditTrailEntry></ProcessInstance></Process></WorkflowLog>""")
    out = sources.read_log(spark, str(tmp_path / "a.mxml"))
    assert table(out, "case_id", "position", "activity", "lifecycle") == [("c1", 0, "A", "start"), ("c1", 1, "A", "complete")]
    (tmp_path / "a.xes").write_text("""<log><trace><string key="concept:name" value="c1"/><event><string key="concept:name" value="A"/><string key="org:resource" value="u"/><string key="lifecycle:transition" value="start"/><date key="time:timestamp" value="2024-01-01T00:00:00.000+00:00"/></event>
<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2024-01-01T01:00:00.000+00:00"/></event></trace></log>""")
    out = sources.read_log(spark, str(tmp_path / "a.xes"))
    assert table(out, "case_id", "position", "activity") == [("c1", 0, "A"), ("c1", 1, "B")]
    assert out.where("position = 0").first()["resource"] == "u" and out.where("position = 1").first()["resource"] is None


def test_relearning_replays_all_weeks_with_all_history(spark):
    sf = "/root/testdata/sf0.001"
    out = models.s106_predict_then_relearn(spark, sf).collect()
    weeks = [r[0] for r in models.context(spark, sf).select(F.weekofyear("time")).distinct().collect()]
    assert sorted(r["batch"] for r in out) == sorted(weeks)[1:]
    assert any("resource_Prev" in r["parents"] for r in out)
    columns = ["activity", *(f"{a}_Prev{i}" for a in ("activity", "resource") for i in range(2))]
    df = models.context(spark, sf).withColumn("batch", F.weekofyear("time"))
    rows = [(r["batch"], {c: "nan" if r[c] is None else str(r[c]) for c in columns}) for r in df.collect()]
    edges, parents_of = [], {}
    for w in sorted(weeks):
        parents_of[w] = [a for a, _ in edges]
        past = [r for b, r in rows if b <= w]
        edges = brute_search(lambda node, parents, past=past: brute_score(past, node, parents), [(c, "activity") for c in columns[1:]], edges)
    for r in out:
        parents = parents_of[r["batch"]]
        assert r["parents"] == ",".join(parents)
        past, week = ([x for b, x in rows if (b < r["batch"] if before else b == r["batch"])] for before in (True, False))
        assert r["accuracy"] == pytest.approx(sum(brute_next(past, x, parents) == x["activity"] for x in week) / len(week))


def brute_distribution(past, row, parents, value="activity"):
    """Given all parents, or those seen, or the mean over each one left out."""

    def given(used):
        counts = Counter(x[value] for x in past if all(x[p] == row[p] for p in used))
        return {v: n / sum(counts.values()) for v, n in counts.items()}

    exact = given(parents)
    if not exact:
        seen = [p for p in parents if any(x[p] == row[p] for x in past)]
        parts = [given(seen)] if len(seen) < len(parents) else [given([q for q in parents if q != p]) for p in parents]
        exact = Counter()
        for part in parts:
            for v, p in part.items():
                exact[v] += p / len(parts)
    return sorted(exact, key=lambda v: (-round(exact[v], 12), v))


def brute_next(past, row, parents):
    return next(iter(brute_distribution(past, row, parents)), "0")


@pytest.mark.parametrize("limits", [{}, {"a": 1, "b": 2, "c": 3}, {"a": 3, "b": 1}])
@pytest.mark.parametrize("parents", [{"activity": ["activity_Prev0", "activity_Prev1"]}, {"activity": ["activity_Prev0", "resource_Prev0"], "resource": ["activity", "resource_Prev1"]}])
def test_suffixes_are_rolled_step_by_step(spark, limits, parents):
    """Against a loop over single steps: runs at their limits, ends, unknown values, and a number of steps that is no power of two."""
    rng = random.Random(9)
    cases = {c: [(rng.choice("aaabc" if c % 2 == 0 else "abcd"), rng.choice("rs" if c % 2 == 0 else "rst")) for _ in range(rng.randint(1, 7))] for c in range(24)}
    cases |= {30: [(x, "r") for x in "aaaaaabbbbbcccccc"], 31: [("a", "r")], 33: [("b", "s"), ("b", "s")]}
    cases = {c: [*events, ("end", "end")] for c, events in cases.items()}
    rows = [(c, i, a, r) for c, events in cases.items() for i, (a, r) in enumerate(events)]
    log = EventLog(spark.createDataFrame(rows, "case_id long, time long, activity string, resource string"), LogSpec(categorical=("activity", "resource")))
    train, test = log.with_df(log.df.where("case_id % 2 = 0")), log.with_df(log.df.where("case_id % 2 = 1"))
    repeats = spark.createDataFrame([*limits.items()], "activity string, length long")
    got = suffix.predict_suffixes(test, cx.k_context(train, 2, list(parents)), parents, repeats, 2, longest=11).collect()
    past = []
    for c, events in cases.items():
        if c % 2 == 0:
            for i in range(len(events)):
                before = [events[i - 1 - j] if i - 1 - j >= 0 else ("0", "0") for j in range(2)]
                past.append({"activity": events[i][0], "resource": events[i][1]} | {f"{a}_Prev{j}": before[j][n] for j in range(2) for n, a in enumerate(("activity", "resource"))})
    assert len(got) == sum(len(e) for c, e in cases.items() if c % 2)
    for r in got:
        events, i = cases[r["case_id"]], r["prefix_size"] - 1
        last = [events[i - j] if i - j >= 0 else ("0", "0") for j in range(2)]
        out, run, steps = [], [None], 0
        while last[0][0] != "end" and steps < 11:
            row = {f"{a}_Prev{j}": last[j][n] for j in range(2) for n, a in enumerate(("activity", "resource"))}
            new = {}
            for attribute, of in parents.items():
                ways = brute_distribution(past, row, of, attribute)
                if not ways:
                    new["activity"] = "end"
                    continue
                if attribute == "activity":
                    ways = [v for v in ways if v != run[0] or len(run) <= limits.get(v, 1)]
                new[attribute] = ways[0] if ways else None
                row[attribute] = new[attribute]
            act = new["activity"]
            run = [*run, act] if act == run[0] else [act]
            last = [(act, new.get("resource", "0")), last[0]]
            out += [act] if act is not None else []
            steps += 1
        assert (r["predicted"], r["suffix"]) == (out, [a for a, _ in events[i + 1 :]])


def traces_of(n, seed, hot):
    """(case, activities, gaps, start): many cases of one trace, some long ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = list("abcab") if rng.random() < hot else [rng.choice("abcd") for _ in range(rng.randint(1, 9 if i % 10 else 25))]
        out.append((i, t, [float(rng.choice([0, 1, 30])) for _ in t], rng.randint(0, 50)))
    return out


TRACES = "case_id long, activity array<string>, gap array<double>, start long"


def test_rows_of_one_context_are_not_gathered(spark):
    """Few contexts are sent to the rows; the rows with their suffixes are not shuffled by context."""
    log = cx.add_end_events(log_of(spark, [(f"c{i // 4}", "ab"[i % 2]) for i in range(40)], k=1))
    found = suffix.predict_suffixes(log, cx.k_context(log, 1, ["activity"]), k=1)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_nearest_variants_by_brute_force(spark):
    a, b = traces_of(80, 3, 0.2), traces_of(60, 4, 0.2)
    found = {tuple(r["variant"]): (r["distance"], r["nearest"], r["cases"], r["similarity"]) for r in similarity.nearest_variants(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES)).collect()}
    count = Counter(tuple(t) for _, t, _, _ in a)
    assert found.keys() == count.keys()
    for v, n in count.items():
        d, o = min((damerau_distances([v], [t])[0], t) for _, t, _, _ in b)
        assert found[v] == (d, o, n, pytest.approx(1 - d / max(len(v), len(o))))
    assert similarity.nearest_variants(spark.createDataFrame([], TRACES), spark.createDataFrame(b, TRACES)).count() == 0
    assert similarity.nearest_variants(spark.createDataFrame(a, TRACES), spark.createDataFrame([], TRACES)).count() == 0


def test_bounds_lose_no_pair_and_discard_most(spark):
    a, b = traces_of(70, 5, 0.0), traces_of(70, 6, 0.0)
    va, vb, pivots, _ = similarity._both_sides(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES), "activity")
    for low, radius in ((-1, 0), (0, 1), (1, 2), (2, 4)):
        got = {(tuple(r["variant"]), tuple(r["other"])) for r in similarity.near_pairs(va, vb, low, radius, pivots).collect()}
        pairs = {(tuple(x[1]), tuple(y[1])) for x in a for y in b}
        assert got == {(x, y) for x, y in pairs if low < damerau_distances([x], [y])[0] <= radius}
    assert similarity.candidates(va, vb, 1, pivots).count() < 0.1 * len(pairs)


@pytest.mark.parametrize("tile", [1 << 21, 150])
def test_pairs_of_one_distance_need_no_round_each(spark, monkeypatch, tile):
    """All pairs are one apart, so that few are first for both sides; tiles of few pairs give the same."""
    a, b = ([(i, [f"{side}{i:02}"], [0.0], i) for i in range(40)] for side in "xy")
    va, vb, pivots, longest = similarity._both_sides(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES), "activity")
    tables, write = [], similarity.written
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "written", lambda df: tables.append(1) or write(df))
    found = similarity.matched_variants(va, vb, pivots, longest).collect()
    assert sorted((r["variant"], r["other"], r["distance"], r["n"]) for r in found) == [([f"x{i:02}"], [f"y{i:02}"], 1.0, 1) for i in range(40)]
    assert len(tables) < 40


def test_damerau_between_rows():
    rng = random.Random(2)
    a, b = ([[rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 9))] for _ in range(30)] for _ in range(2))
    i, j = (x.ravel() for x in np.indices((30, 30)))
    want = damerau_distances([a[x] for x in i], [b[x] for x in j])
    assert damerau_between(pa.array(a), pa.array(b), i, j).tolist() == want.tolist()
    assert damerau_between(pa.array(a), pa.array(b), i[:3], j[:3]).tolist() == want[:3].tolist()


def test_matching_without_replacement_equals_a_loop(spark):
    """Pairs in order of distance and traces, cases in order of starts; one trace is a third of all; runs longer than a chunk."""
    a, b = traces_of(150, 7, 0.35), traces_of(130, 8, 0.35)
    out = similarity.match_logs(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES), seed=5)
    before, similarity.CHUNK = similarity.CHUNK, 7
    try:
        again = similarity.match_logs(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES), seed=5).collect()
    finally:
        similarity.CHUNK = before
    rows = out.collect()
    assert sorted(rows) == sorted(again)
    cut = round(len(a) * 0.2)
    kept = sorted(a, key=lambda r: (r[3], r[0]))[cut:-cut]
    hashes = {r[0]: r[1] for r in spark.createDataFrame(b, TRACES).select("case_id", F.xxhash64("case_id", F.lit(5))).collect()}
    drawn = sorted(b, key=lambda r: (hashes[r[0]], r[0]))[: len(kept)]
    groups = [{}, {}]
    for side, of in zip((kept, drawn), groups, strict=True):
        for r in sorted(side, key=lambda r: (r[3], r[0])):
            of.setdefault(tuple(r[1]), []).append(r)
    pairs = [(x, y) for x in groups[0] for y in groups[1]]
    distances = damerau_distances(*map(list, zip(*pairs, strict=True)))
    want = {}
    for d, x, y in sorted(zip(distances.tolist(), *zip(*pairs, strict=True), strict=True)):
        while groups[0][x] and groups[1][y]:
            p, q = groups[0][x].pop(0), groups[1][y].pop(0)
            longest = max(len(x), len(y))
            want[p[0]] = (q[0], d, 1 - d / longest, 1 - timed_distances([x], [y], [p[2]], [q[2]])[0] / longest, abs(sum(p[2]) - sum(q[2])))
    assert len(rows) == len(want) == len(kept)
    for case, *values in rows:
        assert values == pytest.approx(list(want[case]))


def loop_of(a, b):
    """Pairs of variants in order of (distance, variant, other), each matching what is left of both."""
    left, right = (dict(Counter(tuple(t) for _, t, _, _ in x)) for x in (a, b))
    pairs = [(x, y) for x in left for y in right]
    want = []
    for d, x, y in sorted(zip(damerau_distances(*map(list, zip(*pairs, strict=True))).tolist(), *zip(*pairs, strict=True), strict=True)):
        n = min(left[x], right[y])
        if n:
            want.append((x, y, d, n))
            left[x], right[y] = left[x] - n, right[y] - n
    return sorted(want)


@pytest.mark.parametrize(("last", "tile", "group"), [(0, 1 << 24, 1 << 12), (0, 60, 7), (300, 1 << 24, 7), (1 << 26, 1 << 24, 7)])
def test_matching_by_lists_and_by_tables_equals_a_loop(spark, monkeypatch, last, tile, group):
    """Lists of growing radius alone, in tiles and small groups; lists until a table takes the rest; a table of several groups."""
    for name, value in (("LAST", last), ("TILE", tile), ("GROUP", group), ("SMALL", 4)):
        monkeypatch.setattr(similarity, name, value)
    a, b = traces_of(45, 11, 0.35), traces_of(35, 12, 0.35)
    sides = similarity._both_sides(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES), "activity")
    found = similarity.matched_variants(*sides).collect()
    assert sorted((tuple(r["variant"]), tuple(r["other"]), r["distance"], r["n"]) for r in found) == loop_of(a, b)


def test_a_table_of_distances_needs_no_round_each(spark, monkeypatch):
    """More than a million pairs of many distances are matched in one go."""
    rng = random.Random(13)
    a, b = ([(i, [rng.choice("abcde") for _ in range(rng.randint(3, 12))], [0.0], i) for i in range(1200)] for _ in range(2))
    sides = similarity._both_sides(spark.createDataFrame(a, TRACES), spark.createDataFrame(b, TRACES), "activity")
    tables, write = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: tables.append(1) or write(df))
    found = similarity.matched_variants(*sides).collect()
    assert sum(r["n"] for r in found) == 1200 and len(tables) == 1


def test_near_rows_within_a_radius():
    """Bounds and the band around the diagonal lose nothing within the radius; rows of over a hundred items use wider cells."""
    rng = random.Random(4)
    for longest, letters in ((9, "ab"), (9, "abcdefghijklmnopqrst"), (120, "abc")):
        a, b = (sorted(([rng.choice(letters) for _ in range(rng.randint(0, longest))] for _ in range(40)), key=len) for _ in range(2))
        b += [x[1:] + x[:1] for x in a[:20]]
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
        want = damerau_distances([a[x] for x in i], [b[x] for x in j])
        to = [damerau_distances(x, [a[20]] * len(x)).reshape(-1, 1) for x in (a, b)]
        assert damerau_between(pa.array(a), pa.array(b), i, j).tolist() == want.tolist()
        for radius in (0, 1, 2, 5, longest):
            got = {(p, q, d) for rows in damerau_near(pa.array(a), pa.array(b), radius, *to) for p, q, d in zip(*rows, strict=True) if d <= radius}
            assert got == {(p, q, d) for p, q, d in zip(i, j, want, strict=True) if d <= radius}


def test_updated_classifier_on_all_equals_one_fit(spark):
    rows = [(i, b, "ab"[(i + b) % 2], "cd"[i % 2]) for b in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "tie long, batch long, act string, prev string")
    got = {tuple(r) for r in classify.test_and_update(df, "batch", "act", ["prev"], ["tie", "batch"], None).where("batch = 2").select("tie", "predicted", "p_predicted").collect()}
    want = classify.test_linear(classify.train_linear(df.where("batch < 2"), "act", ["prev"]), df.where("batch = 2"), "act", ["prev"], ["tie", "batch"])
    assert got == {tuple(r) for r in want.select("tie", "predicted", "p_predicted").collect()}
    last = classify.test_and_update(df, "batch", "act", ["prev"], ["tie", "batch"], 1).where("predicted = expected").count()
    assert last == 0


@pytest.mark.parametrize("block", [3, 7, 100])
def test_moving_mean_in_blocks(spark, block):
    values = [random.Random(5 + i).random() for i in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    out = metrics.moving_mean(df, ["i"], "x", w=3, block=block).orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(40))
    assert [r["mean"] for r in out] == pytest.approx([sum(values[max(0, i - 2) : i + 1]) / min(3, i + 1) for i in range(40)])


def test_counts_by_sets_and_weights(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "x string, y long")
    out = {(r["of"], *r["cells"]): r["n"] for r in stats.counts_by_sets(df, [("x",), ("x", "y")]).collect()}
    assert out == {(0, "a"): 2, (0, "b"): 1, (1, "a", "1"): 2, (1, "b", "nan"): 1}
    whole = structure.family_scores(df, [("x", ()), ("x", ("y",))])
    counted = structure.family_scores(df.groupBy("x", "y").agg(F.count("*").alias("k")), [("x", ()), ("x", ("y",))], "k")
    assert table(whole, "node", "parents", "loglik", "tuples") == table(counted, "node", "parents", "loglik", "tuples")


def test_search_beyond_sixty_four_columns(spark):
    rows = [tuple("ab"[(i >> (j % 5)) & 1] for j in range(70)) for i in range(64)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} string" for j in range(70)))
    assert structure.learn(df, [(f"c{j}", "c0") for j in range(1, 70)], most=1)[0][0] in {f"c{j}" for j in range(5, 70, 5)}


def test_bandwidth_by_brute_force(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, round(rng.gauss(0, 5), 2)) for i in range(60)], "tie long, x double")
    folds = [(round_half_away(r["x"] / 0.5), r["fold"]) for r in df.withColumn("fold", draw(2, F.col("tie"))).collect()]
    for r in density.choose_bandwidth(df, "x", 0.5, keys=["tie"]).collect():
        h, total = r["bandwidth"], 0.0
        for b, f in folds:
            others = [o for o, g in folds if g != f]
            total += math.log(max(sum(math.exp(-(((b - o) * 0.5 / h) ** 2) / 2) for o in others) / len(others) / h / math.sqrt(2 * math.pi), 1e-10))
        assert r["loglik"] == pytest.approx(total, abs=1e-6)


def round_half_away(x):
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def test_injected_split_keeps_training_cases_clean(spark):
    log = log_of(spark, [(f"c{i // 4}", "xyzw"[i % 4]) for i in range(400)])
    out = inject.injected_split(log, density=0.5).collect()
    assert len(out) == 400 and len({(r["case_id"], r["split"]) for r in out}) == 100
    assert {r["anomaly"] for r in out if r["split"] == "train"} == {0} and {r["anomaly"] for r in out if r["split"] == "test"} == {0, 1}


def test_three_parts_by_share(spark):
    out = prepare.split_three(spark.range(5000), ["id"]).groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 5000 for r in out}
    assert share == {"train": pytest.approx(0.8, abs=0.03), "valid": pytest.approx(0.06, abs=0.02), "test": pytest.approx(0.14, abs=0.03)}


def test_timed_similarity_of_equal_cases_is_one(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"], [0.0, 5.0], [0.0, 5.0]), (["a"], ["c"], [0.0], [0.0])], "a array<string>, b array<string>, g array<double>, h array<double>")
    assert [r["similarity"] for r in predict.timed_similarity(df, "a", "b", "g", "h").collect()] == [1.0, 0.0]


def test_zip_archives(spark, tmp_path):
    text = "case,activity\r\n" + "".join(f"c{i},caf\u00e9 {i}\r\n" for i in range(1000))
    with zipfile.ZipFile(tmp_path / "log.csv.zip", "w") as z:
        z.writestr("log.csv", text.encode("latin-1"))
    out = sources.read_delimited(spark, str(tmp_path / "log.csv.zip"), "case string, activity string")
    assert table(out, "case", "activity") == sorted((f"c{i}", f"caf\u00e9 {i}") for i in range(1000))
    assert sources.read_log(spark, str(tmp_path / "log.csv.zip")).count() == 1000
    with zipfile.ZipFile(tmp_path / "log.xes.zip", "w") as z:
        z.writestr("log.xes", '<log><trace><string key="concept:name" value="c1"/><event><string key="concept:name" value="A"/><date key="time:timestamp" value="2024-01-01T00:00:00.000+00:00"/></event></trace></log>')
    assert table(sources.read_log(spark, str(tmp_path / "log.xes.zip")), "case_id", "activity") == [("c1", "A")]


def test_experiments_of_all_splits(spark):
    log = log_of(spark, [(f"c{i // 4}", "xyzw"[i % 4]) for i in range(48)])
    settings = methods.experiments(split=["train-test", "k-fold"], by_case=[False], k=[1, 2])
    out = methods.run_experiments(log, settings, ["counts", "linear"], ["tie"]).collect()
    assert len(out) == 8 and {(r["split"], r["k"], r["method"]) for r in out} == {(s, k, m) for s in ("train-test", "k-fold") for k in (1, 2) for m in ("counts", "linear")}
    assert all(r["accuracy"] == 1.0 for r in out)


def test_a_fitted_classifier_meets_its_score_equations(spark):
    """At the best weights, what is predicted for the rows of a value adds up to what was seen there, label by label."""
    rng = random.Random(11)
    rows = [(a, b, rng.choice("xy" if a == "p" else "yyz") if b != "s" else "z") for a, b in ((rng.choice("pq"), rng.choice("rst")) for _ in range(600))]
    df = spark.createDataFrame(rows, "a string, b string, label string")
    fitted = classify.train_linear(df, "label", ["a", "b"], iterations=200, regularisation=0.0)
    labels = fitted.stages[0].labels
    got = fitted.transform(df).select("a", "b", "label", "probability").collect()
    for column in ("a", "b"):
        for value in {r[column] for r in got}:
            here = [r for r in got if r[column] == value]
            for i, x in enumerate(labels):
                assert sum(r["probability"][i] for r in here) == pytest.approx(sum(r["label"] == x for r in here), abs=0.5)


def test_a_fit_on_counts_equals_one_on_rows(spark, monkeypatch):
    """The learner gets a row for each combination of values, and the weights are those of a fit on all rows, regularised alike."""
    rng = random.Random(12)
    rows = [(a, b, rng.choice("xxy" if a == "p" else "yyz")) for a, b in ((rng.choice("pppq"), rng.choice("rrrrst")) for _ in range(500))]
    df = spark.createDataFrame(rows, "a string, b string, label string")
    learner, seen = classify.LogisticRegression, []

    class Counting(learner):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(classify, "LogisticRegression", Counting)
    fitted = classify.train_linear(df, "label", ["a", "b"], iterations=100, regularisation=0.05)
    assert seen == [len(set(rows))]
    typed = df
    for stage in fitted.stages[:-2]:
        typed = stage.transform(typed)
    want = learner(featuresCol="hot", labelCol="label_id", family="multinomial", maxIter=100, regParam=0.05).fit(typed)
    p = lambda m, d: np.array([r[0].toArray() for r in m.transform(d).select("probability").collect()])
    assert np.allclose(p(fitted, df), p(want, typed), atol=1e-4)


def test_embeddings_are_close_where_values_meet(spark):
    """Two blocks of activities and resources that meet inside only."""
    rows = [(f"a{i}", f"r{j}") for i in range(6) for j in range(8) if i % 2 == j % 2 for _ in range(20)]
    found = classify.co_occurrence_embedding(spark.createDataFrame(rows, "activity string, resource string"), "activity", "resource").collect()
    vectors = {r["value"]: np.array(r["embedding"]) for r in found}
    assert {r["kind"] for r in found} == {"activity", "resource"} and len(vectors) == 14 and all(len(v) == math.ceil(48**0.25) for v in vectors.values())
    inside = [vectors[f"a{i}"] @ vectors[f"r{j}"] for i in range(6) for j in range(8) if i % 2 == j % 2]
    across = [vectors[f"a{i}"] @ vectors[f"r{j}"] for i in range(6) for j in range(8) if i % 2 != j % 2]
    assert min(inside) > 0.8 and max(across) < 0.2


def test_experiments_share_contexts_and_look_results_up_by_context(spark, monkeypatch):
    """Four splits of one log are one context; results equal those from a row for each value of each event."""
    rng = random.Random(9)
    log = log_of(spark, [(f"c{i // 6}", rng.choice("abc")) for i in range(60)], k=1)
    made, k_context = [], prepare.k_context
    monkeypatch.setattr(prepare, "k_context", lambda *a: made.append(1) or k_context(*a))
    settings = methods.experiments(split=["train-test", "test-train"], percentage=[50.0, 80.0], k=[1])
    out = methods.run_experiments(log, settings, ["counts"], ["tie"]).collect()
    assert len(out) == 4 and len(made) == 1
    df = cx.k_context(log, 1, ["activity"])
    train, test = df.where("tie % 3 = 0").where("activity <> 'c'"), df.where("tie % 3 > 0")
    tables, parents = predict.backoff_tables(train, "activity", ["activity_Prev0"]), ["activity_Prev0"]
    want = predict.results(test, predict.predict(test, tables, parents, ["tie"]), "activity", ["tie"])
    got = predict.predicted_results(test, tables, "activity", parents, ["tie"])
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
