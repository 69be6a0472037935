"""What follows a prefix: all attributes rolled forward together, with bounded repeats of an activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.context import END
from caselake.operators.predict import UNKNOWN, backoff_tables, predict
from caselake.plans.log import EventLog, as_category
from caselake.plans.order import checkpointed, written

#: Stands for an activity where every value is barred by its repeats. It is left out of what is predicted.
BARRED = "\x00"


def _ranked(rows: DataFrame, table: DataFrame, parents: list[str], most: int) -> DataFrame:
    """(key, rank, value): the ``most`` likeliest values for each row, ties by value; none where nothing is known."""
    w = Window.partitionBy("_key").orderBy(F.desc(F.round("p", 12)), "value")
    found = predict(rows, table, parents, ["_key"]).where((F.col("value") != UNKNOWN) & (F.col("p") > 0))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("_key", "rank", "value")


def options(contexts: DataFrame, tables: dict[str, DataFrame], parents: dict[str, list[str]], k: int, end: str) -> DataFrame:
    """(ctx, rank, value, to): the likeliest activity after each context (rank 1) and the next one (rank 2), and the context then.

    The other attributes of the new event are predicted one after another, given those before. Where one knows nothing, or no
    activity is known, the case ends. A missing second choice is ``BARRED``.
    """
    names = list(parents)
    past = {f"{a}_Prev{i}": F.col("ctx")[n * k + i] for n, a in enumerate(names) for i in range(k)}
    rows = contexts.select("ctx", F.to_json("ctx").alias("_key")).withColumns(past)
    first = names[0]
    top = _ranked(rows, tables[first], parents[first], 2).groupBy("_key").agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("v1"), F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("v2"))
    both = F.array(F.struct(F.lit(1).alias("rank"), F.coalesce("v1", F.lit(end)).alias("value")), F.struct(F.lit(2).alias("rank"), F.coalesce("v2", F.when(F.col("v1").isNull(), F.lit(end)), F.lit(BARRED)).alias("value")))
    out = rows.join(top, "_key", "left").withColumn("choice", F.explode(both)).select(*rows.columns, "choice.rank", F.col("choice.value").alias(first))
    out = out.withColumn("_key", F.to_json(F.struct("_key", "rank")))
    for a in names[1:]:
        best = _ranked(out, tables[a], parents[a], 1).select("_key", F.col("value").alias(a))
        out = out.join(best, "_key", "left")
    lost = [F.col(a).isNull() for a in names[1:]]
    over = F.lit(False)
    for x in lost:
        over = over | x
    out = out.withColumn(first, F.when(over, F.lit(end)).otherwise(F.col(first)))
    moved = F.concat(*(F.slice(F.concat(F.array(F.coalesce(a, F.lit(UNKNOWN))), F.slice("ctx", n * k + 1, k)), 1, k) for n, a in enumerate(names)))
    return out.select("ctx", "rank", F.col(first).alias("value"), moved.alias("to"))


def context_graph(contexts: DataFrame, tables: dict[str, DataFrame], parents: dict[str, list[str]], k: int, end: str, longest: int) -> DataFrame:
    """``options`` of the contexts given and of all that they lead to. Most successors are known at once, so rounds are few."""
    graph, new = None, checkpointed(contexts.select("ctx").distinct())
    for _ in range(longest):
        found = checkpointed(options(new, tables, parents, k, end))
        graph = found if graph is None else checkpointed(graph.unionByName(found))
        new = checkpointed(found.where(F.col("value") != end).select(F.col("to").alias("ctx")).distinct().join(graph.select("ctx").distinct(), "ctx", "left_anti"))
        if new.isEmpty():
            break
    return graph


def predict_suffixes(
    log: EventLog, train: DataFrame, parents: dict[str, list[str]] | None = None, repeats: DataFrame | None = None, k: int = 2, longest: int = 100, end: str = END
) -> DataFrame:
    """(case, prefix_size, suffix, predicted): for each event what follows and what is predicted to.

    ``train`` is a k-context; ``parents`` has the activity first, given earlier values (``X_Prev0`` .. up to k), then every
    attribute among anyone's parents, given earlier values and attributes before it of the same event. Distributions back off
    as ``predict.predict`` says. ``repeats`` (activity, length, see ``stats.repeat_lengths``) bounds how often an activity follows
    itself: a run may grow while it is not longer than that (1, if not given); then the next likeliest is taken. A roll ends
    with the end event, where nothing is known, or after ``longest`` steps.

    A roll depends on the last k events and the length of the run, of which there are few: each such state is rolled once. The
    table of single steps is put together with itself, so a join doubles the steps it makes, and ``longest`` steps take as
    many rounds as that number has binary digits.
    """
    s, w = log.spec, log.window()
    parents = parents or {s.activity: [f"{s.activity}_Prev{i}" for i in range(k)]}
    tables = {a: checkpointed(backoff_tables(train, a, p)) for a, p in parents.items()}
    last = [F.coalesce(F.lag(as_category(a), i).over(w), F.lit(UNKNOWN)) for a in parents for i in range(k)]
    following = F.collect_list(as_category(s.activity)).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = checkpointed(log.df.select(s.case, F.row_number().over(w).cast("long").alias("prefix_size"), F.array(*last).alias("ctx"), following.alias("suffix")))
    seen = train.select(F.array(*(F.col(f"{a}_Prev{i}") for a in parents for i in range(k))).alias("ctx"))
    graph = context_graph(rows.select("ctx").unionByName(seen).where(F.col("ctx")[0] != end), tables, parents, k, end, longest)
    # states: a context and the length of the run that its last activity ends, 0 where nothing has been predicted yet
    wide = graph.groupBy("ctx").agg(*(F.max(F.when(F.col("rank") == r, F.struct("value", "to"))).alias(f"o{r}") for r in (1, 2)))
    limits = (repeats if repeats is not None else log.df.sparkSession.createDataFrame([], "activity string, length long")).select(F.col("activity").alias("_a"), "length")
    wide = wide.join(limits, F.col("ctx")[0] == F.col("_a"), "left").withColumn("limit", F.coalesce("length", F.lit(1).cast("long"))).drop("_a", "length")
    states = wide.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("limit") + 1)))
    barred = (F.col("n") > F.col("limit")) & (F.col("o1.value") == F.col("ctx")[0])
    step = states.withColumn("o", F.when(barred, F.col("o2")).otherwise(F.col("o1")))
    run = F.when((F.col("n") > 0) & (F.col("o.value") == F.col("ctx")[0]), F.least(F.col("n") + 1, F.col("limit") + 1)).otherwise(F.lit(1).cast("long"))
    power = checkpointed(step.select("ctx", "n", F.col("o.to").alias("to"), run.alias("m"), F.array("o.value").alias("path"), (F.col("o.value") == end).alias("over")))
    zero = F.lit(0).cast("long")
    rolled = rows.select("ctx").distinct().select("ctx", zero.alias("n"), F.col("ctx").alias("to"), zero.alias("m"), F.array().cast("array<string>").alias("path"), (F.col("ctx")[0] == end).alias("over"))

    def then(one: DataFrame, two: DataFrame) -> DataFrame:
        next_ = two.select(F.col("ctx").alias("to"), F.col("n").alias("m"), F.col("to").alias("to2"), F.col("m").alias("m2"), F.col("path").alias("path2"), F.col("over").alias("over2"))
        going = ~F.col("over") & F.col("to2").isNotNull()
        pick = lambda there, here: F.when(going, F.col(there)).otherwise(F.col(here)).alias(here)
        both = one.join(next_, ["to", "m"], "left")
        return checkpointed(both.select("ctx", "n", pick("to2", "to"), pick("m2", "m"), F.when(going, F.concat("path", "path2")).otherwise(F.col("path")).alias("path"), (F.col("over") | F.col("to2").isNull() | F.col("over2")).alias("over")))

    left = longest
    while left:
        if left & 1:
            rolled = then(rolled, power)
        left >>= 1
        if left:
            power = then(power, power)
    path = F.filter("path", lambda x: x != BARRED)
    rolled = written(rolled.select("ctx", path.alias("predicted")))  # of known size: a few contexts go to the rows, and not all rows of a context to one task
    return rows.join(rolled, "ctx").select(s.case, "prefix_size", "suffix", "predicted")
