"""Prediction of the next value of an attribute from its parents, with back-off, and what follows from it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.functions.edit import edit_similarity, timed_edit_similarity
from caselake.operators.model import key_of
from caselake.plans.log import EventLog, as_category
from caselake.plans.order import checkpointed, with_index

UNKNOWN = "0"


def backoff_tables(df: DataFrame, value: str, parents: list[str], weight: str | None = None) -> DataFrame:
    """(mask, key, value, n, p): distributions of ``value`` given every subset of the parents.

    Bit i of ``mask`` says that parent i is used; ``key`` holds the used parents' values, others null. Rows are first counted
    by all parents (or ``weight``, if ``df`` holds counts, is summed), then rolled up to the subsets by one pass of grouping sets
    over the counts.
    """
    names = [f"p{i}" for i in range(len(parents))]
    counts = df.groupBy(*(as_category(p).alias(n) for p, n in zip(parents, names, strict=True)), as_category(value).alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("m"))
    subsets = [s for r in range(len(names) + 1) for s in combinations(names, r)]
    sets = counts.groupingSets([[F.col("value"), *map(F.col, s)] for s in subsets], *names, "value").agg(F.sum("m").alias("n"), F.grouping_id().alias("g"))
    size = len(names)
    mask = sum(((1 - F.getbit(F.col("g"), F.lit(size - i)).cast("int")) * (1 << i) for i in range(size)), F.lit(0)).cast("long")
    rows = sets.select(mask.alias("mask"), F.array(*names).alias("key") if names else F.array().cast("array<string>").alias("key"), "value", "n")
    return rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("mask", "key")))


def of_contexts(df: DataFrame, tables: DataFrame, parents: list[str]) -> DataFrame:
    """(ctx, value, p): the distribution of the next value for each different context of ``df``, if there is one.

    All parents seen together: given all. Some parent's value never seen: given those seen (none: the marginal). All seen, but
    not together: the mean, over each parent left out, of the distribution given the rest; a rest that was never seen adds
    nothing but counts. Contexts are few next to rows, so each different one is resolved once.
    """
    n = len(parents)
    full = (1 << n) - 1
    contexts = df.select(_context(parents)).distinct()
    one = tables.where(F.col("mask").isin([1 << i for i in range(n)] or [-1])).select("mask", "key").distinct()
    single = one.select("mask", F.explode("key").alias("v")).where("v is not null").distinct()
    wide = contexts
    seen = F.lit(0).cast("long")
    for i in range(n):
        of = single.where(F.col("mask") == 1 << i).select(F.col("v").alias(f"_v{i}"))
        wide = wide.join(of, F.col("ctx")[i] == F.col(f"_v{i}"), "left")
        seen = seen + F.when(F.col(f"_v{i}").isNotNull(), 1 << i).otherwise(0)
    wide = wide.withColumn("seen", seen).select("ctx", "seen")
    known = tables.where(F.col("mask") == full).select(F.col("key").alias("ctx")).distinct().withColumn("exact", F.lit(True))
    wide = wide.join(known, "ctx", "left")
    rest = [full & ~(1 << i) for i in range(n)]
    masks = F.when(F.col("exact"), F.array(F.lit(full).cast("long"))).when(F.col("seen") < full, F.array("seen")).otherwise(F.array(*(F.lit(m).cast("long") for m in rest)) if n else F.array(F.lit(0).cast("long")))
    asked = wide.withColumn("mask", F.explode(masks)).withColumn("parts", F.size(masks))
    used = F.transform("ctx", lambda v, i: F.when(F.getbit(F.col("mask"), i) == 1, v)) if n else F.col("ctx")
    found = _joined(asked.withColumn("key", used), tables)
    return found.groupBy("ctx", "value").agg((F.sum("p") / F.first("parts")).alias("p"))


def _context(parents: list[str]) -> Column:
    return (key_of(parents) if parents else F.array().cast("array<string>")).alias("ctx")


def predict(df: DataFrame, tables: DataFrame, parents: list[str], keys: list[str]) -> DataFrame:
    """(keys, value, p): the distribution of the next value for each row of ``df``, that of its context (see ``of_contexts``)."""
    rows, spread = df.select(*keys, _context(parents)), of_contexts(df, tables, parents)
    return rows.join(spread, "ctx", "left").select(*keys, F.coalesce("value", F.lit(UNKNOWN)).alias("value"), F.coalesce("p", F.lit(0.0)).alias("p"))


def _joined(asked: DataFrame, tables: DataFrame) -> DataFrame:
    """Join on the mask and the used values; unused ones are null on both sides, so they are compared as one text."""
    text = lambda: F.to_json(F.struct("mask", "key"))
    return asked.withColumn("_j", text()).join(tables.select(F.to_json(F.struct("mask", "key")).alias("_j"), "value", "p"), "_j")


def most_likely(distribution: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, predicted, p_predicted): the likeliest value; ties: the smallest."""
    best = F.min(F.struct((-F.round("p", 12)).alias("q"), F.col("value"), F.col("p")))
    return distribution.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias("predicted"), F.col("b.p").alias("p_predicted"))


def results(df: DataFrame, distribution: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, expected, predicted, p_predicted, p_expected), one row an event."""
    truth = df.select(*keys, as_category(value).alias("expected"))
    top = most_likely(distribution, keys)
    of_true = truth.join(distribution.withColumnRenamed("value", "expected"), [*keys, "expected"], "left")
    return of_true.join(top, keys).select(*keys, "expected", "predicted", "p_predicted", F.coalesce("p", F.lit(0.0)).alias("p_expected"))


def predicted_results(df: DataFrame, tables: DataFrame, value: str, parents: list[str], keys: list[str]) -> DataFrame:
    """``results`` of ``predict`` for keys that are different in all rows, without a row for each value of each row's distribution:
    the likeliest value and the probability of the true one are looked up by context."""
    spread = checkpointed(of_contexts(df, tables, parents))  # as many rows as contexts have values
    rows = df.select(*keys, as_category(value).alias("expected"), _context(parents))
    found = rows.join(most_likely(spread, ["ctx"]), "ctx", "left").join(spread.withColumnRenamed("value", "expected"), ["ctx", "expected"], "left")
    known = lambda c, of: F.coalesce(c, F.lit(of)).alias(c)
    return found.select(*keys, "expected", known("predicted", UNKNOWN), known("p_predicted", 0.0), F.coalesce("p", F.lit(0.0)).alias("p_expected"))


def next_event(train: DataFrame, test: DataFrame, value: str, parents: list[str], keys: list[str]) -> DataFrame:
    """Learn from ``train``, predict each row of ``test``: (keys, expected, predicted, p_predicted, p_expected)."""
    return results(test, predict(test, backoff_tables(train, value, parents), parents, keys), value, keys)


def average_models(distributions: list[DataFrame], keys: list[str], skip_unknown: bool = False) -> DataFrame:
    """(keys, value, p): mean probability of each value over models; a model without it counts as 0."""
    rows = None
    for d in distributions:
        rows = d if rows is None else rows.unionByName(d)
    if skip_unknown:
        rows = rows.where(F.col("value") != UNKNOWN)
    return rows.groupBy(*keys, "value").agg((F.sum("p") / len(distributions)).alias("p"))


def predict_outcome(train: DataFrame, test: DataFrame, label: str, parents: list[str], keys: list[str], case: str) -> DataFrame:
    """(case, expected, predicted): the label whose probabilities, summed over the events of a case, are highest."""
    p = predict(test, backoff_tables(train, label, parents), parents, keys)
    sums = p.join(test.select(*keys, *([case] if case not in keys else [])), keys).groupBy(case, "value").agg(F.sum("p").alias("p"))
    truth = test.groupBy(case).agg(F.min(as_category(label)).alias("expected"))
    return truth.join(most_likely(sums, [case]), case).select(case, "expected", "predicted")


def mean_duration(train: DataFrame, test: DataFrame, duration: str, parents: list[str], keys: list[str]) -> DataFrame:
    """(keys, expected, predicted): the mean of ``duration`` over training rows with the same parents, else over all."""
    means = train.groupBy(key_of(parents).alias("k")).agg(F.avg(duration).alias("m"))
    overall = train.agg(F.avg(duration).alias("all"))
    rows = test.withColumn("k", key_of(parents)).join(means, "k", "left").join(F.broadcast(overall))
    return rows.select(*keys, F.col(duration).alias("expected"), F.coalesce("m", "all").alias("predicted"))


def absolute_error(results_: DataFrame, by: list[str] | None = None) -> DataFrame:
    return results_.groupBy(*(by or [])).agg(F.avg(F.abs(F.col("expected") - F.col("predicted"))).alias("mae"), F.count("*").alias("n"))


def suffix_similarity(pairs: DataFrame, a: str = "suffix", b: str = "predicted") -> DataFrame:
    """Add ``similarity``; distinct pairs are compared once."""
    distinct = pairs.select(a, b).distinct().withColumn("similarity", edit_similarity(a, b))
    return pairs.join(distinct, [a, b])


#: First code point of the letters that stand for activities, and how many there may be.
FIRST_LETTER, MOST_LETTERS = 0x4E00, 20_000


def letters_of(df: DataFrame, column: str) -> DataFrame:
    """(value, letter) for each distinct item of an array column: one character of its own for each."""
    items = with_index(df.select(F.explode(column).alias("value")).where("value IS NOT NULL").distinct(), "value", name="i")
    return items.select("value", F.decode(F.unhex(F.lpad(F.hex(F.col("i") + FIRST_LETTER), 4, "0")), "UTF-16BE").alias("letter"))


def text_similarity(pairs: DataFrame, a: str = "suffix", b: str = "predicted", letters: DataFrame | None = None) -> DataFrame:
    """Add ``levenshtein`` (1 - distance / longer length, each activity as one letter) and ``jaccard`` of the sets.

    ``letters`` has a character for each activity (see ``letters_of``; by default of both columns). It is one broadcast row, of
    ``MOST_LETTERS`` entries at most: more activities are an error, as there is no letter for each.
    """
    letters = letters_of(pairs.select(F.concat(a, b).alias("_both")), "_both") if letters is None else letters
    letters = checkpointed(letters)
    if letters.count() > MOST_LETTERS:
        raise ValueError(f"more than {MOST_LETTERS} activities")
    row = letters.agg(F.map_from_entries(F.collect_list(F.struct("value", "letter"))).alias("_letters"))
    letter = lambda c: F.array_join(F.transform(c, lambda x: F.col("_letters")[x]), "")
    longest = F.greatest(F.size(a), F.size(b))
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    pairs = pairs.join(F.broadcast(row))
    return pairs.withColumn("levenshtein", F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(letter(a), letter(b)) / longest)).withColumn("jaccard", F.when(either == 0, 1.0).otherwise(both / either)).drop("_letters")


def timed_similarity(pairs: DataFrame, a: str, b: str, ta: str, tb: str) -> DataFrame:
    return pairs.withColumn("similarity", timed_edit_similarity(a, b, ta, tb))
