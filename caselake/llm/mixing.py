"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are queued in a shuffled order, round after round. A document's virtual finish time is the words of
its source up to its end, divided by the source's weight. All queues are put in one global order of finish times, and the
words served up to each place are running totals over that order; where they exceed the budget the mix is cut. A source whose
rounds are over leaves its share to the others from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.llm.common import cut, text_of
from caselake.plans.order import with_running

# Weights of the sources in ascending order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
ROUNDS = 2
SEED = 7
#: Documents are summed in buckets, as many as give this many documents of all sources, so that one large source is no
#: single task; and not more than MOST_BUCKETS, whose totals one task can add up for a source.
BUCKET = 500
MOST_BUCKETS = 1 << 16
SPACES = r"[\x20\x09-\x0D]+"


def words(column: str = "text"):
    """Number of runs of other than ASCII white space; null: 0."""
    text = text_of(column)
    pieces = F.size(F.split(text, SPACES)).cast("long")
    edge = lambda p: text.rlike(p).cast("long")
    return F.when(F.length(text) == 0, 0).otherwise(pieces - edge(r"\A[\x20\x09-\x0D]") - edge(r"[\x20\x09-\x0D]\z"))


def targets(sizes: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with ``weight`` and ``target``.

    Targets share ``budget`` times all sizes by weight and stop at ``rounds`` times the source's size; the excess is shared
    again until none is above. That is the level L at which the sum of min(weight L, rounds size) is the budget. Each step
    aggregates the sources and returns one row to the driver; the level only rises, and a step in which no source is newly
    full is the last. Sources are ranked by code point, null last, in ranges with counts, not in one task.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.encode(F.coalesce("source", F.lit("")), "UTF-8")  # bytes of UTF-8 sort as code points do
    ordered = cut(sizes.withColumn("_null", F.col("source").isNull()).withColumn("_key", key).repartitionByRange(parts, "_null", "_key").withColumn("_part", F.spark_partition_id()))
    before, total = {}, 0
    for r in ordered.groupBy("_part").count().orderBy("_part").collect():  # one row for each range
        before[r["_part"]] = total
        total += r["count"]
    if not total:
        return sizes.withColumn("weight", F.lit(0)).withColumn("target", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_key")) - 1 + F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_part")]
    sources = cut(ordered.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(rank, F.lit(len(weights))).cast("int")]).select("source", "source_size", "weight"))
    limit = F.col("source_size") * rounds
    share = F.lit(0.0)
    full = -1
    level = 0.0
    while True:
        is_full = limit <= F.col("weight") * level
        now = sources.agg(F.count_if(is_full), F.sum(F.when(is_full, limit).otherwise(0)), F.sum(F.when(~is_full, F.col("weight")).otherwise(0)), F.sum("source_size")).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (budget * now[3] - now[1]) / now[2]
    share = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", share)


def queue(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(row, doc_id, text_key, source, source_size, weight, target, size, start): where each row begins in its source's queue.

    The order of a source is that of a seeded MD5 of id and text. Sums run inside buckets of that hash, and bucket totals
    add up the buckets before, so the largest source is spread over as many tasks as it has buckets. ``row`` numbers the rows
    of ``docs``.
    """
    digest = F.md5(F.concat_ws("|", F.lit(SEED).cast("string"), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(text_of(text_column))))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_of(text_column)).alias("text_key"), F.col(source_column).alias("source"), words(text_column).alias("size"), digest.alias("shuffled"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # which fixes the row numbers
    n = rows.count()
    buckets = min(MOST_BUCKETS, max(16, -(-n // BUCKET)))
    width = (1 << 32) // buckets + 1
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") / width).cast("int"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    totals = totals.select("source", "bucket", before.alias("before"))
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), rounds=rounds)
    offsets = cut(totals.join(shares, totals["source"].eqNullSafe(shares["source"])).drop(shares["source"]))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffled", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    placed = rows.join(offsets.withColumnRenamed("bucket", "b").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("row", "doc_id", "text_key", "source", "source_size", "weight", "target", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


def cut_at_budget(queued: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Rows of all rounds with ``finish`` (virtual time), in global order of it, and ``taken``: the words served by the cut.

    At a place with finish time f, the words served are those of the sources that are over, plus f times the weight of the
    others: two running totals over the sorted queue, kept by ranges with one offset each. The cut is in the last stretch
    between places whose words are within the budget; inside it time runs on until the budget is spent, and what each source
    is just serving counts with the words served. No task has the whole order, and the driver has one row for each range.
    """
    source = queued.groupBy("source").agg(F.max("source_size").alias("size"), F.max("weight").alias("weight"))
    all_words, all_weights = source.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("weight")).otherwise(0))).first()
    begin = F.col("start") + F.col("round") * F.col("source_size")
    rows = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("start", begin)
    rows = rows.withColumn("finish", (F.col("start") + F.col("size")) / F.col("weight"))
    over = (F.col("size") > 0) & (F.col("start") + F.col("size") == rounds * F.col("source_size"))
    sums = {"_over_words": F.when(over, rounds * F.col("source_size")).otherwise(0), "_over_weight": F.when(over, F.col("weight")).otherwise(0)}
    ordered = with_running(rows, ["finish", "row", "round"], sums, None)
    served = F.col("_over_words") + (F.lit(all_weights or 0) - F.col("_over_weight")) * F.col("finish")
    spent = budget * (all_words or 0)
    within = ordered.where(served <= spent).agg(F.max("_over_words"), F.max("_over_weight")).first()
    left = (all_weights or 0) - (within[1] or 0)
    time = (spent - (within[0] or 0)) / left if left else float("inf")
    reached = F.floor(F.col("weight") * F.lit(time)) if left else F.col("start") + F.col("size")
    taken = F.greatest(F.lit(0), F.least(F.col("size"), reached - F.col("start"))).cast("long")
    return ordered.drop("_over_words", "_over_weight").withColumn("taken", taken)


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Each row of ``docs`` in each round with ``finish`` and ``taken``: (row, doc_id, text_key, source, size, round, ...).

    Partitions hold following ranges of finish times, each in order. The total budget is spent at the virtual time at which all
    targets are served, so each source's words are its target, rounded down. Repeated rows are documents of their own; null ids
    and null sources are values like others; texts without words are never short of words. Other columns are not read. The
    shuffle is seeded: runs agree. An empty table gives an empty mix.
    """
    return cut_at_budget(queue(docs, id_column, source_column, text_column, rounds), rounds=rounds)
