"""Similarity of two logs: pairs of near traces by a metric filter, nearest variants, and a matching without replacement."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.functions.edit import damerau_between, damerau_near, timed_edit_similarity
from caselake.plans.order import with_index, written

#: Traces whose distances to all others place them.
PIVOTS = 6
#: Variants of a group at most, and of the least that is worth a group of its own; groups of both sides meet as wholes.
GROUP, SMALL = 1 << 12, 1 << 9
#: Pairs that a task of the matching goes through, and pairs of variants whose distances one task takes when no more are left.
TILE, LAST = 1 << 24, 1 << 26
#: Matched runs of cases are cut into so many, so that a run of any length is dealt out.
CHUNK = 1000
MATCHED = "id long, o_id long, distance double, n long, from_a long, from_b long"


def placed(variants: DataFrame, pivots: list[list[str]], column: str = "variant") -> DataFrame:
    """``variants`` with their distances to the pivots (``to``) and their size."""

    def to(v: pa.Array) -> pa.Array:
        i, j = (x.ravel() for x in np.indices((len(v), len(pivots))))
        distances = damerau_between(v, pa.array(pivots, v.type), i, j)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(pivots), "int32"), pa.array(distances, "float64"))

    return variants.withColumns({"to": F.arrow_udf(to, "array<double>")(column), "size": F.size(column)})


def _groups(side: DataFrame, pivots: int, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Variants next to each other in ``place`` in groups of about one size, and a row for each group with the ranges of sizes and
    distances to pivots."""
    n, parts = side.count(), int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(math.ceil(n / GROUP), min(math.ceil(math.sqrt(2 * parts)), math.ceil(n / SMALL)))
    cuts = side.approxQuantile("place", [i / groups for i in range(1, groups)], 1 / (10 * groups)) if groups > 1 else []
    rows = side.withColumn(f"{prefix}group", sum(((F.col("place") >= c).cast("int") for c in cuts), F.lit(0)))
    places = [F.col("size"), *(F.col("to")[i] for i in range(pivots))]
    return rows, rows.groupBy(f"{prefix}group").agg(*(f(c).alias(f"{prefix}{n}_{i}") for i, c in enumerate(places) for f, n in ((F.min, "low"), (F.max, "high"))))


def _met(left: DataFrame, right: DataFrame, radius: float, pivots: int, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of each pair of groups whose ranges come within the radius; a task has the rows of one pair at a time."""
    (a, x), (b, y) = _groups(left, pivots, "a"), _groups(right, pivots, "b")
    near = F.lit(True)
    for i in range(pivots + 1):
        near &= (F.col(f"alow_{i}") - F.col(f"bhigh_{i}") <= radius) & (F.col(f"blow_{i}") - F.col(f"ahigh_{i}") <= radius)
    met = x.crossJoin(y).where(near).select("agroup", "bgroup")
    parts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {"x": F.col("agroup"), "y": F.col("bgroup")}  # columns of its own for each side
    spread = lambda side, key: side.repartition(parts, key).join(met.repartition(parts, key), key)  # noqa: E731  (else few tasks make all copies)
    dealt = lambda side, key: spread(side, key).withColumns(own).drop("agroup", "bgroup", "place").repartition(parts, "x", "y").groupBy("x", "y")
    return dealt(a, "agroup").cogroup(dealt(b, "bgroup")).applyInArrow(f, schema)


def _compared(x: pa.Table, y: pa.Table, radius: float, compare: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, distance) of the pairs of two groups that no bound keeps apart; x has to be in order of sizes."""
    variant, to = ([c.combine_chunks() for c in (x[n], y[n])] for n in ("variant", "to"))
    return damerau_near(*variant, radius, *(c.flatten().to_numpy().reshape(len(c), -1) for c in to), compare)


def _in_order(x: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by size, and their ids."""
    x = x.sort_by([("size", "ascending"), ("id", "ascending")])
    return x, x["id"].to_numpy()


def _one_apart(left: DataFrame, right: DataFrame, low: float) -> DataFrame:
    """(id, distance, others) of all pairs with ``low`` < distance <= 1: these are equal with an item of one or of both left out. So
    they meet by hashes of what is left, and no more pairs are compared than a few for each that is near."""

    def keys(side: DataFrame, id: str) -> DataFrame:
        n = F.size("variant")
        without = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.slice("variant", F.lit(1), i - 1), F.slice("variant", i + 1, n))))
        return side.select(F.col("id").alias(id), F.explode(F.array_distinct(F.concat(F.array(F.xxhash64("variant")), F.when(n > 0, without).otherwise(F.array().cast("array<bigint>"))))).alias("key"))

    def of(v: pa.Array, o: pa.Array) -> pa.Array:
        each = np.arange(len(v))
        return pa.array(damerau_between(v, o, each, each, 1.0))

    met = keys(left, "id").join(keys(right, "o_id"), "key").select("id", "o_id").distinct()
    compared = _named(met, left, right).select("id", "o_id", F.arrow_udf(of, "double")("variant", "other").alias("distance"))
    return compared.where((F.col("distance") > low) & (F.col("distance") <= 1)).select("id", "distance", F.array("o_id").alias("others"))


def near_ids(left: DataFrame, right: DataFrame, low: float, radius: float, pivots: int, compare: bool = True) -> DataFrame:
    """(id, distance, others) of all pairs with ``low`` < distance <= ``radius``: variants of the right at a distance from one of the left.

    The distance is a metric, so distances to a pivot differ by no more than it; nor do lengths, nor the counts of items that
    only one side has. Variants next to each other in the order of these make a group; a group meets those whose ranges come
    within the radius, and inside two groups the bounds of each pair discard before anything is compared.
    """
    if radius == 0 and compare:
        both = left.select("id", "variant").join(right.select(F.col("id").alias("o_id"), "variant"), "variant")
        return both.select("id", F.lit(0.0).alias("distance"), F.array("o_id").alias("others"))
    if radius == 1 and compare:
        return _one_apart(left, right, low)

    def lists(x: pa.Table, y: pa.Table) -> pa.Table:
        (x, a), (y, b), found = _in_order(x), _in_order(y), []
        for i, j, distance in _compared(x, y, radius, compare):
            kept = (distance > low) & (distance <= radius)
            found.append((i[kept], j[kept], distance[kept]))
        i, j, distance = (np.concatenate(c) for c in zip(*found, (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), strict=True))
        order = np.lexsort((distance, i))
        i, j, distance = i[order], j[order], distance[order]
        start = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(distance, prepend=-1) != 0))
        others = pa.ListArray.from_arrays(pa.array(np.append(start, len(i)), "int32"), pa.array(b[j]))
        return pa.table({"id": a[i[start]], "distance": distance[start], "others": others})

    return _met(left, right, radius, pivots, lists, "id long, distance double, others array<long>")


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("id", "distance", F.explode("others").alias("o_id"))


def _named(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return pairs.join(left.select("id", "variant"), "id").join(right.select(F.col("id").alias("o_id"), F.col("variant").alias("other")), "o_id")


def candidates(left: DataFrame, right: DataFrame, radius: float, pivots: int) -> DataFrame:
    """(variant, other): pairs that no bound keeps apart by more than ``radius``."""
    return _named(_pairs(near_ids(left, right, -1, radius, pivots, compare=False)), left, right).select("variant", "other")


def near_pairs(left: DataFrame, right: DataFrame, low: float, radius: float, pivots: int) -> DataFrame:
    """(variant, other, distance) of all pairs with ``low`` < distance <= ``radius``; what bounds leave is compared."""
    return _named(_pairs(near_ids(left, right, low, radius, pivots)), left, right).select("variant", "other", "distance")


def _radii(longest: int) -> Iterator[tuple[float, float]]:
    """(-1, 0], (0, 1], (1, 2], (2, 4], ... until nothing can be further apart."""
    low, high = -1.0, 0.0
    while low < longest:
        yield low, high
        low, high = high, max(1.0, 2 * high)


def _both_sides(a: DataFrame, b: DataFrame, column: str, position: str | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """Variants of both sides with their counts and places, the number of pivots, the longest trace. Pivots are six traces of
    ``a`` by their hash: they are all that goes through the driver. ``id`` rises with the variants; it is the first ``position``
    of each, if rows have one in an order that starts with the trace."""
    first = [F.min(position).alias("id")] if position else []
    counted = [written(x.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("variant")).agg(F.count("*").alias("cases"), *first)) for x in (a, b)]
    pivots = [r[0] for r in counted[0].orderBy(F.xxhash64("variant"), "variant").limit(PIVOTS).select("variant").collect()]
    near = ["size", *(F.col("to")[i] for i in range(len(pivots)))]
    va, vb = (written(with_index(placed(c if position else with_index(c, "variant", name="id"), pivots), *near, "id", name="place")) for c in counted)
    longest = max(x.agg(F.max("size")).first()[0] or 0 for x in (va, vb))
    return va, vb, len(pivots), longest


def nearest_variants(a: DataFrame, b: DataFrame, column: str = "activity") -> DataFrame:
    """(variant, cases, nearest, distance, similarity): the nearest variant of b for each of a, with replacement; ties: the smallest.

    The radius doubles; variants that have found one leave, so only those far from all are compared with many. Null traces take
    no part; without traces on a side there are no rows.
    """
    va, vb, pivots, longest = _both_sides(a, b, column)
    out, left = None, va
    for low, high in _radii(longest):
        if left.isEmpty() or vb.isEmpty():
            break
        best = near_pairs(left, vb, low, high, pivots).groupBy("variant").agg(F.min(F.struct("distance", F.col("other").alias("nearest"))).alias("b"))
        found = written(best.select("variant", "b.nearest", "b.distance"))
        out = found if out is None else out.unionByName(found)
        left = written(left.join(found.select("variant"), "variant", "left_anti"))
    schema = "variant array<string>, nearest array<string>, distance double"
    out = a.sparkSession.createDataFrame([], schema) if out is None else out
    size = F.greatest(F.size("variant"), F.size("nearest"))
    return out.join(va.select("variant", "cases"), "variant").select("variant", "cases", "nearest", "distance", F.when(size > 0, 1 - F.col("distance") / size).otherwise(1.0).alias("similarity"))


def _of_pair(x: pa.Table, y: pa.Table) -> pa.Table:
    """One row: variants of two groups with what is left and used of them, and all distances between them as bytes."""
    (x, a), (y, b) = _in_order(x), _in_order(y)
    longest = max(x["size"].to_numpy().max(initial=0), y["size"].to_numpy().max(initial=0))
    table = np.empty((len(a), len(b)), np.min_scalar_type(longest + 1))
    for i, j, distance in _compared(x, y, longest):
        table[i, j] = distance
    sides = {f"{p}{c}": [t[c].to_numpy()] for p, t in (("", x), ("o_", y)) for c in ("id", "cases", "used")}
    return pa.table(sides | {"width": [table.itemsize], "distances": pa.array([table.tobytes()], "binary")})


OF_PAIR = ", ".join(f"{p}{c} array<long>" for p in ("", "o_") for c in ("id", "cases", "used")) + ", width long, distances binary"


def _matches(of: list[tuple[int, int, float, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*of, strict=True)], ["id", "o_id", "distance", "n", "from_a", "from_b"])


class _Side:
    """What is left of variants, in order of their ids, and how many of their cases were used."""

    def __init__(self, ids: np.ndarray, cases: np.ndarray, used: np.ndarray):
        self.ids, first = np.unique(ids, return_index=True)
        self.left, self.next = cases[first].copy(), used[first].copy()

    def take(self, at: int, n: int) -> int:
        """The place of the first of ``n`` cases."""
        self.left[at] -= n
        self.next[at] += n
        return int(self.next[at] - n)


def _from_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all variants in order of (distance, id, o_id): each takes what is left of both. The variant with the smallest
    (distance, id) comes next; as others only leave, its least distance is asked for anew when it comes, and it waits if it grew."""
    parts = [r for batch in batches for r in zip(*(c if n == "distances" else c.to_pylist() if n == "width" else [x.values.to_numpy() for x in c] for n, c in zip(batch.schema.names, batch.columns, strict=True)), strict=True)]
    if not parts:
        return
    a, b = (_Side(*(np.concatenate([r[k + i] for r in parts]) for i in range(3))) for k in (0, 3))
    kind = np.dtype(f"u{max(r[6] for r in parts)}")
    table, none = np.empty((len(a.ids), len(b.ids)), kind), np.iinfo(kind).max
    for r in parts:
        block = np.frombuffer(r[7].as_buffer(), f"u{r[6]}").reshape(len(r[0]), len(r[3]))
        table[np.ix_(np.searchsorted(a.ids, r[0]), np.searchsorted(b.ids, r[3]))] = block
    del parts
    gone, row, out = np.zeros(len(b.ids), kind), np.empty(len(b.ids), kind), []
    turns = [(d, i) for i, d in enumerate(table.min(axis=1).tolist())]
    heapq.heapify(turns)
    while turns:
        distance, i = turns[0]
        np.bitwise_or(table[i], gone, out=row)
        least = int(row.min())
        if least == none:
            break
        if least > distance:
            heapq.heapreplace(turns, (least, i))
            continue
        for j in np.flatnonzero(row == least).tolist():
            n = int(min(a.left[i], b.left[j]))
            out.append((int(a.ids[i]), int(b.ids[j]), float(least), n, a.take(i, n), b.take(j, n)))
            if not b.left[j]:
                gone[j] = none
            if not a.left[i]:
                heapq.heappop(turns)
                break
    if out:
        yield _matches(out)


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of others in order of (distance, id): each variant takes what is left of its others in turn. Before the lists come the
    variants themselves, of the right (kind 0) and of the left (1), with what is left and used of them."""
    known: list[list[tuple]] = [[], []]
    sides: list[_Side] = []
    for batch in batches:
        kind, ids, distances, lists = batch.column("kind").to_numpy(), batch.column("id").to_numpy(), batch.column("distance").to_numpy(), batch.column("others")
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            if len(at):
                known[k].append((ids[at], *lists.slice(at[0], len(at)).flatten().to_numpy().reshape(-1, 2).T))
        at = np.flatnonzero(kind == 2)
        if not len(at) or not known[0] or not known[1]:
            continue
        b, a = sides = sides or [_Side(*(np.concatenate(c) for c in zip(*k, strict=True))) for k in known]
        lists = lists.slice(at[0], len(at))
        flat, ends, out = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy()), []
        place = lambda side, x: np.minimum(np.searchsorted(side.ids, x), len(side.ids) - 1)
        others, rows = place(b, flat), place(a, ids[at])
        others[b.ids[others] != flat] = -1  # they have left
        for i, there, v, distance, first, end in zip(rows.tolist(), (a.ids[rows] == ids[at]).tolist(), ids[at].tolist(), distances[at].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if not there or not a.left[i]:
                continue
            j = others[first:end]
            j = j[j >= 0]
            for o in j[b.left[j] > 0].tolist():
                n = int(min(a.left[i], b.left[o]))
                out.append((v, int(b.ids[o]), distance, n, a.take(i, n), b.take(o, n)))
                if not a.left[i]:
                    break
        if out:
            yield _matches(out)


def matched_ids(va: DataFrame, vb: DataFrame, pivots: int, longest: int) -> DataFrame:
    """(id, o_id, distance, n, from_a, from_b): n cases of each pair of variants matched, those from the given places on.

    The result of going through all pairs in order of (distance, variant, other) and matching what is left of both. While many
    variants are left, pairs come by growing radius, so that those of far variants are only made for what nearer ones have left.
    Pairs of one distance make a square, variants by others, cut into ``sides`` x ``sides`` tiles: what a tile gets depends on the
    tiles left of it and above it alone, so the tiles of a diagonal go at once, each sorted and read in order. When no more than
    ``LAST`` pairs are left, tasks make a table of all their distances, a byte each, and one goes through it.
    """
    spark = va.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.withColumn("used", F.lit(0).cast("long")) for x in (va, vb))
    counts = [left.count(), right.count()]
    all_of = [(x.agg(F.max("id")).first()[0] or 0) + 1 for x in (va, vb)]
    found_in = []

    def spent(side: DataFrame, by: DataFrame, key: str) -> DataFrame:
        """What is left of a side; variants without cases leave."""
        n = by.groupBy(F.col(key).alias("id")).agg(F.sum("n").alias("n"))
        rest = side.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        return written(rest.withColumns({"cases": F.col("cases") - F.col("n"), "used": F.col("used") + F.col("n")}).where("cases > 0").drop("n"))

    low, step = -1, 1
    while low < longest and all(counts):
        if counts[0] * counts[1] <= LAST:
            found_in.append(written(_met(left, right, longest, pivots, _of_pair, OF_PAIR).repartition(1).mapInArrow(_from_table, MATCHED)))
            break
        high = min(longest, low + step)
        lists = near_ids(left, right, low, high, pivots).groupBy("distance", "id").agg(F.sort_array(F.flatten(F.collect_list("others"))).alias("others"))
        lists = written(lists)
        n = lists.agg(F.sum(F.size("others"))).first()[0] or 0
        if high > 0:
            step = max(1, step // 2) if n > sum(counts) else 2 * step
        low = high
        if not n:
            continue
        sides = math.ceil(math.sqrt(n / TILE))
        tile = lambda c, of: F.floor(c * sides / F.lit(of))
        turns: list[tuple] = [(None, None)]
        if sides > 1:
            turns = [(d, k) for d in sorted(r[0] for r in lists.select("distance").distinct().collect()) for k in range(2 * sides - 1)]
        for d, k in turns:
            row = lambda kind, distance, others, t: [F.lit(kind).alias("kind"), distance.alias("distance"), "id", others.alias("others"), t.alias("tile")]
            state, own = F.array("cases", "used"), tile(F.col("id"), all_of[0])
            live, others = lists, F.col("others")
            if k is not None:
                live, others = lists.where(F.col("distance") == d), F.filter("others", lambda o: tile(o, all_of[1]) == k - own)  # noqa: B023
            heads = right.select(*row(0, F.lit(-1.0), state, F.lit(k or 0) - tile(F.col("id"), all_of[1]))), left.select(*row(1, F.lit(-1.0), state, own))
            rows = heads[0].unionByName(heads[1]).unionByName(live.select(*row(2, F.col("distance"), others, own)).where(F.size("others") > 0))
            dealt = rows.repartition(min(parts, sides), "tile").drop("tile").sortWithinPartitions("kind", "distance", "id")
            found_in.append(written(dealt.mapInArrow(_in_turn, MATCHED)))
            left, right = spent(left, found_in[-1], "id"), spent(right, found_in[-1], "o_id")
        counts = [left.count(), right.count()]
    out = spark.createDataFrame([], MATCHED)
    for f in found_in:
        out = out.unionByName(f)
    return out


def matched_variants(va: DataFrame, vb: DataFrame, pivots: int, longest: int) -> DataFrame:
    """(variant, other, distance, n, from_a, from_b): n cases of each pair matched, those from the given places on; see ``matched_ids``."""
    return _named(matched_ids(va, vb, pivots, longest), va, vb).select("variant", "other", "distance", "n", "from_a", "from_b")


def match_logs(a: DataFrame, b: DataFrame, trim: float = 0.2, seed: int = 1, case: str = "case_id", activity: str = "activity", gaps: str = "gap", start: str = "start") -> DataFrame:
    """(case, other_case, distance, similarity, timed_similarity, time_error): each trace of a with one of b, none used twice.

    Both sides have a row a case: its activities, the time before each of them, and its start. Of a, ``trim`` of the cases are
    left out at either end of the order of starts, as a simulation warms up and runs out; of b, as many as are left of a are
    drawn by a seeded hash. Pairs of least distance come first (see ``matched_ids``), equal traces in order of their starts.
    ``similarity`` is 1 - distance / longer length, ``timed_similarity`` the same where keeping an activity costs the difference
    of its times, ``time_error`` the absolute difference of the sums of times. Cases left over on either side have no row.
    """
    columns = [F.col(c).alias(n) for c, n in ((case, "case"), (activity, "variant"), (gaps, "gaps"), (start, "start"))]
    a, b = (written(x.select(*columns).where(F.col("variant").isNotNull())) for x in (a, b))
    n = a.count()
    cut = round(n * trim)
    a = with_index(a, "start", "case").where((F.col("idx") >= cut) & (F.col("idx") < n - cut)).drop("idx")
    b = with_index(b, F.xxhash64("case", F.lit(seed)), "case").where(F.col("idx") < max(0, n - 2 * cut)).drop("idx")
    ranked = [written(with_index(x, "variant", "start", "case")) for x in (a, b)]
    va, vb, pivots, longest = _both_sides(*ranked, "variant", "idx")
    pairs = matched_ids(va, vb, pivots, longest)
    runs = pairs.select("n", (F.col("id") + F.col("from_a")).alias("at_a"), (F.col("o_id") + F.col("from_b")).alias("at_b"), "distance")
    dealt = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    dealt = dealt.withColumn("k", F.explode(F.sequence("k", F.least(F.col("k") + CHUNK, "n") - 1)))
    cases = ranked[0].join(dealt.select((F.col("at_a") + F.col("k")).alias("idx"), (F.col("at_b") + F.col("k")).alias("idx_b"), "distance"), "idx").drop("idx")
    others = ranked[1].select(F.col("idx").alias("idx_b"), F.col("case").alias("other_case"), F.col("variant").alias("other"), F.col("gaps").alias("other_gaps"))
    both = cases.join(others, "idx_b").repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case")  # files of tables may be of any size
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    size = F.greatest(F.size("variant"), F.size("other"))
    return both.select(
        F.col("case").alias(case), "other_case", "distance", F.when(size > 0, 1 - F.col("distance") / size).otherwise(1.0).alias("similarity"),
        timed_edit_similarity("variant", "other", "gaps", "other_gaps").alias("timed_similarity"), F.abs(total("gaps") - total("other_gaps")).alias("time_error"),
    )
