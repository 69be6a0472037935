"""Densities of numeric columns: Gaussian kernels on a grid of counts, by the values of discrete parents."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.functions.columns import draw, log_space
from caselake.operators.model import FLOOR, key_of
from caselake.plans.order import checkpointed

#: A group with that many training rows or fewer uses the density of all rows.
LEAST_ROWS = 20
NORMAL = math.sqrt(2 * math.pi)
#: Rows that ask for densities in one piece of a block, and entries of a table of partial sums.
PIECE, ENTRIES = 1 << 15, 1 << 22
#: Cost of a categorical parent by the number of numeric columns.
COMPLEXITY = (4, 19, 67, 223, 768, 2790, 10700, 43700, 187000, 842000)


Numbers = float | list[float]


def _each(value: Numbers, columns: list[str]) -> list[float]:
    return list(value) if isinstance(value, (list, tuple)) else [value] * len(columns)


def _list(columns: str | list[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _present(columns: list[str]) -> Column:
    """All columns hold a number."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns))


def _places(columns: list[str], delta: Numbers) -> list[Column]:
    return [F.round(F.col(c).cast("double") / d).cast("long") for c, d in zip(columns, _each(delta, columns), strict=True)]


def grid(train: DataFrame, column: str | list[str], parents: list[str], delta: Numbers) -> DataFrame:
    """(key, bin, n, total): training values rounded to multiples of ``delta``, of each parent tuple and (key null) of all.

    Of one column ``bin`` is a long, of several an array. Rows that lack a number are left out.
    """
    columns = _list(column)
    places = _places(columns, delta)
    rows = train.where(_present(columns)).select(key_of(parents).alias("key"), (F.array(*places) if len(columns) > 1 else places[0]).alias("bin"))
    return with_totals(rows.groupBy("key", "bin").agg(F.count("*").alias("n")))


def with_totals(bins: DataFrame) -> DataFrame:
    """A grid from counts (key, bin, n) of parent tuples."""
    all_ = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("array<string>").alias("key"), "bin", "n")
    bins = bins.unionByName(all_)
    return bins.join(bins.groupBy("key").agg(F.sum("n").alias("total")).withColumnRenamed("key", "k2"), F.col("key").eqNullSafe(F.col("k2"))).drop("k2")


def _sums(values: np.ndarray, at: np.ndarray, cells: np.ndarray, n: np.ndarray, widths: list[float], deltas: list[float], reach: list[int]) -> np.ndarray:
    """Sum of n times the kernels of all dimensions, for each row of values (which lie in the cells ``at``), over all cells in reach.

    A kernel is a product over dimensions, so one dimension after another is summed out: the counts are a matrix of this
    dimension's cells by what cells there are of the later ones, and rows that agree so far share its product.
    """
    d = values.shape[1]
    later, tail, tails = [], np.zeros(len(cells), int), 1
    for i in reversed(range(d)):  # cells from dimension i on are (this one's place, the tail's place)
        axis, place = np.unique(cells[:, i], return_inverse=True)
        code = place * tails + tail
        places, tail = np.unique(code, return_inverse=True)
        later.insert(0, (axis, tails, places))
        tails = len(places)
    counts = np.bincount(code, n, len(later[0][0]) * later[0][1])

    def kernels(i: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        b = later[i][0]
        return np.where(np.abs(c[:, None] - b) <= reach[i], np.exp(-(((x[:, None] - b * deltas[i]) / widths[i]) ** 2) / 2), 0.0)

    order = np.lexsort(values.T[::-1])
    values, at, out = values[order], at[order], np.zeros(len(values))

    def run(low: int, high: int) -> None:
        x = values[low:high]
        new = np.ones((d, len(x)), bool)  # whether a row starts a new run of equal values up to dimension i
        for i in range(d):
            new[i, 1:] = (x[1:, i] != x[:-1, i]) | (new[i - 1, 1:] if i else False)
        if len(x) > 1 and max(new[i].sum() * later[i][1] for i in range(d)) > ENTRIES:
            run(low, (low + high) // 2)
            run((low + high) // 2, high)
            return
        table, of = counts[None, :], np.zeros(len(x), int)
        for i in range(d):
            first = np.flatnonzero(new[i])
            wide, tail = len(later[i][0]), later[i][1]
            k = kernels(i, x[first, i], at[low + first, i])
            if i:
                full = np.zeros((len(table), wide * tail))
                full[:, later[i][2]] = table
            else:
                full = table
            full = full.reshape(-1, wide, tail)
            if len(full) == 1:
                table = k @ full[0]
            else:
                step, table = max(1, ENTRIES // (wide * tail)), np.empty((len(first), tail))
                for j in range(0, len(first), step):
                    table[j : j + step] = np.matmul(k[j : j + step, None, :], full[of[first[j : j + step]]])[:, 0]
            of = np.cumsum(new[i]) - 1
        out[order[low:high]] = table[of, 0]

    run(0, len(values))
    return out


def _met(names: list[str], widths: list[float], deltas: list[float], reach: list[int]):
    """Function of (rows that ask, cells around them) to the rows with their density; without cells in reach it is null."""
    d = range(len(names))

    def met(ask: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = ask[["_g", *names]].copy()
        if not len(ask) or not len(cells):
            return out.assign(_density=np.nan).iloc[:0]
        of = lambda df, c: df[[f"{c}{i}" for i in d]].to_numpy()
        sums = _sums(ask[names].to_numpy(), of(ask, "_c"), of(cells, "_b"), cells["n"].to_numpy(dtype="float64"), widths, deltas, reach)
        out["_density"] = sums / cells["total"].iloc[0] / math.prod(h * NORMAL for h in widths)
        return out[sums > 0]

    return met


def add_density(df: DataFrame, bins: DataFrame, column: str | list[str], parents: list[str], bandwidth: Numbers, delta: Numbers, output: str) -> DataFrame:
    """``df`` with the kernel density of each row's values, in its parents' group if that is large enough, else of all rows.

    Kernels reach 8 bandwidths in each dimension; further off the density is null, as it is where a value is missing. Rows are
    gathered in blocks twice as wide as that reach, and cells go to the blocks that they reach; a block of many rows is
    dealt to pieces. Inside one no row meets a cell: dimensions are summed out one after another. Rows of equal values are
    computed once.
    """
    columns = _list(column)
    deltas, widths = _each(delta, columns), _each(bandwidth, columns)
    reach = [max(1, math.ceil(8 * h / d)) for h, d in zip(widths, deltas, strict=True)]
    text = lambda c: F.coalesce(F.to_json(c), F.lit(""))
    names, blocks = [f"_x{i}" for i in range(len(columns))], ["_g", *(f"_block{i}" for i in range(len(columns)))]
    large = bins.where(F.col("key").isNotNull() & (F.col("total") > LEAST_ROWS)).select(F.col("key").alias("_key")).distinct().withColumn("_large", F.lit(True))
    rows = df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, columns, strict=True)} | {"_key": key_of(parents)})
    rows = rows.join(large, "_key", "left").withColumn("_g", text(F.when(F.col("_large"), F.col("_key")))).drop("_large", "_key")
    ask = rows.where(_present(names)).select("_g", *names).distinct()
    cells = bins.select(text("key").alias("_g"), *((F.col("bin")[i] if len(columns) > 1 else F.col("bin")).alias(f"_b{i}") for i in range(len(columns))), "n", "total")
    for i, (r, d) in enumerate(zip(reach, deltas, strict=True)):
        ask = ask.withColumn(f"_c{i}", F.round(F.col(names[i]) / d).cast("long")).withColumn(f"_block{i}", F.floor(F.col(f"_c{i}") / (2 * r)))
        cells = cells.withColumn(f"_block{i}", F.explode(F.sequence(F.floor((F.col(f"_b{i}") - r) / (2 * r)), F.floor((F.col(f"_b{i}") + r) / (2 * r)))))
    pieces = ask.groupBy(*blocks).agg(F.ceil(F.count("*") / PIECE).alias("_pieces"))
    ask = ask.join(pieces, blocks).withColumn("_piece", F.pmod(F.xxhash64(*names), F.col("_pieces"))).drop("_pieces")
    cells = cells.join(pieces, blocks).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).drop("_pieces")
    cells = cells.toDF(*cells.columns)  # columns of its own
    schema = ", ".join(["_g string", *(f"{n} double" for n in names), "_density double"])
    found = ask.groupBy(*blocks, "_piece").cogroup(cells.groupBy(*blocks, "_piece")).applyInPandas(_met(names, widths, deltas, reach), schema)
    found = found.withColumnRenamed("_density", output)
    return rows.join(found, ["_g", *names], "left").drop(*names, "_g")


def ln_floor(density: Column) -> Column:
    return F.ln(F.greatest(F.coalesce(density, F.lit(0.0)), F.lit(FLOOR)))


def log_density(df: DataFrame, bins: DataFrame, column: str | list[str], parents: list[str], keys: list[str], bandwidth: Numbers, delta: Numbers) -> DataFrame:
    """(keys, log_density): ln of ``add_density``, at least ln(1e-10)."""
    found = add_density(df.select(*dict.fromkeys([*keys, *_list(column), *parents])), bins, column, parents, bandwidth, delta, "_density")
    return found.select(*keys, ln_floor(F.col("_density")).alias("log_density"))


@dataclass(frozen=True)
class NumericNode:
    """A numeric attribute with numeric and categorical parents: p(x | numeric, categorical) = p(x, numeric) / p(numeric).

    Both densities are of the same categorical group. ``joint`` and ``marginal`` are grids; widths and deltas stand in the order
    of the numeric parents, the attribute last.
    """

    name: str
    continuous: list[str]
    discrete: list[str]
    joint: DataFrame
    marginal: DataFrame | None
    widths: list[float]
    deltas: list[float]

    def add_score(self, df: DataFrame, output: str | None = None) -> DataFrame:
        """``df`` with ``score_<name>``: ln of the conditional density, at least ln(1e-10), also where a value is missing."""
        output = output or f"score_{self.name}"
        out = add_density(df, self.joint, [*self.continuous, self.name], self.discrete, self.widths, self.deltas, "_joint")
        if self.marginal is None:
            return out.withColumn(output, ln_floor(F.col("_joint"))).drop("_joint")
        out = add_density(out, self.marginal, self.continuous, self.discrete, self.widths[:-1], self.deltas[:-1], "_marginal")
        return out.withColumn(output, ln_floor(F.try_divide("_joint", "_marginal"))).drop("_joint", "_marginal")


def numeric_node(train: DataFrame, name: str, continuous: list[str], discrete: list[str], bandwidth: Numbers, delta: Numbers) -> NumericNode:
    """Learn the grids of an attribute; the marginal one is the joint one summed over the attribute."""
    columns = [*continuous, name]
    joint = checkpointed(grid(train, columns, discrete, delta))
    marginal = None
    if continuous:
        head = F.slice("bin", 1, len(continuous)) if len(continuous) > 1 else F.col("bin")[0]
        marginal = checkpointed(with_totals(joint.where("key IS NOT NULL").groupBy("key", head.alias("bin")).agg(F.sum("n").alias("n"))))
    return NumericNode(name, continuous, discrete, joint, marginal, _each(bandwidth, columns), _each(delta, columns))


def choose_bandwidth(train: DataFrame, column: str, delta: float, low: float = -1.0, high: float = 1.5, n: int = 20, folds: int = 2, keys: list[str] | None = None) -> DataFrame:
    """(bandwidth, loglik) of ``n`` log-spaced bandwidths by likelihood over folds (drawn by ``keys``, or all columns), best first.

    Folds and bandwidths share one grid of counts; a pair of bins meets once, and all bandwidths are summed together.
    """
    values = log_space(low, high, n)
    rows = train.where(F.col(column).isNotNull()).select(F.round(F.col(column) / delta).cast("long").alias("bin"), draw(folds, *map(F.col, keys or train.columns)).alias("fold"))
    bins = rows.groupBy("fold", "bin").agg(F.count("*").alias("n"))
    reach = math.ceil(8 * max(values) / delta)
    test = bins.select(F.col("fold").alias("f"), F.col("bin").alias("b"), F.col("n").alias("m"), F.explode(F.sequence(F.col("bin") - reach, F.col("bin") + reach)).alias("bin"))
    met = test.join(bins, "bin").where("fold <> f")
    size = bins.groupBy("fold").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("sizes"), F.sum("n").alias("all"))  # one entry a fold
    d2 = F.pow((F.col("b") - F.col("bin")) * F.lit(delta), F.lit(2))
    sums = met.groupBy("f", "b").agg(F.first("m").alias("m"), *(F.sum(F.col("n") * F.exp(-d2 / (2 * h * h))).alias(f"h{i}") for i, h in enumerate(values)))
    all_ = bins.select(F.col("fold").alias("f"), F.col("bin").alias("b"), F.col("n").alias("m")).join(sums.drop("m"), ["f", "b"], "left").join(F.broadcast(size))
    others = F.col("all") - F.element_at("sizes", F.col("f"))
    lik = [F.sum(F.col("m") * F.ln(F.greatest(F.coalesce(f"h{i}", F.lit(0.0)) / others / (h * NORMAL), F.lit(1e-10)))).alias(str(i)) for i, h in enumerate(values)]
    long = all_.agg(*lik).unpivot([], [str(i) for i in range(n)], "i", "loglik")
    return long.select(F.get(F.array(*map(F.lit, values)), F.col("i").cast("int")).alias("bandwidth"), "loglik").orderBy(F.desc("loglik"), "bandwidth")


def numeric_score(df: DataFrame, column: str, parents: list[str], keys: list[str], bandwidth: float, delta: float) -> DataFrame:
    """One row: sum of log-densities of the training rows under their own density, and the number of parent groups."""
    bins = grid(df, column, parents, delta)
    return log_density(df, bins, column, parents, keys, bandwidth, delta).agg(F.sum("log_density").alias("loglik")).join(bins.where("key IS NOT NULL").agg(F.count_distinct("key").alias("complexity")))


def complexity(numeric: int, categorical: int) -> int:
    """What a numeric node costs in a search, by its number of numeric columns (itself included) and categorical parents."""
    return categorical * COMPLEXITY[min(numeric, len(COMPLEXITY) - 1)]


def family_score(df: DataFrame, name: str, continuous: list[str], discrete: list[str], bandwidth: Numbers, delta: Numbers, weight: str | None = None) -> float:
    """Local score of a numeric node: ln of the conditional densities of its training rows, summed, less ``complexity``.

    ``df`` may be counts of rows, if ``weight`` names the count.
    """
    n = F.col(weight) if weight else F.lit(1)
    columns, rows = [*continuous, name], df.where(_present([*continuous, name]))
    places = _places(columns, delta)
    counts = rows.select(key_of(discrete).alias("key"), (F.array(*places) if len(columns) > 1 else places[0]).alias("bin"), n.alias("n")).groupBy("key", "bin").agg(F.sum("n").alias("n"))
    joint = checkpointed(with_totals(checkpointed(counts)))  # both are used several times
    marginal = None
    if continuous:
        head = F.slice("bin", 1, len(continuous)) if len(continuous) > 1 else F.col("bin")[0]
        marginal = checkpointed(with_totals(joint.where("key IS NOT NULL").groupBy("key", head.alias("bin")).agg(F.sum("n").alias("n"))))
    node = NumericNode(name, continuous, discrete, joint, marginal, _each(bandwidth, columns), _each(delta, columns))
    scored = node.add_score(rows.groupBy(*dict.fromkeys([*columns, *discrete])).agg(F.sum(n).alias("_n")), "_score")
    total = scored.agg(F.sum(F.col("_n") * F.col("_score"))).first()[0] or 0.0
    return total - complexity(len(columns), len(discrete))
