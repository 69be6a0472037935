"""Sufficient statistics of a log that grows by batches: counts by sets of columns, rolled up from each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.operators import density
from caselake.operators.stats import counts_by_sets
from caselake.plans.log import as_category
from caselake.plans.order import folder, written

#: A node and its parents, sorted.
Family = tuple[str, tuple[str, ...]]
TABLE = "of string, cells array<string>, n long"


def family(node: str, parents: Iterable[str]) -> Family:
    return node, tuple(sorted(parents))


def columns_of(f: Family) -> tuple[str, ...]:
    return tuple(sorted({f[0], *f[1]}))


def likelihoods(counts: DataFrame, families: list[Family]) -> DataFrame:
    """(node, parents, loglik, tuples) from counts (of, cells, n), where ``of`` is the comma-joined sorted set of columns.

    loglik is the sum of n ln(n / n_parents), tuples the number of parent tuples; ``parents`` is a comma-joined sorted list.
    """
    wanted = [(",".join(columns_of(f)), f[0], ",".join(f[1]), [columns_of(f).index(c) for c in f[1]]) for f in dict.fromkeys(families)]
    table = counts.sparkSession.createDataFrame(wanted, "of string, node string, parents string, at array<int>")  # one row a family
    rows = counts.join(F.broadcast(table), "of").select("node", "parents", F.transform("at", lambda i: F.get("cells", i)).alias("key"), "n")
    given = rows.groupBy("node", "parents", "key").agg(F.sum(F.col("n") * F.ln("n")).alias("s"), F.sum("n").alias("m"))
    return given.groupBy("node", "parents").agg((F.sum("s") - F.sum(F.col("m") * F.ln("m"))).alias("loglik"), F.count("*").alias("tuples"))


def named_counts(df: DataFrame, sets: list[tuple[str, ...]], weight: str | None = None) -> DataFrame:
    """``counts_by_sets`` with sets by name."""
    names = F.array(*(F.lit(",".join(s)) for s in sets))
    return counts_by_sets(df, sets, weight).select(F.get(names, "of").alias("of"), "cells", "n")


class CountStore:
    """Counts of rows by sets of columns, batch by batch.

    A batch is counted once by all columns; these counts are kept as a Parquet dataset. Counts by smaller sets are one table:
    a batch adds its own to them, so it costs its own rows and the size of the table, whatever the history. A set that is asked
    for the first time is rolled up from the smallest set known that holds it, and from the dataset only if there is none.
    Numeric columns, given with a bandwidth and a cell width, are kept as numbers of cells.
    """

    def __init__(self, spark: SparkSession, categorical: Iterable[str], numeric: dict[str, tuple[float, float]] | None = None):
        self.spark, self.numeric = spark, dict(numeric or {})
        self.columns = sorted({*categorical} - {*self.numeric})
        self.at, self.batches, self.sets = f"{folder(spark, 'counts')}/rows", 0, set()
        self.table = spark.createDataFrame([], TABLE)

    @property
    def rows(self) -> DataFrame:
        """Counts by all columns, one row for each batch that has them."""
        return self.spark.read.parquet(self.at)

    def add(self, df: DataFrame) -> None:
        cells = {c: F.round(F.col(c).cast("double") / d).cast("long") for c, (_, d) in self.numeric.items()}
        part = df.groupBy(*(as_category(c).alias(c) for c in self.columns), *(e.alias(c) for c, e in cells.items())).agg(F.count("*").alias("_rows"))
        part.write.parquet(f"{self.at}/batch={self.batches}")
        new = self.spark.read.parquet(f"{self.at}/batch={self.batches}")
        self.batches += 1
        if self.sets:
            self._merge(self.table.unionByName(named_counts(new, sorted(self.sets), "_rows")))

    def _merge(self, rows: DataFrame) -> None:
        self.table = written(rows.groupBy("of", "cells").agg(F.sum("n").alias("n")))

    def ensure(self, sets: Iterable[tuple[str, ...]]) -> None:
        """Compute the sets that are not there yet."""
        missing = sorted(set(sets) - self.sets, key=lambda s: (-len(s), s))
        holds = lambda known: [s for s in missing if s not in self.sets and any(set(s) <= set(k) for k in known)]
        widest = [s for s in missing if not any(set(s) < set(k) for k in missing) and s not in holds(self.sets)]
        if widest:
            self._merge(self.table.unionByName(named_counts(self.rows, widest, "_rows")))
            self.sets |= set(widest)
        rolled = holds(self.sets)
        if rolled:
            source = {s: min((k for k in self.sets if set(s) <= set(k)), key=lambda k: (len(k), k)) for s in rolled}
            plan = [(",".join(source[s]), ",".join(s), [source[s].index(c) for c in s]) for s in rolled]
            wanted = self.spark.createDataFrame(plan, "of string, target string, at array<int>")  # one row a set
            rows = self.table.join(F.broadcast(wanted), "of").select(F.col("target").alias("of"), F.transform("at", lambda i: F.get("cells", i)).alias("cells"), "n")
            self._merge(self.table.unionByName(rows))
            self.sets |= set(rolled)

    def counts(self, columns: Iterable[str]) -> DataFrame:
        """(columns, _rows): the counts by a set of columns; numeric ones as the middles of their cells."""
        key = tuple(sorted(set(columns)))
        self.ensure([key])
        value = lambda c, i: F.col("cells")[i].cast("double") * self.numeric[c][1] if c in self.numeric else F.col("cells")[i]
        return self.table.where(F.col("of") == ",".join(key)).select(*(value(c, i).alias(c) for i, c in enumerate(key)), F.col("n").alias("_rows"))

    def scores(self, families: Iterable[Family]) -> dict[Family, float]:
        """Local scores: log-likelihood less parent tuples; of numeric nodes see ``density.family_score``."""
        families = list(dict.fromkeys(families))
        self.ensure(map(columns_of, families))
        categorical = [f for f in families if f[0] not in self.numeric]
        out = {family(r["node"], filter(None, r["parents"].split(","))): r["loglik"] - r["tuples"] for r in likelihoods(self.table, categorical).collect()} if categorical else {}
        numeric = [f for f in families if f[0] in self.numeric]
        if numeric:
            with ThreadPoolExecutor(min(8, len(numeric))) as pool:  # each is a small job of its own
                out |= dict(zip(numeric, pool.map(self._numeric_score, numeric), strict=True))
        return out

    def _numeric_score(self, f: Family) -> float:
        node, parents = f
        continuous, discrete = [p for p in parents if p in self.numeric], [p for p in parents if p not in self.numeric]
        widths, deltas = zip(*(self.numeric[c] for c in (*continuous, node)), strict=True)
        return density.family_score(self.counts(columns_of(f)), node, continuous, discrete, list(widths), list(deltas), "_rows")


def search(score: Callable[[list[Family]], dict[Family, float]], allowed: list[tuple[str, str]], cyclic: Callable[[dict[str, set[str]], str, str], bool], start: Iterable[tuple[str, str]] = (), fixed: Iterable[tuple[str, str]] = (), most: int | None = None, gain: float = 1e-10) -> list[tuple[str, str]]:
    """Greedy search: in each round the addition or removal of an edge with the largest gain, until none is above ``gain``.

    ``fixed`` edges always stay; ``most`` limits the rounds, if given. Each round raises the score, so the search ends. Scores
    are asked for once a family; so after the first round only those of the changed node are new.
    """
    fixed = set(fixed)
    edges, memo, rounds = {*start, *fixed}, {}, 0
    of = lambda node: {a for a, b in edges if b == node}
    while most is None or rounds < most:
        parents = {b: of(b) for _, b in (*allowed, *edges)}
        moves = [(a, b) for a, b in allowed if (a, b) in edges and (a, b) not in fixed or (a, b) not in edges and not cyclic(parents, a, b)]
        asked = {family(b, of(b)) for _, b in moves} | {family(b, of(b) ^ {a}) for a, b in moves}
        memo |= score(sorted(asked - memo.keys())) if asked - memo.keys() else {}
        gains = [(round(memo[family(b, of(b) ^ {a})] - memo[family(b, of(b))], 6), a, b) for a, b in moves]
        best = max(gains, default=(0.0, "", ""))  # both directions of an edge often gain the same, but for rounding
        if best[0] <= gain:
            break
        edges ^= {best[1:]}
        rounds += 1
    return sorted(edges)
