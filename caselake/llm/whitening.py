"""Whitening of embeddings: exact sums, leading eigenpairs of the covariance by spectrum slicing, one pass to transform."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import small_batches

#: An entry c becomes floor(SCALE * c) + OFFSET, a long; beyond LARGEST it is held there.
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 1 << 61
COMPONENTS = 32
#: Components whose eigenvalue is not above this share of the largest are noise of rounding and left out.
NOISE = 1e-10
EPS = float(np.finfo(float).eps)


# -- spectrum slicing, over one matrix of dimensions squared -----------------------------------------------------------------


def positive_pivots(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, by Sylvester's law the positive ones of D in P A P' = L D L'.

    Pivots of one or two rows are chosen as Bunch and Kaufman do, so indefinite matrices are factored stably. A pair of rows is
    taken only where it has one eigenvalue of each sign.
    """
    a, k, positive, alpha = a.copy(), 0, 0, (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < len(a):
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        two = False
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most * most:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            c = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(a[k : k + 2, k : k + 2], c.T)
            positive += 1
            k += 2
        else:
            if a[k, k] != 0:
                c = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
                positive += a[k, k] > 0
            k += 1
    return int(positive)


class Slices:
    """Counts of eigenvalues above shifts of a matrix; what is counted is remembered in order."""

    def __init__(self, a: np.ndarray):
        self.a = a
        bound = float(np.abs(a).sum(axis=1).max(initial=0.0))
        self.unit = max(EPS * bound * len(a), np.finfo(float).tiny)  # what rounding may move an eigenvalue by
        self.shifts, self.counts = [-2 * bound - self.unit, 2 * bound + self.unit], [len(a), 0]

    def above(self, shift: float) -> int:
        i = bisect_left(self.shifts, shift)
        if i == len(self.shifts) or self.shifts[i] != shift:
            n = positive_pivots(self.a - shift * np.eye(len(self.a)))
            self.shifts.insert(i, shift)
            self.counts.insert(i, min(max(n, self.counts[i]), self.counts[i - 1]))
        return self.counts[i]

    def bracket(self, i: int) -> tuple[float, float, int, int]:
        """(low, high, n above low, n above high): the narrowest known slice with the ``i``-th largest eigenvalue, from 1."""
        at = next(j for j, n in enumerate(self.counts) if n < i)
        return self.shifts[at - 1], self.shifts[at], self.counts[at - 1], self.counts[at]

    def isolate(self, i: int) -> tuple[float, float, int, int]:
        """Halve the slice until it holds the ``i``-th alone, or is so narrow that rounding can't part what it holds."""
        while True:
            low, high, n, m = self.bracket(i)
            if n - m == 1 or high - low <= 4 * self.unit:
                return low, high, n, m
            self.above((low + high) / 2)


def _without(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - u * (u @ v)
    return v / np.linalg.norm(v)


def _solve(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    try:
        return np.linalg.solve(a - shift * np.eye(len(a)), v)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), v)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``k`` largest eigenvalues of a symmetric matrix, falling.

    Inertia counts isolate each; Rayleigh quotients then converge cubically inside its slice. Where they leave it, the slice
    is halved and they start again. At last counts on both sides of the value found certify its number. Values that rounding
    can't tell apart get an orthonormal basis of their common space.
    """
    slices, rng = Slices(a), np.random.default_rng(0)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < min(k, len(a)):
        i = len(values) + 1
        low, high, n, m = slices.isolate(i)
        if n - m > 1:
            shift = (low + high) / 2
            for _ in range(min(n, k) - len(values)):
                v = _without(rng.normal(size=len(a)), vectors)
                for _ in range(4):
                    v = _without(_solve(a, shift, v, slices.unit), vectors)
                vectors.append(v)
                values.append(float(v @ a @ v))
            continue
        v = _without(rng.normal(size=len(a)), vectors)
        shift = (low + high) / 2
        for _ in range(2):
            v = _without(_solve(a, shift, v, slices.unit), vectors)
        for _ in range(30):
            shift = float(v @ a @ v)
            if not low < shift <= high or np.linalg.norm(a @ v - shift * v) <= slices.unit / len(a) ** 0.5:
                break
            v = _without(_solve(a, shift, v, slices.unit), vectors)
        shift = float(v @ a @ v)
        certain = low < shift <= high and slices.above(shift - slices.unit) >= i > slices.above(shift + slices.unit)
        if certain and np.linalg.norm(a @ v - shift * v) <= 64 * slices.unit or high - low <= 4 * slices.unit:
            vectors.append(v)
            values.append(shift)
        else:
            slices.above((low + high) / 2)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(-1, len(a))[order].T


# -- sums over the table -----------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit learns: n vectors, exact sums, and for each component its direction, eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        self.centre = [round(Fraction(s, self.n)) for s in self.sums] if self.n else []
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.centre, strict=True)]  # of n times the distance to the mean

    def whiten(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.centre, np.int64)).astype(float) - np.array([float(Fraction(r, self.n)) for r in self.rest])
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; null beyond a long."""
        z = x - np.array(self.centre, np.int64)
        if len(self.sums) * (self.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 < 1 << 63:
            y = self.n * z - np.array(self.rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in z.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """Rows of d longs."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def remaining(rows: DataFrame, vector_column: str) -> tuple[DataFrame, int]:
    """Rows whose vector has finite entries only, of the most frequent length (the longest such); and that length, 0 if none."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    most = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size(v) == (most["d"] if most else 0)), most["d"] if most else 0


def summed(rows: DataFrame, vector_column: str, f) -> dict[tuple[int, int], list]:
    """(i, j) -> sums of numbers that ``f`` yields for blocks of vectors: f(vectors) -> [matrix of each number].

    Each task adds up its blocks and sends one row for each place of the matrices; these are summed by a shuffle. So what the
    driver gets is as large as the matrices, whatever the rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                each = f(batch.column(0))
                total = each if total is None else [t + e for t, e in zip(total, each, strict=True)]
        if total is not None:
            i, j = np.indices(total[0].shape)
            numbers = [pa.array(t.ravel()) for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int64()), pa.array(j.ravel(), pa.int64()), *numbers], ["i", "j", *(f"s{k}" for k in range(len(numbers)))])

    kinds = f(None)
    schema = "i long, j long, " + ", ".join(f"s{k} {kind}" for k, kind in enumerate(kinds))
    sums = rows.select(vector_column).mapInArrow(partial, schema).groupBy("i", "j").agg(*(F.sum(f"s{k}") for k in range(len(kinds))))
    return {(r[0], r[1]): list(r[2:]) for r in sums.collect()}


def matrix(sums: dict[tuple[int, int], list], k: int, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for (i, j), s in sums.items():
        out[i, j] = s[k]
    return out


def fit(rows: DataFrame, d: int, vector_column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Three passes over vectors of d finite entries: sums, covariance, and the covariance of what was whitened.

    The first sums are exact (high and low halves apart). The second are of products of distances to the mean, rounded to
    whole numbers; what rounding left is put right exactly, so nothing cancels.
    """
    small_batches(rows.sparkSession)

    def first(v):
        if v is None:
            return "long", "long", "long"
        x = integers(v, d)
        return (x >> 32).sum(axis=0)[None], (x & (1 << 32) - 1).sum(axis=0)[None], np.full((1, d), len(x))

    s = summed(rows, vector_column, first)
    if not s:
        return Whitening(0, [], np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    n, totals = s[0, 0][2], [(s[0, i][0] << 32) + s[0, i][1] for i in range(d)]
    model = Whitening(n, totals, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    centre = np.array(model.centre, np.int64)

    def second(v):
        if v is None:
            return ("double",)
        z = (integers(v, d) - centre).astype(float)
        return (z.T @ z,)

    rest = np.array([float(Fraction(r, n)) for r in model.rest])
    v = matrix(summed(rows, vector_column, second), 0, (d, d)) / n - np.outer(rest, rest)
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    values, vectors = leading(v, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    real = int(np.count_nonzero(values > NOISE * values.max(initial=0.0)))
    model.values, model.vectors = values[:real], vectors[:, :real]
    model.explained = model.values / trace if trace > 0 else model.values
    if real:

        def third(v):
            if v is None:
                return "double", "double"
            y = model.whiten(integers(v, d))
            return y.T @ y, np.repeat(y.sum(axis=0)[None], real, axis=0)

        s = summed(rows, vector_column, third)
        mean = matrix(s, 1, (real, real))[0] / n
        model.identity_error = float(np.abs(matrix(s, 0, (real, real)) / n - np.outer(mean, mean) - np.eye(real)).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each row and component, from 1."""
    small_batches(rows.sparkSession)
    d, k = model.vectors.shape

    @F.arrow_udf("deviation long, whitened array<double>")
    def whitened(vectors: pa.Array) -> pa.Array:
        x = integers(vectors, d)
        y = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(model.whiten(x).ravel()))
        return pa.StructArray.from_arrays([pa.array(model.deviations(x), pa.int64()), y], ["deviation", "whitened"])

    found = rows.select(F.col(id_column), whitened(F.col(vector_column)).alias("_w"))
    each = found.select(F.col(id_column), F.col("_w.deviation").alias("deviation"), F.posexplode("_w.whitened").alias("_i", "whitened"))
    share = F.get(F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>"), F.col("_i"))
    return each.select(id_column, (F.col("_i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all vectors and transform them: see ``fit`` and ``transform``.

    Vectors that are null or empty or hold null or non-finite entries take no part, nor do those of another length than most.
    Null and repeated ids are values like others; repeated rows count and come back each. Columns beside the two are not
    looked at. Where all vectors are equal, or there are none, there are no components and so no rows.
    """
    good, d = remaining(rows.select(id_column, vector_column), vector_column)
    return transform(good, fit(good, d, vector_column, components), id_column, vector_column)
