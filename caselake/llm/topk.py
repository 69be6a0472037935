"""Exact top-k by inner product with no random access: sorted lists read in step, with bounds on every score.

Each dimension of a block of candidates is a list sorted by value. A query reads its lists in step, deeper and deeper, from the
end that suits the sign of its component. All that it knows of a candidate is what has been read of it, which bounds its score
from both sides: an unread part is at most what its list has come to, and at least the last of its list. When the k-th best
lower bound is above the upper bounds of all others, these cannot qualify. The lists are then read on for those left, until
nothing of them is unread and their scores are known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_OF_BLOCK = 8192
QUERIES_OF_BLOCK = 8192
#: A block has so many candidates at least, where cores would be idle otherwise.
LEAST_OF_BLOCK = 512
#: Queries whose bounds are kept at once.
QUERIES_AT_ONCE = 256
#: Shares of the lists read before bounds are compared.
DEPTHS = (0.25, 0.5, 0.7, 0.85, 0.95, 1.0)
SCALE = 1024
#: Sums of whole numbers below this are exact in floating point.
EXACT = 1 << 53


class SortedLists:
    """The lists of a block, and what has been read of each candidate at each depth, from either end.

    ``read`` counts the entries that queries have read, to be compared with reading all.
    """

    def __init__(self, vectors: np.ndarray):
        n = self.n = len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.first, self.last = self.values[0], self.values[-1]
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        self.depths = sorted({max(1, min(n, round(n * d))) for d in DEPTHS})
        self.seen = []  # at each depth: read from the top, its values; read from the bottom, its values
        for depth in self.depths:
            top, bottom = place >= n - depth, place < depth
            self.seen.append((top, np.where(top, vectors, 0), bottom, np.where(bottom, vectors, 0)))
        self.read = 0

    def bounds(self, level: int, queries: np.ndarray, rows=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (candidate, query) after reading to a depth, for all candidates or some of them."""
        depth = self.depths[level]
        top, top_values, bottom, bottom_values = (x[rows] for x in self.seen[level])
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T  # (dimension, query)
        known = top_values @ up + bottom_values @ down
        if depth == self.n:
            return known, known
        high, low = self.values[self.n - depth][:, None], self.values[depth - 1][:, None]
        best_up, best_down, least_up, least_down = high * up, low * down, self.first[:, None] * up, self.last[:, None] * down
        of = top.astype(queries.dtype), bottom.astype(queries.dtype)
        upper = known + (best_up + best_down).sum(0) - of[0] @ best_up - of[1] @ best_down
        lower = known + (least_up + least_down).sum(0) - of[0] @ least_up - of[1] @ least_down
        return lower, upper

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) for each query: all candidates that may be among its k best (ties included), with their scores."""
        found: list = [None] * len(queries)
        open_ = np.arange(len(queries))
        last = len(self.depths) - 1
        for level in range(last + 1):
            lower, upper = self.bounds(level, queries[open_])
            self.read += len(open_) * queries.shape[1] * (self.depths[level] - (self.depths[level - 1] if level else 0))
            least = np.partition(lower, self.n - k, axis=0)[self.n - k] if self.n > k else lower.min(0)
            left = upper >= least
            done = (left.sum(0) <= 4 * k) if level < last else np.ones(len(open_), bool)
            for j in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(left[:, j])
                query = queries[open_[j]][None]
                for deeper in range(level + 1, last + 1):  # read on for those left, until their scores are known
                    low, up = self.bounds(deeper, query, rows)
                    cut = np.partition(low[:, 0], len(rows) - k)[len(rows) - k] if len(rows) > k else low.min()
                    rows = rows[up[:, 0] >= cut]
                found[open_[j]] = rows, self.bounds(last, query, rows)[0][:, 0]
            open_ = open_[~done]
            if not len(open_):
                break
        return found


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, query_keys: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each query, rows of its own id left out; ties to the smaller id."""
    sizes = [int(np.abs(x).max(initial=0)) for x in (queries, vectors)]
    number = np.float64 if queries.shape[1] * sizes[0] * sizes[1] < EXACT else object  # Python's integers are slow but exact
    lists = SortedLists(vectors.astype(number))
    own = pd.Series(np.arange(len(ids))).groupby(ids).indices
    most = max((len(x) for x in own.values()), default=0)
    found = []
    for i in range(0, len(queries), QUERIES_AT_ONCE):
        part = slice(i, i + QUERIES_AT_ONCE)
        for (rows, scores), q, key in zip(lists.search(queries[part].astype(number), k + most), query_ids[part], query_keys[part], strict=True):  # its own rows may be among them
            other = ids[rows] != q
            rows, scores = rows[other], scores[other]
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append(pd.DataFrame({"query_id": q, "query_key": key, "vec_id": ids[rows[best]], "score": scores[best].astype(np.int64)}))
    return pd.concat(found) if found else NOTHING


NOTHING = pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component as long; vectors null, empty or holding null, NaN or infinity are left out."""
    x = F.col(vector_column)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.cast("array<double>").alias("x")).where("vec_id is not null and size(x) > 0")
    return whole.where(~F.exists("x", bad)).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def search(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k best scores for each query row among all rows but those of its own id: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on ``vec_id``. Rows are dealt into blocks of candidates by hash, and queries into blocks that
    meet each of them, so a task holds two bounded blocks. Rows that repeat an id and vector count once; different vectors of
    one id are rows of their own, as candidates and as queries (which then rank apart). A query meets vectors of its own
    length only. Fewer than k candidates: all of them. Null ids take no part. An empty table gives no rows. Scores must fit
    64 bits. Other columns are not read.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id"))
    n, m = ids.agg(F.count("*"), F.count_if(is_query)).first()  # reads the ids only
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-n // CANDIDATES_OF_BLOCK), min(2 * cores, -(-n // LEAST_OF_BLOCK)), 1)
    query_blocks = -(-m // QUERIES_OF_BLOCK) or 1
    rows = quantised(vectors, id_column, vector_column).dropDuplicates(["vec_id", "v"]).withColumn("dims", F.size("v"))
    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    asked = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(query_blocks)).cast("int")
    together = ["block", "query_block", "dims"]
    tasks = max(1, min(blocks * query_blocks, 20_000))
    candidates = rows.withColumn("block", dealt).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where(is_query).withColumn("query_key", F.xxhash64("v")).withColumn("query_block", asked).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def of_blocks(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return NOTHING
        q, c = np.array(asked["v"].tolist(), np.int64), np.array(held["v"].tolist(), np.int64)
        return best_of_block(q, asked["vec_id"].to_numpy(), asked["query_key"].to_numpy(), c, held["vec_id"].to_numpy(), k)

    left, right = (x.repartition(tasks, *together).groupBy(*together) for x in (queries, candidates))
    best = left.cogroup(right).applyInPandas(of_blocks, "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
