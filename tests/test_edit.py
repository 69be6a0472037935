"""Edit distances of many pairs at once against plain loops."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from caselake.functions import edit


def by_cells(a, b, ta=None, tb=None, free=False):
    """The table cell by cell."""
    most = max([*(ta or []), *(tb or [])], default=0) or 1
    d = {(i, 0): float(i) for i in range(len(a) + 1)} | {(0, j): float(j) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost = (abs(ta[i - 1] - tb[j - 1]) / most if ta else 0.0) if a[i - 1] == b[j - 1] else 1.0
            ways = [d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost]
            if free:
                k = max((x for x in range(1, i) if a[x - 1] == b[j - 1]), default=0)
                m = max((y for y in range(1, j) if b[y - 1] == a[i - 1]), default=0)
                if k and m:
                    ways.append(d[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
            elif i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                ways.append(d[i - 2, j - 2] + cost)
            d[i, j] = min(ways)
    return d[len(a), len(b)]


def pairs(n, longest, items, seed):
    rng = random.Random(seed)
    of = lambda: [rng.choice(items) for _ in range(rng.randint(0, longest))]
    found = [(of(), of()) for _ in range(n)]
    for a, _ in found[: n // 3]:  # near copies with swaps
        b = list(a)
        for _ in range(3):
            if len(b) > 1:
                i = rng.randrange(len(b) - 1)
                b[i], b[i + 1] = b[i + 1], b[i]
        found.append((a, b))
    return [a for a, _ in found], [b for _, b in found]


@pytest.mark.parametrize(("n", "longest", "items"), [(200, 8, "ab"), (150, 12, ["x", "y", 3, None]), (40, 90, "abcd"), (12, 200, "abcde"), (6, 64, "a")])
def test_distances_equal_the_table_cell_by_cell(n, longest, items):
    a, b = pairs(n, longest, items, longest)
    assert edit.osa_distances(a, b).tolist() == [by_cells(x, y) for x, y in zip(a, b, strict=True)]
    assert edit.damerau_distances(a, b).tolist() == [by_cells(x, y, free=True) for x, y in zip(a, b, strict=True)]
    rng = random.Random(n)
    s, t = ([[rng.choice([0, 1, 5, 60]) for _ in x] for x in side] for side in (a, b))
    want = [by_cells(*row) for row in zip(a, b, s, t, strict=True)]
    assert np.allclose(edit.timed_distances(a, b, s, t), want, atol=1e-9)


def test_known_distances():
    assert edit.osa_distances(["ab", "abc", "", "ca", ""], ["ba", "abc", "abc", "abc", ""]).tolist() == [1, 0, 3, 3, 0]
    assert edit.damerau_distances(["ca"], ["abc"]).tolist() == [2]
    assert edit.osa_distances([], []).tolist() == []
    # a swap of equal items with gaps costs the gap of its last pair
    assert edit.timed_distances(["aa"], ["aa"], [[0, 10]], [[10, 10]]).tolist() == [by_cells("aa", "aa", [0, 10], [10, 10])] == [0.0]


def test_many_pairs_are_fast():
    rng = random.Random(1)
    a, b = ([[rng.choice("abcdefgh") for _ in range(100)] for _ in range(400)] for _ in range(2))
    began = time.perf_counter()
    found = edit.osa_distances(a, b)
    fast = time.perf_counter() - began
    began = time.perf_counter()
    assert found[:10].tolist() == [by_cells(x, y) for x, y in zip(a[:10], b[:10], strict=True)]
    assert 40 * (time.perf_counter() - began) > 20 * fast


def test_columns_keep_nulls(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (None, ["a"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(edit.edit_similarity("a", "b")).collect()] == [0.5, None, 1.0, 0.0]
    assert [r[0] for r in df.select(edit.edit_distance("a", "b", free=True)).collect()] == [1.0, None, 0.0, 1.0]


def test_a_batch_of_many_rows_takes_no_more_memory_than_one_of_few():
    """Rows of a batch become objects a slice at a time; values, nulls and empty arrays are those of single rows."""
    rng = random.Random(3)
    rows = [None if i % 50 == 0 else [rng.choice("abcd") * 9 for _ in range(i % 60)] for i in range(2500)]

    def peak(times):
        a, b = pa.array(rows * times, pa.list_(pa.string())), pa.array(rows[::-1] * times, pa.list_(pa.string()))
        tracemalloc.start()
        out = edit._over_slices(edit.osa_distances, a, b)
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, out

    (few, out), (many, _) = peak(1), peak(4)
    assert many < 1.5 * few
    there = [i for i, (x, y) in enumerate(zip(rows, rows[::-1], strict=True)) if x is not None and y is not None]
    assert [i for i, v in enumerate(out.to_pylist()) if v is not None] == there
    assert [out[i].as_py() for i in there] == edit.osa_distances([rows[i] for i in there], [rows[::-1][i] for i in there]).tolist()
