"""Edit distances of many pairs of sequences at once, in numpy: bit vectors, and rows of the dynamic programme as vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a table of comparisons that are worked on at once.
CELLS = 1 << 22
#: Items of sequences that are held as objects at once.
ITEMS = 1 << 16
#: Columns of tables of short rows that are worked on at once, so that they stay in a core's cache; pairs of which bounds are asked at once.
TABLES, PAIRS = 1 << 19, 1 << 18
#: Items are counted by this many codes; equal rows that go together at most.
BUCKETS, RUN = 16, 64
WORD = 64


def _coded(a: Sequence, b: Sequence) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Items as small numbers, the same for equal items."""
    number: dict = {}
    of = lambda x: np.fromiter((number.setdefault(v, len(number)) for v in x), np.int32, len(x))
    return [of(x) for x in a], [of(x) for x in b]


def _padded(rows: list[np.ndarray], fill: float, dtype=np.int32) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), fill, dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _in_blocks(a: list[np.ndarray], b: list[np.ndarray], distance: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``distance`` of pairs (given by their places) in blocks of similar lengths that stay below ``CELLS``."""
    m, n = (np.array([len(x) for x in s]) for s in (a, b))
    out, order = np.zeros(len(a)), np.lexsort((n, m))
    at = 0
    while at < len(order):
        size, rows, columns = 0, 0, 0
        while at + size < len(order):
            i = order[at + size]
            rows, columns = max(rows, m[i] + 1), max(columns, n[i] + 1)
            if size and rows * columns * (size + 1) > CELLS:
                break
            size += 1
        block = order[at : at + size]
        out[block] = distance(block)
        at += size
    return out


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(place in b, word, pair): bits of the places of a that equal each place of b."""
    words = -(-a.shape[1] // WORD)
    out = np.zeros((b.shape[1], words, len(a)), np.uint64)
    for w in range(words):
        part = a[:, w * WORD : (w + 1) * WORD]
        equal = np.zeros((len(a), b.shape[1], WORD), bool)
        equal[:, :, : part.shape[1]] = part[:, None, :] == b[:, :, None]
        out[:, w] = np.packbits(equal, axis=2, bitorder="little").view("<u8")[:, :, 0].T
    return out


def _osa_block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Optimal string alignment by Hyyrö's bit vectors: a column of the table a step, in words of 64 rows, all pairs at once."""
    if not a.shape[1] or not b.shape[1]:
        return np.maximum(la, lb).astype(float)
    match, (pairs, one, top) = _matches(a, b), (len(a), np.uint64(1), np.uint64(WORD - 1))
    words = match.shape[1]
    vp, vn, d0 = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64), np.zeros((words, pairs), np.uint64)
    last_word, last_bit = np.maximum(la - 1, 0) // WORD, (np.maximum(la - 1, 0) % WORD).astype(np.uint64)
    each, distance = np.arange(pairs), la.astype(np.int64)
    for j in range(b.shape[1]):
        carry, swap_in, hp_in, hn_in = np.zeros(pairs, np.uint64), np.zeros(pairs, np.uint64), np.ones(pairs, np.uint64), np.zeros(pairs, np.uint64)
        step = np.zeros((words, pairs), np.int8)
        for w in range(words):
            pm = match[j, w]
            swap = ~d0[w] & pm
            swapped = ((swap << one) | swap_in) & match[j - 1, w] if j else np.zeros(pairs, np.uint64)
            swap_in = swap >> top
            x = pm & vp[w]
            s = x + vp[w]
            total = s + carry
            carry = ((s < x) | (total < s)).astype(np.uint64)
            d = swapped | (total ^ vp[w]) | pm | vn[w]
            hp, hn = vn[w] | ~(d | vp[w]), d & vp[w]
            step[w] = (hp >> last_bit & one).astype(np.int8) - (hn >> last_bit & one).astype(np.int8)
            hp, hp_in = (hp << one) | hp_in, hp >> top
            hn, hn_in = (hn << one) | hn_in, hn >> top
            vp[w], vn[w], d0[w] = hn | ~(d | hp), hp & d, d
        distance += np.where(j < lb, step[last_word, each], 0)
    return np.where(la == 0, lb, distance).astype(float)


def osa_distances(a: Sequence, b: Sequence) -> np.ndarray:
    """Distances with insertions, deletions, substitutions and swaps of neighbours, each place edited once."""
    x, y = _coded(a, b)
    short = [(p, q) if len(p) <= len(q) else (q, p) for p, q in zip(x, y, strict=True)]  # fewer words; the distance is symmetric
    x, y = [p for p, _ in short], [q for _, q in short]
    length = lambda rows, block: np.array([len(rows[i]) for i in block])
    return _in_blocks(x, y, lambda k: _osa_block(_padded([x[i] for i in k], -1), length(x, k), _padded([y[i] for i in k], -2), length(y, k)))


def _rows_block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, ta: np.ndarray | None, tb: np.ndarray | None, free: bool) -> np.ndarray:
    """The dynamic programme row by row, all pairs at once; what comes from the left in a row is a running minimum.

    With times, keeping equal items costs their gap, and a swap what its last pair costs. ``free`` lets swapped items have
    others between them (Damerau), else only neighbours swap.
    """
    pairs, n = b.shape
    place = np.arange(n + 1, dtype=float)
    table = np.empty((a.shape[1] + 1, pairs, n + 1))
    table[0] = place
    each, columns = np.arange(pairs)[:, None], np.arange(1, n + 1)[None, :]
    seen = np.zeros((pairs, n), np.int64)  # the last row before this one whose item equals each item of b
    for i in range(1, a.shape[1] + 1):
        item = a[:, i - 1 : i]
        equal = item == b
        cost = np.where(equal, 0.0 if ta is None else np.abs(ta[:, i - 1 : i] - tb), 1.0)
        best = np.minimum(table[i - 1][:, 1:] + 1, table[i - 1][:, :-1] + cost)
        if free:
            before = np.maximum.accumulate(np.where(equal, columns, 0), axis=1)
            left = np.concatenate([np.zeros((pairs, 1), np.int64), before[:, :-1]], axis=1)  # the last column with the item of this row
            k = np.maximum(seen, 1)
            swap = table[k - 1, each, np.maximum(left, 1) - 1] + (i - seen - 1) + 1 + (columns - left - 1)
            best = np.minimum(best, np.where((seen > 0) & (left > 0), swap, np.inf))
            seen = np.where(equal, i, seen)
        elif i > 1 and n > 1:
            swap = np.where((item == b[:, :-1]) & (a[:, i - 2 : i - 1] == b[:, 1:]), table[i - 2][:, :-2] + cost[:, 1:], np.inf)
            best[:, 1:] = np.minimum(best[:, 1:], swap)
        row = np.concatenate([np.full((pairs, 1), float(i)), best], axis=1)
        table[i] = np.minimum.accumulate(row - place, axis=1) + place
    return table[la, np.arange(pairs), lb]


def _by_rows(a: Sequence, b: Sequence, ta: Sequence | None = None, tb: Sequence | None = None, free: bool = False) -> np.ndarray:
    x, y = _coded(a, b)

    def distance(k: np.ndarray) -> np.ndarray:
        pick = lambda rows, fill, dtype: _padded([np.asarray(rows[i], dtype) for i in k], fill, dtype)
        length = lambda rows: np.array([len(rows[i]) for i in k])
        times = (None, None) if ta is None else (pick(ta, 0, float), pick(tb, 0, float))
        return _rows_block(pick(x, -1, np.int32), length(x), pick(y, -2, np.int32), length(y), *times, free)

    return _in_blocks(x, y, distance)


def damerau_distances(a: Sequence, b: Sequence) -> np.ndarray:
    """Distances with insertions, deletions, substitutions and swaps, also of items between which others were added or lost."""
    return _by_rows(a, b, free=True)


def _damerau_cells(a: np.ndarray, b: np.ndarray, lb: np.ndarray, radius: int) -> np.ndarray:
    """``_rows_block`` with free swaps for very many pairs of short rows, (place, pair): a cell of the table a step, all pairs at once.

    All rows of a are of one length, those of b of rising ones. Of swaps only those with neighbours on one side are asked for, as
    others cost no less than to replace: these start at the last row whose item is that of the column, or at the last column whose
    item is that of the row, and to start at earlier ones costs no less. So their costs go on from cell to cell, by one a step.
    Distances over ``radius`` are not exact, but over it; cells further than this from the diagonal are left out.
    """
    (m, pairs), n = a.shape, len(b)
    kind = np.uint8 if m + n <= 100 else np.uint16
    far, one = kind(1 << (7 if kind == np.uint8 else 15)), kind(1)
    start = np.searchsorted(lb, np.arange(n + 2))  # rows of b before it are shorter
    table, down = np.empty((3, n + 2, pairs), kind), np.full((n + 1, pairs), far)
    unlike = np.full((n + 1, pairs), np.iinfo(kind).max, kind)  # all bits where the items of the last row and of a column differ
    across, differ, other, out = np.empty(pairs, kind), np.empty(pairs, kind), np.empty(pairs, kind), np.full(pairs, far)
    for j in range(n + 2):
        table[0, j] = j if j <= radius else far
    for i in range(1, m + 1):
        low, high = max(1, i - radius), min(n, i + radius)
        now, up, upper = table[i % 3], table[(i - 1) % 3], table[(i - 2) % 3]
        now[low - 1] = i if low == 1 and i <= radius else far
        now[high + 1] = far
        across.fill(far)
        for j in range(low, high + 1):
            s = slice(start[j], None)
            x, d, best = other[s], differ[s], now[j, s]
            np.not_equal(a[i - 1, s], b[j - 1, s], out=d.view(bool) if kind == np.uint8 else d, casting="unsafe")
            np.minimum(up[j, s], now[j - 1, s], out=x)
            x += one
            np.add(up[j - 1, s], d, out=best)
            np.minimum(best, x, out=best)
            np.negative(d, out=d)
            if i > 1:
                swap = across[s]
                np.bitwise_or(swap, unlike[j, s], out=x)
                np.minimum(best, x, out=best)
                np.bitwise_or(upper[j - 1, s], d, out=x)
                np.minimum(swap, x, out=swap)
                swap += one
            if j > 1:
                swap = down[j, s]
                if j > low:
                    np.bitwise_or(swap, unlike[j - 1, s], out=x)
                    np.minimum(best, x, out=best)
                np.bitwise_or(up[j - 2, s], d, out=x)
                np.minimum(swap, x, out=swap)
                swap += one
            unlike[j, s] = d
    for j in range(max(0, m - radius), min(n, m + radius) + 1):
        s = slice(start[j], start[j + 1])
        out[s] = table[m % 3, j, s]
    return out


def _rows(a: pa.ListArray, b: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lengths and padded codes of the rows of both, codes being the same for equal items."""
    items = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode(null_encoding="encode")
    kind = np.uint8 if len(items.dictionary) < 255 else np.int32
    codes, at = items.indices.to_numpy(zero_copy_only=False).astype(kind), 0
    for side in (a, b):
        length = side.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(side), length.max(initial=0)), kind)
        out[np.arange(out.shape[1]) < length[:, None]] = codes[at : at + length.sum()]
        at += length.sum()
        yield length, out


def _cells_of(width: int) -> int:
    """Pairs whose tables of so many columns are held at once."""
    return max(1 << 12, TABLES // (width + 1))


def damerau_between(a: pa.ListArray, b: pa.ListArray, i: np.ndarray, j: np.ndarray, radius: float = np.inf) -> np.ndarray:
    """``damerau_distances`` of the rows ``i`` of a and ``j`` of b; each row is coded once, however many pairs it is in.
    Distances over ``radius`` are not exact, but over it."""
    (m, x), (n, y) = _rows(a, b)
    order = np.lexsort((n[j], m[i]))
    out, at = np.zeros(len(i)), 0
    while at < len(order):
        longest = m[i[order[at]]]
        end = at + np.searchsorted(m[i[order[at:]]], longest, "right")  # one length of a at a time
        width = n[j[order[end - 1]]]
        k = order[at : min(end, at + _cells_of(width))]
        out[k] = _one_length(x[i[k], :longest], y[j[k], :width], n[j[k]], radius)
        at += len(k)
    return out


def _one_length(x: np.ndarray, y: np.ndarray, n: np.ndarray, radius: float) -> np.ndarray:
    """Distances of pairs of rows; those of x are of one length, those of y of the rising lengths ``n``."""
    (pairs, m), width = x.shape, y.shape[1]
    if m + width > np.iinfo(np.int16).max - 2:
        ends = np.where(np.arange(width) < n[:, None], y.astype(np.int32), -1)
        return _rows_block(x.astype(np.int32), np.full(pairs, m), ends, n, None, None, True)
    return _damerau_cells(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), n, int(min(radius, m + width)))


def _runs(codes: np.ndarray, length: np.ndarray, buckets: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by length and counts of items by bucket of their codes; first row and number of rows of each run, which are of
    one length and the same counts; (bucket, run): these."""
    there = np.arange(codes.shape[1]) < length[:, None]
    bags = np.array([((codes % buckets == k) & there).sum(axis=1) for k in range(buckets)], kind).reshape(buckets, len(codes))
    order = np.lexsort((*bags, length))
    bags, length = bags[:, order], length[order]
    new = np.arange(len(order)) % RUN == 0
    new[1:] |= (np.diff(length) != 0) | (bags[:, 1:] != bags[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return order, first, np.diff(first, append=len(order)), bags[:, first]


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as it says, and the count from 0 inside each."""
    place = np.repeat(np.arange(len(n)), n)
    return place, np.arange(len(place)) - (np.cumsum(n) - n)[place]


def damerau_near(a: pa.ListArray, b: pa.ListArray, radius: float, to_a: np.ndarray, to_b: np.ndarray, compare: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, distance) of all pairs that no bound keeps further apart than ``radius``: lengths, counts of items, and
    distances of both to others, (row, other). Distances over the radius are not exact, but over it; 0 if not asked to compare.

    Rows of one length and the same counts go together until their distances to others tell them apart.
    """
    (m, x), (n, y) = _rows(a, b)
    longest = max(m.max(initial=0), n.max(initial=0))
    kind = np.uint8 if longest < 1 << 7 else np.uint16 if longest < 1 << 15 else np.int64
    buckets = min(BUCKETS, max(int(x.max(initial=0)), int(y.max(initial=0))) + 1) if radius < longest else 0
    (rows, first_a, many_a, bags_a), (columns, first_b, many_b, bags_b) = _runs(x, m, buckets, kind), _runs(y, n, buckets, kind)
    m, x, n, y = m[rows], x[rows], n[columns], y[columns]
    to = [(c[rows].astype(np.int32), d[columns].astype(np.int32)) for c, d in zip(to_a.T, to_b.T, strict=True)] if radius < longest else []
    size_a, size_b = m[first_a], n[first_b]
    ends = np.flatnonzero(np.diff(size_a, append=-1)) + 1
    for at, end in zip([0, *ends[:-1]], ends, strict=True):
        size = size_a[at]
        low, high = np.searchsorted(size_b, size - radius), np.searchsorted(size_b, size + radius, "right")
        most = np.minimum(radius, radius + size - size_b[low:high])  # items that only a row of a has, so that those only b has are within the radius
        some = max(1, PAIRS // max(1, high - low))
        for k in range(at, end, some):
            stop = min(end, k + some)
            more, less = np.zeros((high - low, stop - k), kind), np.empty((high - low, stop - k), kind)
            for p, q in zip(bags_a, bags_b, strict=True):
                np.maximum(p[None, k:stop], q[low:high, None], out=less)
                less -= q[low:high, None]
                more += less
            run_b, run_a = np.nonzero(more <= most[:, None])
            run_a, run_b = run_a + k, run_b + low
            total = np.cumsum(many_a[run_a] * many_b[run_b])
            cut = 0
            while cut < len(total):
                until = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS, "right")))
                g, h = run_a[cut:until], run_b[cut:until]
                cut = until
                e, place = _spread(many_b[h])
                q = first_b[h][e] + place
                f, place = _spread(many_a[g][e])
                p, q = first_a[g][e][f] + place, q[f]
                for c, d in to:
                    there = np.abs(c[p] - d[q]) <= radius
                    p, q = p[there], q[there]
                found = np.zeros(len(p))
                step = _cells_of(n[q[-1]]) if len(p) else 1
                for f in range(0, len(p) if compare else 0, step):
                    c, d = p[f : f + step], q[f : f + step]
                    found[f : f + step] = _one_length(x[c, :size], y[d, : n[d[-1]]], n[d], radius)
                yield rows[p], columns[q], found


def timed_distances(a: Sequence, b: Sequence, ta: Sequence, tb: Sequence) -> np.ndarray:
    """As ``osa_distances``, but keeping equal items costs their difference in time over the largest time of both sequences."""
    most = [max([*map(float, s), *map(float, t)], default=0.0) or 1.0 for s, t in zip(ta, tb, strict=True)]
    scaled = lambda times: [np.asarray(t, float) / m for t, m in zip(times, most, strict=True)]
    return _by_rows(a, b, scaled(ta), scaled(tb))


def _similarities(distances: np.ndarray, a: Sequence, b: Sequence) -> np.ndarray:
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], float)
    return 1 - np.divide(distances, longest, out=np.zeros(len(longest)), where=longest > 0)


def _where_present(f: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    """``f`` of the rows without nulls, null elsewhere."""
    there = pd.concat([c.notna() for c in columns], axis=1).all(axis=1).to_numpy()
    out = np.full(len(there), np.nan)
    if there.any():
        out[there] = f(*([list(x) for x in c[there]] for c in columns))
    return pd.Series([None if not t else v for t, v in zip(there, out, strict=True)], dtype=object).astype("float64")


def _over_slices(f: Callable[..., np.ndarray], *columns: pa.Array) -> pa.Array:
    """``f`` of rows of arrays, null where one is null, for ``ITEMS`` items at a time: only these become objects of Python."""
    items = np.cumsum(sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    out, at = [np.zeros(0)], 0
    while at < len(items):
        end = max(at + 1, int(np.searchsorted(items, (items[at - 1] if at else 0) + ITEMS, "right")))
        out.append(_where_present(f, *(c.slice(at, end - at).to_pandas() for c in columns)).to_numpy())
        at = end
    return pa.array(np.concatenate(out), "float64", from_pandas=True)


def edit_distance(a: str | Column, b: str | Column, free: bool = False) -> Column:
    """Distance of two arrays, null if one is null; see ``osa_distances`` and, if ``free``, ``damerau_distances``."""

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return _over_slices(damerau_distances if free else osa_distances, a, b)

    return F.arrow_udf(of, "double")(a, b)


def edit_similarity(a: str | Column, b: str | Column, free: bool = False) -> Column:
    """1 - distance / longer length of two arrays; 1 for two empty ones, null if one is null."""

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return _over_slices(lambda x, y: _similarities((damerau_distances if free else osa_distances)(x, y), x, y), a, b)

    return F.arrow_udf(of, "double")(a, b)


def timed_edit_similarity(a: str | Column, b: str | Column, ta: str | Column, tb: str | Column) -> Column:
    """As :func:`edit_similarity` by ``timed_distances``."""

    def of(a: pa.Array, b: pa.Array, s: pa.Array, t: pa.Array) -> pa.Array:
        return _over_slices(lambda x, y, u, v: _similarities(timed_distances(x, y, u, v), x, y), a, b, s, t)

    return F.arrow_udf(of, "double")(a, b, ta, tb)
