"""Byte-level BPE by a segment tree over byte positions.

A text is split by the tokenizer's pattern, and each piece starts as one token per byte. Leaf i of a segment tree holds the
rank of the pair that begins at position i (or none); each inner node holds the smaller of its children, the left one when
equal. The root is thus the leftmost pair of the smallest rank. Merging it changes three leaves: its own, that of its live
left neighbour, and that of the position it swallowed; each is a point update on one path to the root. Many pieces of like
length are merged at once, a tree a row, with numpy doing the same step for all rows that still have a pair.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import small_batches, text_of

NONE = np.int32(2**31 - 1)
#: Cells of the trees that are merged at once.
TREE_CELLS = 1 << 18
#: Pieces that a worker remembers, in each of two generations; only saves time.
REMEMBERED = 100_000
#: Characters of the texts that are split and encoded at once.
PART = 1 << 20


class Vocabulary:
    """Ranks read from a file: a base64 token and its rank on each line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.values = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where they don't merge. A merged pair's token id is its rank."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece (of one byte or more), as little-endian 32-bit integers."""
        out: list = [None] * len(pieces)
        by_leaves: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                by_leaves.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for leaves, members in by_leaves.items():
            step = max(1, TREE_CELLS // (2 * leaves))
            for i in range(0, len(members), step):
                part = members[i : i + step]
                for k, ids in zip(part, self._merge_alike([pieces[k] for k in part], leaves), strict=True):
                    out[k] = ids
        return out

    def _merge_alike(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        rows, size = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(rows, leaves)
        ids = self.byte_ids[raw]
        position = np.arange(leaves)
        after = np.broadcast_to(position + 1, (rows, leaves)).copy()  # next live position; size: none
        before = np.broadcast_to(position - 1, (rows, leaves)).copy()
        tree = np.full((rows, 2 * leaves), NONE, np.int32)
        if leaves > 1:
            pair = self.rank(ids[:, :-1], ids[:, 1:])
            tree[:, leaves : 2 * leaves - 1] = np.where(position[None, 1:] < size[:, None], pair, NONE)
        level = leaves // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.broadcast_to(position, (rows, leaves)) < size[:, None]

        def put(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + leaves
            tree[row, node] = rank
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            best, node = tree[row, 1], np.ones(len(row), np.int64)
            while node[0] < leaves:  # down to the leftmost leaf that holds the root's rank
                node = 2 * node
                node += tree[row, node] != best
            at = node - leaves
            gone = after[row, at]
            then = after[row, gone]
            ids[row, at] = best
            live[row, gone] = False
            after[row, at] = then
            put(row, gone, np.full(len(row), NONE, np.int32))
            inside = then < size[row]
            before[row[inside], then[inside]] = at[inside]
            right = np.where(inside, self.rank(best, ids[row, np.where(inside, then, 0)]), NONE)
            put(row, at, right.astype(np.int32))
            prior = before[row, at]
            has = prior >= 0
            if has.any():
                r, p = row[has], prior[has]
                put(r, p, self.rank(ids[r, p], best[has]).astype(np.int32))
            row = row[tree[row, 1] != NONE]
        flat, ends = ids[live].astype("<i4").tobytes(), (4 * live.sum(1).cumsum()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts of one vocabulary and pattern, batch by batch, and remembers pieces that it has merged."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        # Only Unicode's White_Space is white space, as in the pattern's own engine.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}")
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _learn(self, chunks: set[str], known: dict[str, bytes | None]) -> None:
        """Add the ids of each chunk. A chunk with white space at its ends (but one leading space) isn't a unit: None."""
        if len(self.young) + len(chunks) > REMEMBERED:
            self.old, self.young = self.young, {}
        split, new = {}, set()
        for c in chunks:
            body = c[1:] if c[0] == " " else c
            if body.isalpha():
                new.add(c)
            elif not body or self.space.match(body[0]) or self.space.match(body[-1]):
                known[c] = None
            else:
                split[c] = found = self.pattern.findall(c)
                new.update(found)
        ids = {p: x for memory in (self.old, self.young) for p in new.intersection(memory) if (x := memory[p]) is not None}
        pieces = list(new.difference(ids))
        ids.update(zip(pieces, self.vocabulary.merge([p.encode() for p in pieces]), strict=True))
        for c, found in split.items():
            known[c] = b"".join([ids[p] for p in found])
        for p, x in ids.items():
            known.setdefault(p, x)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Each match of the pattern that begins with a space after other than white space begins a chunk; chunks are encoded
        apart from each other. Texts in which spaces stand beside other white space are split by the pattern as a whole.
        """
        cut = []
        for t in texts:
            head, *rest = t.split(" ")
            cut.append(([head] if head else []) + [" " + w for w in rest])
        need = set().union(*cut)
        known: dict[str, bytes | None] = {c: self.old[c] for c in need.intersection(self.old)}
        known.update({c: self.young[c] for c in need.intersection(self.young)})
        self._learn(need.difference(known), known)
        self.young.update(known)
        out = []
        for t, chunks in zip(texts, cut, strict=True):
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
            except TypeError:
                pieces = self.pattern.findall(t)
                merged = dict(zip(u := list(dict.fromkeys(pieces)), self.vocabulary.merge([p.encode() for p in u]), strict=True))
                out.append(b"".join(map(merged.__getitem__, pieces)))
        return out


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def lists_of_ids(rows: list[bytes]) -> pa.Array:
    """Rows of little-endian 32-bit integers as an Arrow array of lists."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def batches_of(column: pa.Array, limit: int = PART):
    """Runs of texts of ``limit`` characters at most, or one longer text, made into Python strings one run at a time."""
    part: list[str] = []
    size = 0
    for x in column:
        t = x.as_py()
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", output: str = "ids") -> DataFrame:
    """Add ``output``, the token ids of each whole text; null and empty texts get an empty list.

    No special tokens are sought or added. Rows and other columns stay; a column named like the output is replaced.
    ``path`` must be readable on the executors, like any vocabulary installed with a library.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern)
        return lists_of_ids([x for part in batches_of(texts) for x in encoder.encode(part)])

    return docs.withColumn(output, ids(text_of(text_column)))


def decode(tokens: DataFrame, path: str, pattern: str, ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """Add ``output``, the bytes that the ids stand for. A null list counts as empty; an id that isn't in the file is an error."""
    small_batches(tokens.sparkSession)

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        of = _encoder(path, pattern).vocabulary.bytes_of
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.asarray(lists.value_lengths().fill_null(0)).cumsum()
        out, at = [], 0
        for end in ends.tolist():
            out.append(b"".join(map(of.__getitem__, flat[at:end])))
            at = end
        return pa.array(out, pa.binary())

    return tokens.withColumn(output, joined(F.coalesce(F.col(ids_column), F.array().cast("array<int>"))))
