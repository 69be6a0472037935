"""Lines that many documents share: hashes in ranges, first occurrences streamed, keep bitmaps for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import cut, small_batches, text_of

#: A line is looked at if its key has that many code points, and dropped if that many documents hold it.
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: What is stripped from both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
#: Stands for a null id, which is a document like others and the smallest.
NO_ID = -(1 << 63)

LINES = "array<struct<h1: bigint, h2: bigint, at: array<int>>>"


def key_of_line(line: bytes) -> bytes:
    """The line without blanks at its ends, A to Z lower-cased (``bytes.lower`` knows no other letters)."""
    return line.strip(BLANKS).lower()


def hashed_lines(text: bytes, least_chars: int) -> dict[tuple[int, int], list[int]]:
    """128-bit hash of a key, as two longs -> the places of its lines, for keys that are long enough."""
    out: dict[tuple[int, int], list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = key_of_line(line)
        if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
            h = xxhash.xxh3_128_intdigest(key)
            out.setdefault(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)), []).append(i)
    return out


def encode_bitmap(dropped: list[int]) -> bytes:
    """Runs of kept and dropped lines in turn, kept first, as variable-length numbers of 7 bits. After the last all are kept."""
    out, at = bytearray(), 0
    places = np.unique(np.asarray(dropped, np.int64))
    breaks = np.flatnonzero(np.diff(places) != 1) + 1
    for run in np.split(places, breaks):
        for x in (int(run[0]) - at, len(run)):
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        at = int(run[-1]) + 1
    return bytes(out)


def decode_bitmap(runs: bytes, n: int) -> np.ndarray:
    """Whether each of ``n`` lines is kept."""
    b = np.frombuffer(runs, np.uint8)
    last = np.flatnonzero(b < 128)
    lengths = np.zeros(len(last), np.int64)
    which = np.searchsorted(last, np.arange(len(b)))
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    np.add.at(lengths, which, (b & 127).astype(np.int64) << 7 * (np.arange(len(b)) - first[which]))
    keep = np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)
    return np.concatenate([keep, np.ones(n - len(keep), bool)])


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _changes(*arrays: np.ndarray) -> np.ndarray:
    """Whether each row differs from the row before it; the first does."""
    out = np.ones(len(arrays[0]), bool)
    out[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])
    return out


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, place, h1, h2, first, last, n) of the first and the last hash of a sorted range: its documents, n different ones."""
    groups: list[list[int]] = []  # the first group and the one that is open
    part = 0
    for batch in batches:
        h1, h2, doc, parts = _arrays(batch, "h1", "h2", "doc", "part")
        if not len(h1):
            continue
        part = int(parts[0])
        new = _changes(h1, h2)
        starts = np.flatnonzero(new)
        other = np.cumsum(new | _changes(doc))
        ends = np.concatenate([starts[1:], [len(h1)]])
        for i in sorted({0, len(starts) - 1}):
            s, e = starts[i], ends[i] - 1
            group = [int(h1[s]), int(h2[s]), int(doc[s]), int(doc[e]), int(other[e] - other[s] + 1)]
            if groups and groups[-1][:2] == group[:2]:
                groups[-1][4] += group[4] - (groups[-1][3] == group[2])
                groups[-1][3] = group[3]
            else:
                groups = [*groups[:1], group]
    columns = ["part", "place", "h1", "h2", "first", "last", "n"]
    rows = [(part, i, *g) for i, g in enumerate(groups)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(columns))], columns)


def stitched(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Hash -> (first document, different documents) of hashes that several ranges hold, from ``edges`` of all ranges."""
    out: dict[tuple[int, int], list[int]] = {}
    parts: dict[tuple[int, int], set[int]] = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
        h = (r["h1"], r["h2"])
        if h in out:
            out[h][2] += r["n"] - (out[h][1] == r["first"])
            out[h][1] = r["last"]
        else:
            out[h] = [r["first"], r["last"], r["n"]]
        parts.setdefault(h, set()).add(r["part"])
    return {h: (first, n) for h, (first, _, n) in out.items() if len(parts[h]) > 1}


def later_occurrences(batches: Iterator[pa.RecordBatch], spanning: dict[tuple[int, int], tuple[int, int]], least: int) -> Iterator[pa.RecordBatch]:
    """Of a sorted range the rows that follow the first document of their hash, if ``least`` documents hold it.

    ``spanning`` knows the hashes that other ranges hold too. Of a hash that goes on in the next batch, rows are held back only
    while too few of its documents have been seen. Repeated rows come once.
    """
    hash_, first, last, n, held = None, 0, 0, 0, []
    for batch in batches:
        h1, h2, doc, text = _arrays(batch, "h1", "h2", "doc", "text_key")
        if not len(h1):
            continue
        new = _changes(h1, h2)
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        other = np.cumsum(new | _changes(doc))
        counts = np.diff(np.append(other[starts], other[-1] + 1))
        firsts = doc[starts].copy()
        hashes = {g: (int(h1[starts[g]]), int(h2[starts[g]])) for g in (0, len(starts) - 1)}
        if hashes[0] == hash_:
            counts[0] += n - (last == doc[0])
            firsts[0] = first
        else:
            held = []
        for g, h in hashes.items():
            if h in spanning:
                firsts[g], counts[g] = spanning[h]
        later = (doc != firsts[group]) & _changes(h1, h2, doc, text)
        rows = batch.select(["doc", "text_key", "at"])
        if counts[0] >= least:
            yield from held
            held = []
        yield rows.filter(pa.array(later & (counts[group] >= least)))
        if hash_ != hashes[len(starts) - 1]:
            held = []
        hash_, first, last, n = hashes[len(starts) - 1], int(firsts[-1]), int(doc[-1]), int(counts[-1])
        if n < least:
            held.append(rows.filter(pa.array(later & (group == len(starts) - 1))))


def records_of(docs: DataFrame, id_column: str, text_column: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc, text_key, at): one row for each document and key of it, with the places of its lines."""

    @F.arrow_udf(LINES)
    def hashed(texts: pa.Array) -> pa.Array:
        h1, h2, at, each, places = [], [], [], [0], [0]
        for text in texts.cast(pa.large_binary()).to_pylist():
            for (a, b), lines in hashed_lines(text, least_chars).items():
                h1.append(a)
                h2.append(b)
                at += lines
                places.append(len(at))
            each.append(len(h1))
        lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(at, pa.int32()))
        rows = pa.StructArray.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["h1", "h2", "at"])
        return pa.ListArray.from_arrays(pa.array(each, pa.int32()), rows)

    rows = docs.select(doc_key(id_column).alias("doc"), F.xxhash64(text_of(text_column)).alias("text_key"), F.explode(hashed(text_of(text_column))).alias("line"))
    return rows.select("line.h1", "line.h2", "doc", "text_key", "line.at")


def doc_key(id_column: str):
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc, text_key, keep): a compressed bitmap of the lines that stay, for each document that loses lines.

    A line's key is stripped and lower-cased. Keys of ``least_chars`` code points or more that ``least_documents`` documents
    hold stay in the largest of these only. Rows of one id are one document; null ids are one too, the smallest. Null texts
    count as empty. An empty table gives none.

    Records are range-partitioned by hash, falling document and text, so a key that a third of all documents hold lies in many
    ranges; what the driver gets is two rows a range, and what tasks get back is one entry for each hash over several ranges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = cut(records_of(docs, id_column, text_column, least_chars).withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("text_key"), F.col("row")]
    ranges = cut(records.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row").withColumn("part", F.spark_partition_id().cast("long")))
    found = ranges.select("h1", "h2", "doc", "part").mapInArrow(edges, "part long, place long, h1 long, h2 long, first long, last long, n long")
    spanning = stitched(found.collect())
    dropped = ranges.mapInArrow(lambda batches: later_occurrences(batches, spanning, least_documents), "doc long, text_key long, at array<int>")

    @F.arrow_udf("binary")
    def bitmap(places: pa.Array) -> pa.Array:
        return pa.array((encode_bitmap(p) for p in places.to_pylist()), pa.binary())

    return dropped.groupBy("doc", "text_key").agg(bitmap(F.flatten(F.collect_list("at"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text", output: str = "deduped") -> DataFrame:
    """Add ``output``, a struct (text, n_lines, n_dropped) of the lines that stay, joined again.

    Rows and other columns stay, but for one named as ``output``. A null text has one empty line and comes back empty.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("text string, n_dropped long")
    def kept(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        out = []
        for text, runs in zip(texts.cast(pa.large_binary()).to_pylist(), bitmaps.to_pylist(), strict=True):
            if runs is None:
                out.append({"text": None, "n_dropped": 0})
                continue
            lines = text.split(b"\n")
            keep = decode_bitmap(runs, len(lines))
            out.append({"text": b"\n".join([lines[i] for i in np.flatnonzero(keep)]), "n_dropped": int(np.count_nonzero(~keep))})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_dropped", pa.int64())]))

    text = text_of(text_column)
    rows = docs.select(F.struct("*").alias("_row"), doc_key(id_column).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("_text"))
    joined = rows.join(bitmaps, ["doc", "text_key"], "left")
    found = joined.withColumn("_kept", kept(F.when(F.col("keep").isNotNull(), F.col("_text")), F.col("keep")))
    n_lines = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    value = F.struct(F.coalesce("_kept.text", "_text").alias("text"), n_lines.cast("long").alias("n_lines"), F.col("_kept.n_dropped").alias("n_dropped"))
    return found.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c != output), value.alias(output))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", output: str = "deduped", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``docs`` with ``output``: see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_column, text_column, least_chars, least_documents), id_column, text_column, output)
