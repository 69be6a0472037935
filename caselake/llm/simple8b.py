"""Token ids in files of Simple-8b words.

A row of a file is a pack: the ids of some following documents as one stream, cut into blocks of 1024 ids. Each block
begins at a 64-bit word, and the pack lists the words of each block, so any block can be decoded alone. A word has a
selector in its upper 4 bits and values in the other 60; selector 1 is an escape: the next word is one plain 64-bit value.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

from caselake.llm.bpe import lists_of_ids
from caselake.llm.common import small_batches, text_of

# Fixed values of the format: selector -> (values, bits of each).
SELECTORS = {0: (240, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 1
BLOCK = 1024
#: Ids of a pack at most, unless one document has more.
PACK = 1 << 18
PACK_SCHEMA = "part int, first long, doc_ids array<long>, lengths array<int>, block_words array<int>, words binary"


LONGEST = max(count for count, _ in SELECTORS.values())
_COUNTS = np.array([SELECTORS.get(s, (1, 60))[0] for s in range(16)], np.int64)
_SMALL_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if int(values.max()) < 1 << 16:
        return _SMALL_BITS[values.astype(np.uint16)]
    out, rest = np.zeros(values.shape, np.uint8), values.copy()
    while rest.any():
        out += np.where(rest > 0, _SMALL_BITS[np.minimum(rest, 0xFFFF).astype(np.uint16)], 0).astype(np.uint8)
        rest >>= np.uint64(16)
        out[rest > 0] = 16 * (out[rest > 0] // 16 + (out[rest > 0] % 16 > 0))
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a stream of unsigned values, and the number of words of each of its blocks.

    At each place the densest selector whose values all fit is taken; past the end of a block values count as zeros. The
    largest width in each window comes from those of shorter windows, for all places at once.
    """
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + LONGEST), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    padded[:, :BLOCK] = full.reshape(blocks, BLOCK)
    widths = _bits(padded)
    stride = BLOCK + LONGEST
    window = {1: widths}  # length -> largest width of so many values from each place
    choice = np.full((blocks, stride), ESCAPE, np.uint8)
    size = 1
    while 2 * size <= LONGEST:
        half = window[size]
        window[2 * size] = np.maximum(half, np.pad(half[:, size:], ((0, 0), (0, size))))
        size *= 2
    pairs = int(window[2][:, : BLOCK - 1].min()) if n >= BLOCK else 0
    for selector, (count, bits) in sorted(SELECTORS.items(), reverse=True):
        if count > 1 and bits < pairs:
            continue  # no two neighbours fit, so it would serve the end of a block only, where a wider one does as well
        most, done = None, 0
        for length in (x for x in sorted(window, reverse=True) if count & x):
            part = np.pad(window[length][:, done:], ((0, 0), (0, done))) if done else window[length]
            most, done = part if most is None else np.maximum(most, part), done + length
        choice[most <= bits] = selector
    chosen, step = choice.tobytes(), _COUNTS.tolist()
    starts: list[int] = []
    for block in range(blocks):
        i, end = block * stride, block * stride + min(BLOCK, n - block * BLOCK)
        while i < end:
            starts.append(i)
            i += step[chosen[i]]
    at_value = np.array(starts)
    chosen = choice.ravel()[at_value]
    length = 1 + (chosen == ESCAPE)
    at = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    flat = padded.ravel()
    for selector in np.unique(chosen).tolist():
        k = np.flatnonzero(chosen == selector)
        word = np.full(len(k), selector << 60, np.uint64)
        if selector == ESCAPE:
            words[at[k] + 1] = flat[at_value[k]]
        else:
            count, bits = SELECTORS[selector]
            for j in range(count if bits else 0):
                word |= flat[at_value[k] + j] << np.uint64(j * bits)
        words[at[k]] = word
    return words, np.bincount(at_value // stride, weights=length).astype(np.int32)


def unpack_all(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """All values of a pack, words of one selector at once; what a block's last word has in excess is cut.

    Each block begins at a word of its own, so any block can be unpacked alone from its words.
    """
    if not n:
        return np.empty(0, np.uint64)
    blocks, stride = len(block_words), BLOCK + LONGEST
    selector = (words >> np.uint64(60)).astype(np.uint8)
    counts = _COUNTS[selector]
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if counts[i]:  # else it is itself a plain value
            counts[i], selector[i], selector[i + 1], counts[i + 1] = 1, 255, 254, 0
    block = np.repeat(np.arange(blocks), block_words)
    before = np.cumsum(counts) - counts
    first = before[np.cumsum(block_words) - block_words]
    at = block * stride + before - first[block]
    out = np.zeros(blocks * stride, np.uint64)
    for s, (count, bits) in SELECTORS.items():
        k = np.flatnonzero(selector == s) if bits else ()
        if len(k):
            to, mask, word = at[k], np.uint64((1 << bits) - 1), words[k]
            for j in range(count):
                out[to + j] = (word >> np.uint64(j * bits)) & mask
    k = np.flatnonzero(selector == 255)
    out[at[k]] = words[k + 1]
    return out.reshape(blocks, stride)[:, :BLOCK].ravel()[:n]


#: ASCII marks without the apostrophe: the tokenizer splits between a run of them and letters or digits.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Units of a word: marks before, its core, marks after.
UNITS = 3


@lru_cache(1)
def letters_that_end_in_marks() -> str:
    """A class of the letters whose lower-case composed form is not letters only, such as U+0130 or Devanagari ones with nukta.

    The tokenizer normalises before it splits, so such a letter may join the mark beside it.
    """
    found = (c for c in map(chr, range(128, 0x110000)) if c.isalpha() and not normalize("NFC", c.lower()).isalpha())
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in found) + "]"


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start[i] : start[i] + length[i]]`` for each i of ``pick``, put together, and their lengths."""
    lengths = length[pick]
    at = np.repeat(start[pick] - np.cumsum(lengths, dtype=np.int32) + lengths, lengths)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], lengths


class WordEncoder:
    """The tokenizers library over a vocabulary in which white space only separates words, with a memory of words.

    Words are cut at ASCII white space, where no token and no normalisation reaches across; A-Z are lower-cased first, as the
    vocabulary's own normaliser does. Arrow numbers the distinct words of some texts, so that each is looked up once; marks
    around a word are units of their own. Units that are not remembered go to the library. Those of lower-case, composed
    letters need no normaliser and no splitting, so they go in longer texts that are only cut at spaces, and are told apart
    again by the tokens that end a piece. All other units go one by one through the whole tokenizer. Texts are cut where they have a special token,
    as the library does before anything else.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.encode_special_tokens = True  # texts are cut at them beforehand
            t.model._resize_cache(0)  # each unit is asked for once
        self.plain.normalizer, self.plain.pre_tokenizer = None, Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.start, self.length = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _add(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.number), len(units)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + k > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + k] = lengths
        self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.number.update(zip(units, range(n, n + k)))

    def _learn(self, units: list[str]) -> None:
        simple, whole = [], []
        for u in units:
            (simple if u.isalpha() and (u.isascii() or u.islower() and is_normalized("NFC", u)) else whole).append(u)
        for i in range(0, len(simple), 100):
            part = simple[i : i + 100]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            self._add(part, ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        if whole:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            self._add(whole, np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64))

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """Numbers of units in the memory; those that are new are learned."""
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.number.get, distinct))
        if None in found:
            new = [u for u, n in zip(distinct, found, strict=True) if n is None]
            self._learn(new)
            learned = map(self.number.__getitem__, new)
            found = [next(learned) if n is None else n for n in found]
        return np.array(found, np.int32)[coded.indices.to_numpy()]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, put together, and the number of each."""
        if len(self.number) + len(words) > self.remembered:
            self._forget()
        kept = pc.ascii_ltrim(words, MARKS)
        core = pc.ascii_rtrim(kept, MARKS)
        whole, left, inner = (pc.binary_length(x).to_numpy() for x in (words, kept, core))
        # a word is cut at its marks only where what is left is letters in their normal form: other units may have rules across the cut
        alone = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(core, letters_that_end_in_marks()))
        letters = pc.or_(pc.equal(inner, 0), alone).to_numpy(zero_copy_only=False)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        before, after = np.where(letters, whole - left, 0), np.where(letters, left - inner, 0)
        edges = np.empty(UNITS * len(words) + 1, np.int64)
        edges[0:-1:UNITS], edges[1::UNITS], edges[2::UNITS], edges[-1] = at[:-1], at[:-1] + before, at[1:] - after, at[-1]
        units = pa.Array.from_buffers(pa.string(), UNITS * len(words), [None, pa.py_buffer(edges.astype(np.int32)), words.buffers()[2]])
        numbers = self._numbers(units)
        ids, lengths = _gather(self.flat, self.start, self.length, numbers)
        return ids, lengths.reshape(-1, UNITS).sum(1, dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, put together, and the number of each text."""
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            return self._with_special(texts.to_pylist())
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        ids, lengths = self._of_words(coded.dictionary)
        out, each = _gather(ids, np.cumsum(lengths, dtype=np.int32) - lengths, lengths, coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return out, np.diff(upto)

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.at_special.split(t) for t in texts]  # ordinary and special ones take turns
        ids, lengths = self._encode(pa.array([p for row in pieces for p in row[::2]], pa.string()))
        out, counts, at, k = [], [], 0, 0
        for row in pieces:
            n = 0
            for i, p in enumerate(row):
                if i % 2:
                    out.append(np.array([self.special[p]], "<u4"))
                else:
                    out.append(ids[at : at + lengths[k]])
                    at, k = at + lengths[k], k + 1
                n += len(out[-1])
            counts.append(n)
        return np.concatenate(out), np.array(counts, np.int64)


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write packs in ascending order of the ids of the documents.

    Null text counts as empty (one id: the end). Null ids come first; equal ids are ordered by a hash of the text, so that an
    id which many rows share is spread over ranges. Special tokens in a text are single ids, as the library has it. Rows are
    range-partitioned; ``part`` numbers the ranges, and ``first`` counts the ids of a pack's range that stand before it. The
    files are a Parquet dataset, so that a lost task is written again by Spark's own committer. An empty table makes a dataset
    without packs; other columns of ``docs`` are not read, whatever their names. The folder is the caller's to delete.
    """
    spark = docs.sparkSession
    small_batches(spark, 2 << 20)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))

    def packs(batches):
        encoder, part, first = _encoder(path), TaskContext.get().partitionId(), 0
        held, size = [], 0  # ids of the documents of the next pack, by document: (id, ids)

        def row() -> pa.RecordBatch:
            lengths = [len(x) for _, x in held]
            words, blocks = pack(np.concatenate([x for _, x in held]))
            columns = [[part], [first], [[i for i, _ in held]], [lengths], [blocks.tolist()], [words.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "first", "doc_ids", "lengths", "block_words", "words"])

        for batch in batches:
            ids, lengths = encoder.encode(batch.column(1))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), [0, *ends], ends):
                if held and size + b - a > PACK:
                    yield row()
                    held, size, first = [], 0, first + size
                held.append((doc, ids[a:b]))
                size += b - a
        if held:
            yield row()

    key = F.xxhash64("text")
    ordered = rows.withColumn("key", key).repartitionByRange(partitions, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    ordered.select("doc_id", "text").mapInArrow(packs, PACK_SCHEMA).write.mode("overwrite").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: (doc_id, start, ids), ``start`` counting the ids of all documents before it.

    The sums of the ranges go to the driver (one row for each range); each pack knows its place in its range, so packs are
    decoded where they are read, in any order.
    """
    small_batches(spark)
    files = spark.read.schema(PACK_SCHEMA).parquet(folder)
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    begin, total = {}, 0
    for r in files.groupBy("part").agg(F.sum(n).alias("n")).orderBy("part").collect():
        begin[r["part"]] = total
        total += r["n"]

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                ids = unpack_all(np.frombuffer(r["words"], "<u8"), np.array(r["block_words"], np.int64), int(lengths.sum()))
                flat, ends = ids.astype("<u4").tobytes(), lengths.cumsum()
                rows = [flat[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                starts = begin[r["part"]] + r["first"] + ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), lists_of_ids(rows)], names=["doc_id", "start", "ids"])

    return files.mapInArrow(documents, "doc_id long, start long, ids array<int>")


def add_crc32(tokens: DataFrame, ids_column: str = "ids", output: str = "ids_crc32") -> DataFrame:
    """Add the unsigned CRC-32 of each list of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = (4 * np.asarray(lists.value_lengths().fill_null(0)).cumsum()).tolist()
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.int64())

    return tokens.withColumn(output, crc(F.col(ids_column)))
