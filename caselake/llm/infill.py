"""Fill-in-middle: documents as piece tables, i.e. descriptors over an immutable text buffer and one of sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import small_batches, text_of

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred documents that could be cut, those from this place on stay plain; of the others so many have the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Buffers of a piece table.
TEXT, MARKS = 0, 1
#: Bytes of a text that are looked at at once, so that a very long text costs little beside itself.
STEP = 1 << 20

PIECES = "array<struct<buffer: int, start: bigint, length: bigint>>"
INFILLED = f"n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {PIECES}, output string, output_sha256 string"


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """A document as a sequence of descriptors; buffers are never changed or copied."""

    def __init__(self, buffers: Sequence[bytes | memoryview], pieces: Sequence[Piece]):
        self.buffers, self.pieces = [memoryview(b) for b in buffers], list(pieces)

    def cut(self, at: int) -> None:
        """Split the descriptor that byte ``at`` of the document falls into. At either end of it, an empty one arises."""
        for i, p in enumerate(self.pieces):
            if at <= p.length:
                self.pieces[i : i + 1] = [Piece(p.buffer, p.start, at), Piece(p.buffer, p.start + at, p.length - at)]
                return
            at -= p.length
        raise ValueError("a cut beyond the end of the document")

    def arrange(self, order: Sequence[int]) -> None:
        """Permute the descriptors: the new i-th is the old ``order[i]``-th."""
        self.pieces = [self.pieces[i] for i in order]

    def chunks(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start : p.start + p.length]

    def sha256(self) -> str:
        """Hash of the document, streamed over its descriptors."""
        digest = hashlib.sha256()
        for c in self.chunks():
            digest.update(c)
        return digest.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.chunks())


def inverse(order: Sequence[int]) -> list[int]:
    out = [0] * len(order)
    for i, o in enumerate(order):
        out[o] = i
    return out


#: The pieces in the order of the text are sentinel P, prefix, sentinel M, middle, sentinel S, suffix; a form permutes them.
FORMS = {"psm": [0, 1, 4, 5, 2, 3], "spm": [4, 5, 0, 1, 2, 3]}


def check_sentinels(sentinels: Sequence[str]) -> list[bytes]:
    """Sentinels as bytes. None may hold or overlap another, so that the first occurrence of one is where it was put."""
    marks = [s.encode() for s in sentinels]
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or i != j and a in b or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"sentinels hold or overlap each other: {sentinels}")
    return marks


class Units:
    """Units of a text in UTF-8: runs of ASCII letters, and single other characters."""

    def __init__(self, text: memoryview):
        self.bytes = np.frombuffer(text, np.uint8)
        self.counts = [int(np.count_nonzero(self._starts(at))) for at in range(0, len(self.bytes), STEP)]
        self.n = sum(self.counts)

    def _starts(self, at: int) -> np.ndarray:
        """Whether a unit starts at each byte from ``at`` on."""
        b = self.bytes[at : at + STEP]
        letter = ((b | 32) - np.uint8(97)) < 26
        before = np.empty_like(letter)
        before[1:] = letter[:-1]
        before[:1] = at > 0 and 97 <= self.bytes[at - 1] | 32 <= 122
        return ((b & 0xC0) != 0x80) & ~(letter & before)

    def offset(self, units: int) -> int:
        """Bytes of the first ``units`` units."""
        if units >= self.n:
            return len(self.bytes)
        for i, n in enumerate(self.counts):
            if units < n:
                return i * STEP + int(np.flatnonzero(self._starts(i * STEP))[units])
            units -= n
        raise AssertionError

    def chars(self, start: int, end: int) -> int:
        """Code points of a range of bytes."""
        return sum(int(np.count_nonzero((self.bytes[a : min(a + STEP, end)] & 0xC0) != 0x80)) for a in range(start, end, STEP))


def infill(raw: bytes, draws: Sequence[int], marks: Sequence[bytes], plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, PieceTable, int | None, int | None]:
    """(units, form, piece table of the output, code points of prefix and of middle) of one text."""
    units = Units(memoryview(raw))
    table = PieceTable([raw, b"".join(marks)], [Piece(TEXT, 0, len(raw))])
    if not raw or any(m in raw for m in marks) or draws[2] % 100 >= plain_from:
        return units.n, "plain", table, None, None
    a, b = (units.offset(u) for u in sorted(d % (units.n + 1) for d in draws[:2]))
    table.cut(a)
    table.cut(b)
    starts = np.cumsum([0, *map(len, marks)]).tolist()
    p, s, m = (Piece(MARKS, at, len(mark)) for at, mark in zip(starts, marks, strict=False))
    prefix, middle, suffix = table.pieces if a < b else (table.pieces[0], Piece(TEXT, a, 0), Piece(TEXT, a, len(raw) - a))
    table.pieces = [p, prefix, m, middle, s, suffix]
    form = "spm" if draws[3] % 100 < suffix_first else "psm"
    table.arrange(FORMS[form])
    return units.n, form, table, units.chars(0, a), units.chars(a, b)


def restored(output: bytes, form: str, marks: Sequence[bytes]) -> PieceTable:
    """Piece table of the text over the output: cut at the sentinels, ordered by the inverse permutation, sentinels left out."""
    table = PieceTable([output], [Piece(TEXT, 0, len(output))])
    if form == "plain":
        return table
    order, pieces, at = FORMS[form], [], 0
    names = [("p", "m", "s")[o // 2] for o in order[::2]]
    of = dict(zip("psm", marks, strict=True))
    for i, name in enumerate(names):
        body = at + len(of[name])
        end = output.index(of[names[i + 1]], body) if i < 2 else len(output)
        pieces += [Piece(TEXT, at, body - at), Piece(TEXT, body, end - body)]
        at = end
    table.pieces = pieces
    table.arrange(inverse(order))
    table.pieces = table.pieces[1::2]
    return table


def draws_of(id_column: str, seed: int):
    """Four numbers from the hash of a seed and an id; a null id is hashed as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*map(F.lit, (1, 9, 17, 25))), lambda at: F.conv(F.substr(digest, at, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", output: str = "infilled",
    seed: int = 1, sentinels: Sequence[str] = SENTINELS, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Add ``output``, a struct: units n, form, code points of prefix and middle, descriptors, output text and its hash.

    A text is cut at two places drawn from its id. Null texts count as empty, and those are plain, as are texts that hold a
    sentinel; their prefix and middle have null lengths. A text is cut whole, however long. Rows and other columns stay, but for
    one named as ``output``; repeated rows get equal values, an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    marks = check_sentinels(sentinels)
    piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
    schema = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("pieces", pa.list_(piece)), ("output", pa.string()), ("output_sha256", pa.string())])

    @F.arrow_udf(INFILLED)
    def infilled(texts: pa.Array, draws: pa.Array) -> pa.Array:
        out = []
        for raw, d in zip(texts.cast(pa.large_binary()).to_pylist(), draws.to_pylist(), strict=True):
            n, form, table, prefix, middle = infill(raw, d, marks, plain_from, suffix_first)
            pieces = [vars(p) for p in table.pieces]
            out.append({"n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "pieces": pieces, "output": bytes(table), "output_sha256": table.sha256()})
        return pa.array(out, schema)

    return docs.withColumn(output, infilled(text_of(text_column), draws_of(id_column, seed)))


def restore(docs: DataFrame, text, form, output: str = "restored", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Add ``output``, a struct of the text rebuilt from columns of an output and its form, and its hash.

    A null output gives nulls. Rows and other columns stay.
    """
    small_batches(docs.sparkSession)
    marks = check_sentinels(sentinels)
    schema = pa.struct([("text", pa.string()), ("sha256", pa.string())])

    @F.arrow_udf("text string, sha256 string")
    def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        out = []
        for raw, f in zip(outputs.cast(pa.large_binary()).to_pylist(), forms.to_pylist(), strict=True):
            table = None if raw is None else restored(raw, f, marks)
            out.append({"text": table and bytes(table), "sha256": table and table.sha256()})
        return pa.array(out, schema)

    return docs.withColumn(output, rebuilt(text, form))
