"""Matroska media in binary columns: a parser to packet tables, and a writer for lossless 8-bit sound.

The parser reads EBML elements of variable length, clusters of known or unknown size, simple blocks and block groups with
all four kinds of lacing, and cues. It gives packets as (track, timestamp, byte range), so payload is read by range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import small_batches, text_of

# Fixed values of the format: element identifiers.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, MUXER, WRITER = 0x2AD7B1, 0x4D80, 0x5741
NUMBER, UID, KIND, CODEC, LACING, FRAME_NS, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE_BLOCK, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = frozenset({INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469})

SAMPLE_RATE = 8000
FRAME = 1024
FRAMES_OF_BLOCK = 8
BLOCKS_OF_CLUSTER = 16
PACKETS = "array<struct<track:long,timestamp_ns:long,offset:long,size:long>>"
DEMUXED = f"struct<packets:{PACKETS},clusters:int,laced_blocks:int,cues:array<struct<timestamp_ns:long,track:long,cluster_offset:long>>,payload:binary>"


@dataclass
class Media:
    packets: list[tuple[int, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    laced: int = 0


class Truncated(ValueError):
    """An element goes on past the end of the data."""


def size_of(x: int, width: int = 0) -> bytes:
    """A variable-length size: the width is marked by the leading zeros of the first byte."""
    width = width or next(w for w in range(1, 9) if x < (1 << 7 * w) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def element(identifier: int, content: bytes | int) -> bytes:
    if isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    return identifier.to_bytes((identifier.bit_length() + 7) // 8, "big") + size_of(len(content)) + content


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Flags and lace header of a block: none for one frame, fixed for equal sizes, else EBML (signed differences)."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0x80, b""
    if len(set(sizes)) == 1:
        return 0x84, bytes([len(frames) - 1])
    head = bytes([len(frames) - 1]) + size_of(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
        head += size_of(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x86, head


def mux(payload: bytes) -> bytes:
    """One track of 8-bit PCM whose samples are the payload, with a cue for each cluster."""
    audio = element(AUDIO, element(RATE, np.float32(SAMPLE_RATE).astype(">f4").tobytes()) + element(CHANNELS, 1) + element(DEPTH, 8))
    frame_ms = 1000 * FRAME // SAMPLE_RATE
    track = element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(LACING, 1) + element(FRAME_NS, frame_ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio
    body = [element(INFO, element(SCALE, 1_000_000) + element(MUXER, b"caselake") + element(WRITER, b"caselake")), element(TRACKS, element(TRACK, track))]
    at, cues = sum(map(len, body)), []
    of_block, of_cluster = FRAME * FRAMES_OF_BLOCK, FRAME * FRAMES_OF_BLOCK * BLOCKS_OF_CLUSTER
    for start in range(0, len(payload), of_cluster):
        time = start // FRAME * frame_ms
        parts = [element(TIME, time)]
        for i in range(start, min(start + of_cluster, len(payload)), of_block):
            data = payload[i : i + of_block]
            flags, head = _laced([data[j : j + FRAME] for j in range(0, len(data), FRAME)])
            parts.append(element(SIMPLE_BLOCK, b"\x81" + (i // FRAME * frame_ms - time).to_bytes(2, "big", signed=True) + bytes([flags]) + head + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, element(CUE_TIME, time) + element(CUE_PLACE, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    head = element(EBML, b"".join(element(k, v) for k, v in ((EBML_VERSION, 1), (EBML_READ, 1), (EBML_ID_LENGTH, 4), (EBML_SIZE_LENGTH, 8), (DOC_TYPE, b"matroska"), (DOC_VERSION, 4), (DOC_READ, 2))))
    return head + element(SEGMENT, b"".join(body))


def _varint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, int]:
    """Value, position after it and width; -1 stands for an unknown size (all bits set)."""
    if at >= len(data) or not data[at]:
        raise Truncated
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Truncated
    x = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return x, at + width, width
    x &= (1 << 7 * width) - 1
    return (-1 if x == (1 << 7 * width) - 1 else x), at + width, width


def _children(data: bytes, at: int, end: int, stop: frozenset = frozenset()):
    """(identifier, begin, end) of each element; of unknown size: up to an identifier of ``stop`` or the end."""
    while at < end:
        identifier, body, _ = _varint(data, at, keep_mark=True)
        if identifier in stop:
            return
        size, body, _ = _varint(data, body)
        if size < 0:
            until = body
            for _, _, until in _children(data, body, end, TOP_LEVEL if identifier == CLUSTER else frozenset()):
                pass
        else:
            until = body + size
        if until > end:
            yield identifier, body, end
            return
        yield identifier, body, until
        at = until


def _number(data: bytes, begin: int, end: int) -> int:
    return int.from_bytes(data[begin:end], "big")


def _frames(data: bytes, begin: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative time and (offset, size) of each frame of a block."""
    track, at, _ = _varint(data, begin)
    if at + 3 > end:
        raise Truncated
    time, lacing, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2] >> 1 & 3, at + 3
    if not lacing:
        return track, time, [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if lacing == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                x, at, width = _varint(data, at)
                size = x if i == 0 else sizes[-1] + x - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    if min(sizes) < 0:
        raise Truncated
    return track, time, list(zip(starts, sizes, strict=True))


def parse(data: bytes) -> Media:
    """Packets and cues of a file. Unknown elements are passed over; what follows a damaged element is left out."""
    out, scale, frame_ns, segment = Media(), 1_000_000, {}, 0
    try:
        for top, a, b in _children(data, 0, len(data)):
            if top != SEGMENT:
                continue
            segment = a
            for kind, a1, b1 in _children(data, a, b):
                if kind == INFO:
                    scale = next((_number(data, x, y) for k, x, y in _children(data, a1, b1) if k == SCALE), scale)
                elif kind == TRACKS:
                    for _, a2, b2 in _children(data, a1, b1):
                        entry = {k: _number(data, x, y) for k, x, y in _children(data, a2, b2) if k in (NUMBER, FRAME_NS)}
                        frame_ns[entry.get(NUMBER)] = entry.get(FRAME_NS, 0)
                elif kind == CLUSTER:
                    out.clusters.append(a1)
                    time = 0
                    for k, x, y in _children(data, a1, b1):
                        if k == TIME:
                            time = _number(data, x, y)
                        blocks = [(x, y)] if k == SIMPLE_BLOCK else [(p, q) for g, p, q in _children(data, x, y) if g == BLOCK] if k == GROUP else []
                        for p, q in blocks:
                            track, relative, frames = _frames(data, p, q)
                            out.laced += len(frames) > 1
                            first, each = (time + relative) * scale, frame_ns.get(track, 0)
                            out.packets += [(track, first + i * each, at, size) for i, (at, size) in enumerate(frames)]
                elif kind == CUES:
                    for _, a2, b2 in _children(data, a1, b1):
                        fields = list(_children(data, a2, b2))
                        time = next((_number(data, x, y) for k, x, y in fields if k == CUE_TIME), 0)
                        for k, x, y in fields:
                            if k == CUE_PLACE:
                                place = {i: _number(data, p, q) for i, p, q in _children(data, x, y)}
                                out.cues.append((time * scale, place.get(CUE_TRACK, 0), segment + place.get(CUE_CLUSTER, 0)))
    except (Truncated, IndexError):
        pass
    return out


def padded(text: str, to: int = 64) -> bytes:
    """UTF-8 of a text with zero bytes up to a positive multiple of ``to``."""
    raw = text.encode()
    return raw + bytes(-len(raw) % to if raw else to)


def store_text(docs: DataFrame, text_column: str = "text", output: str = "media") -> DataFrame:
    """Add ``output``: the whole text (null: empty) as padded UTF-8 bytes in a Matroska file. Rows and other columns stay."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def muxed(texts: pa.Array) -> pa.Array:
        return pa.array((mux(padded(x)) for x in texts.to_pylist()), pa.binary())

    return docs.withColumn(output, muxed(text_of(text_column)))


def packet_table(media: DataFrame, media_column: str = "media", output: str = "demuxed") -> DataFrame:
    """Add ``output``, a struct of packets (track, timestamp, byte range), clusters, laced blocks, cues and the payload.

    The payload is the packets' bytes in file order. Null media gives an empty table, damaged media what stands before the
    damage. Rows and other columns stay.
    """
    small_batches(media.sparkSession)

    @F.arrow_udf(DEMUXED)
    def demuxed(column: pa.Array) -> pa.Array:
        out = []
        for data in column.to_pylist():
            data = data or b""
            m = parse(data)
            out.append({
                "packets": [dict(zip(("track", "timestamp_ns", "offset", "size"), p, strict=True)) for p in m.packets],
                "clusters": len(m.clusters),
                "laced_blocks": m.laced,
                "cues": [dict(zip(("timestamp_ns", "track", "cluster_offset"), c, strict=True)) for c in m.cues],
                "payload": b"".join([data[at : at + size] for _, _, at, size in m.packets]),
            })
        packet = pa.struct([(k, pa.int64()) for k in ("track", "timestamp_ns", "offset", "size")])
        cue = pa.struct([(k, pa.int64()) for k in ("timestamp_ns", "track", "cluster_offset")])
        return pa.array(out, pa.struct([("packets", pa.list_(packet)), ("clusters", pa.int32()), ("laced_blocks", pa.int32()), ("cues", pa.list_(cue)), ("payload", pa.binary())]))

    return media.withColumn(output, demuxed(F.col(media_column)))
