"""Matroska media columns: writing and parsing EBML into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element identifiers of the public EBML and Matroska specifications.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VOID, CRC32, TIMESTAMP_SCALE, DURATION = 0xEC, 0xBF, 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING_FLAG, FRAME_TIME = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}

SAMPLE_RATE = 8000
FRAME = 576
FRAME_MS = FRAME * 1000 // SAMPLE_RATE
LACED = 8
BLOCKS_PER_CLUSTER = 56


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def _size(value: int, width: int = 0) -> bytes:
    """A variable-length size: a marker bit tells how many bytes follow."""
    while width == 0 or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _id(kind) + _size(len(data)) + data


def _uint(kind: int, value: int) -> bytes:
    return _element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Flag bits and head of a block that holds several frames."""
    if lacing == "none" or len(frames) == 1:
        return 0x00, b""
    count = bytes([len(frames) - 1])
    if lacing == "fixed" and len({len(f) for f in frames}) == 1:
        return 0x04, count
    sizes = [len(f) for f in frames[:-1]]
    if lacing == "xiph":
        return 0x02, count + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes)
    head = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:], strict=False):
        width = 1
        while abs(b - a) >= (1 << 7 * width - 1) - 1:
            width += 1
        head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, count + head


def write(payload: bytes, lacing: str = "fixed", frame: int = FRAME, laced: int = LACED) -> bytes:
    """A Matroska file of one 8-bit mono PCM track whose frames are the payload's, in clusters with cues.

    lacing is none, fixed, xiph or ebml. An empty payload gives a file without clusters. A frame lasts
    whole milliseconds (8 bytes each), a lace holds 256 frames at most; a cluster ends before its blocks'
    16-bit times do.
    """
    if frame < 1 or frame * 1000 % SAMPLE_RATE or not 1 <= laced <= 256:
        raise ValueError(f"frames of {frame} bytes, {laced} to a lace")
    frame_ms = frame * 1000 // SAMPLE_RATE
    head = _element(EBML, _element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ, 2))
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000), _element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)))
    sound = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8))
    entry = _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(LACING_FLAG, int(lacing != "none")), _element(CODEC, b"A_PCM/INT/LIT"), _uint(FRAME_TIME, frame_ms * 1_000_000), sound)
    body, at, cues = [info, _element(TRACKS, entry)], len(info), []
    at += len(body[1])
    step = laced if lacing != "none" else 1
    blocks_each = max(1, min(BLOCKS_PER_CLUSTER, 32_767 // (step * frame_ms)))
    for first in range(0, len(frames), step * blocks_each):
        blocks = []
        for i in range(first, min(len(frames), first + step * blocks_each), step):
            some = frames[i : i + step]
            flag, lace = _lace(some, lacing)
            blocks.append(_element(SIMPLE_BLOCK, b"\x81", struct.pack(">hB", (i - first) * frame_ms, 0x80 | flag), lace, *some))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, first * frame_ms), *blocks)
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * frame_ms), _element(CUE_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, *body, *([_element(CUES, *cues)] if cues else []))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    lacing: str
    cluster_offset: int


@dataclass
class Media:
    """What a file holds. error tells why parsing stopped early; packets before that point stay."""

    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    error: str | None = None


class _Broken(Exception):
    pass


def _number(data: bytes, at: int, keep_marker: bool, most: int) -> tuple[int, int, bool]:
    """Value, bytes read and whether the size is the reserved 'unknown'."""
    if at >= len(data) or not data[at]:
        raise _Broken(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if width > most or at + width > len(data):
        raise _Broken(f"a number of {width} bytes at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & ((1 << 7 * width) - 1)
    return (value if keep_marker else bare), width, bare == (1 << 7 * width) - 1


def _children(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int]]:
    """(kind, first byte of the body, end of the body) of each element; an unknown size lasts to the next element of the level above."""
    while at < end:
        kind, n, _ = _number(data, at, True, 4)
        if within == CLUSTER and kind in TOP:
            return
        size, m, unknown = _number(data, at + n, False, 8)
        body = at + n + m
        if unknown:
            stop = end
            if kind == CLUSTER:
                stop = body
                for _, _, stop in _children(data, body, end, CLUSTER):
                    pass
        else:
            stop = body + size
        if stop > end:
            raise _Broken(f"element {kind:x} at byte {at} is cut off")
        yield kind, body, stop
        at = stop


def _lengths(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame lengths of a block and where its first frame begins."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise _Broken(f"a laced block without a count at byte {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise _Broken(f"fixed-size lacing of {end - at} bytes in {count} frames")
        return [(end - at) // count] * count, at
    if lacing == 1:
        for _ in range(count - 1):
            total = 0
            while True:
                if at >= end:
                    raise _Broken(f"lacing is cut off at byte {at}")
                total += data[at]
                at += 1
                if data[at - 1] < 255:
                    break
            sizes.append(total)
    elif count > 1:
        for k in range(count - 1):
            value, width, _ = _number(data, at, False, 8)
            sizes.append(sizes[-1] + value - ((1 << 7 * width - 1) - 1) if k else value)
            at += width
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise _Broken(f"frames exceed their block at byte {at}")
    return [*sizes, rest], at


def _block(data: bytes, at: int, end: int, clock: int, cluster: int, scale: int, media: Media, simple: bool) -> None:
    track, n, _ = _number(data, at, False, 8)
    if at + n + 3 > end:
        raise _Broken(f"a block is cut off at byte {at}")
    shift, flags = struct.unpack_from(">hB", data, at + n)
    kind = flags >> 1 & 3
    lengths, first = _lengths(data, at + n + 3, end, kind)
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    name = ("none", "xiph", "fixed", "ebml")[kind]
    start = (clock + shift) * scale
    for k, length in enumerate(lengths):
        media.packets.append(Packet(track, start + k * step, first, length, bool(flags & 0x80) if simple else False, name, cluster))
        first += length


def parse(data: bytes | None) -> Media:
    """The packet table of a file: tracks, timestamps, byte ranges, and the cues.

    Handles variable-length identifiers and sizes, unknown sizes, void and checksum elements,
    SimpleBlocks and BlockGroups, and all four lacings. Null or empty bytes give an empty table; a
    damaged or cut file gives the packets before the damage and an error.
    """
    media, scale = Media(), 1_000_000
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for kind, a, b in _children(data or b"", 0, len(data or b"")):
            if kind != SEGMENT:
                continue
            for part, c, d in _children(data, a, b):
                if part == INFO:
                    scale = next((uint(e, f) for k, e, f in _children(data, c, d) if k == TIMESTAMP_SCALE), scale)
                elif part == TRACKS:
                    for k, e, f in _children(data, c, d):
                        if k == TRACK_ENTRY:
                            own = {k2: (g, h) for k2, g, h in _children(data, e, f)}
                            media.tracks[uint(*own.get(TRACK_NUMBER, (0, 0)))] = {"type": uint(*own.get(TRACK_TYPE, (0, 0))), "codec": data[slice(*own.get(CODEC, (0, 0)))].decode("latin-1"), "frame_ns": uint(*own.get(FRAME_TIME, (0, 0)))}
                elif part == CLUSTER:
                    clock = 0
                    for k, e, f in _children(data, c, d, CLUSTER):
                        if k == TIMESTAMP:
                            clock = uint(e, f)
                        elif k == SIMPLE_BLOCK:
                            _block(data, e, f, clock, c, scale, media, True)
                        elif k == BLOCK_GROUP:
                            for k2, g, h in _children(data, e, f):
                                if k2 == BLOCK:
                                    _block(data, g, h, clock, c, scale, media, False)
                elif part == CUES:
                    for k, e, f in _children(data, c, d):
                        when = {k2: (g, h) for k2, g, h in _children(data, e, f)} if k == CUE_POINT else {}
                        if CUE_TIME in when and CUE_POSITIONS in when:
                            where = {k3: uint(g, h) for k3, g, h in _children(data, *when[CUE_POSITIONS])}
                            media.cues.append((uint(*when[CUE_TIME]) * scale, where.get(CUE_TRACK, 0), a + where.get(CUE_CLUSTER, 0)))
    except _Broken as e:
        media.error = str(e)
    return media


def payload_of(text: str | None, unit: int = FRAME) -> tuple[int, bytes]:
    """A text's UTF-8 length and its bytes filled up with 255 to a positive multiple of unit; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % unit if raw else unit)


def feature(samples: bytes, packets: int) -> str:
    """packets:mean:energy:crossings of 8-bit samples, in whole numbers (mean and energy in thousandths)."""
    wave = np.frombuffer(samples, np.uint8)
    if not len(wave):
        return f"{packets}:0:0:0"
    squares = np.bincount(wave, minlength=256)
    level = np.arange(256, dtype=np.int64) - 128
    high = wave > 127
    return f"{packets}:{int(squares @ level) * 1000 // len(wave)}:{int(squares @ (level * level)) * 1000 // len(wave)}:{int(np.count_nonzero(high[1:] != high[:-1]))}"


PACKETS = "id long, packet int, track int, timestamp_ns long, byte_offset long, byte_length long, keyframe boolean, lacing string, cluster_offset long, error string"


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet of each file; a file without packets has none, a damaged one names its error in each row it still gives. Repeated rows repeat theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = parse(data.as_py())
                rows = [(key, i, p.track, p.timestamp_ns, p.offset, p.length, p.keyframe, p.lacing, p.cluster_offset, m.error) for i, p in enumerate(m.packets)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKETS.split(", ")])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, PACKETS)


def files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: str = "fixed") -> DataFrame:
    """(id, n_bytes, media): each whole text stored as a Matroska file. Null texts are empty, equal texts give equal files, null and repeated ids stay, no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p, lacing) for _, p in made], pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its text stored as Matroska, parsed again, and digests of both.

    The payload is gathered from the byte ranges of the parsed packet table. A null text counts as
    empty (one frame of filling); a null id stays null; repeated rows stay; other columns are ignored.
    """

    def row(text: str | None) -> tuple:
        n, payload = payload_of(text)
        stored = write(payload)
        media = parse(stored)
        if media.error:
            raise ValueError(f"a file just written doesn't parse: {media.error}")
        back = b"".join([stored[p.offset : p.offset + p.length] for p in media.packets])
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, len(media.packets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGEST)
