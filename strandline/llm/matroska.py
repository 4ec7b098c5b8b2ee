"""Matroska: EBML elements with variable-length ids and sizes, clusters, the three kinds of lacing, and cues.

``mux`` makes a container of fixed-size frames of 8-bit samples; ``demux`` reads any container of one segment into a
packet table (track, timestamp, keyframe, byte range). ``store`` and ``packets`` / ``restore`` do it for columns.
"""

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

#: Bytes in a frame: 72 ms of 8000 samples a second.
FRAME = 576
FRAME_MS = 72
RATE = 8000.0
LACED = 8
CLUSTERED = 256
PAD = b"\xff"

# Element ids as the Matroska specification fixes them.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1


def _size(n: int) -> bytes:
    """A size as the shortest variable-length integer; all ones are reserved for an unknown size."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)
#: Lacing bits of a block's flags.
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 2, 4, 6


def lace(frames: list[bytes], kind: int) -> bytes:
    """The frames of one block with the lacing head of ``kind``."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == EBML_LACING:
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            step = len(b) - len(a)
            length = 1
            while not -(1 << 7 * length - 1) < step < (1 << 7 * length - 1):
                length += 1
            head += (step + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def mux(payload: bytes, lacing: int = FIXED) -> bytes:
    """A container whose frames are the FRAME-byte pieces of ``payload`` (a positive multiple of FRAME)."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of the frame size")
    frames, laced = len(payload) // FRAME, 1 if lacing == NO_LACING else LACED
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"strandline") + _element(WRITING_APP, b"strandline") + _element(DURATION, struct.pack(">d", float(frames * FRAME_MS))))
    parts, cues = [info, _TRACKS], []
    at = len(info) + len(_TRACKS)
    for first in range(0, frames, CLUSTERED):
        last = min(first + CLUSTERED, frames)
        blocks = [_uint(TIMESTAMP, first * FRAME_MS)]
        for b in range(first, last, laced):
            n = min(laced, last - b)
            kind = NO_LACING if n == 1 else lacing
            head = b"\x81" + struct.pack(">hB", (b - first) * FRAME_MS, 0x80 | kind)
            if kind == FIXED:
                body = bytes([n - 1]) + payload[b * FRAME : (b + n) * FRAME]
            else:
                body = lace([payload[k * FRAME : (k + 1) * FRAME] for k in range(b, b + n)], kind)
            blocks.append(_element(SIMPLE_BLOCK, head + body))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * FRAME_MS) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a container holds. packets: (track, timestamp in ms, keyframe, first byte, bytes); cues: (ms, track, first byte of the cluster)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _vint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer and its length; -1 if it is the reserved unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"an integer at {at} is cut short")
    n = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (-1 if n == (1 << 7 * length) - 1 else n), length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, byte after the last) of each element's content; an unknown size reaches to ``end``."""
    while at < end:
        if not data[at] >> 4:
            raise ValueError(f"no element id at {at}")
        length = 9 - data[at].bit_length()
        kind = int.from_bytes(data[at : at + length], "big")
        n, more = _vint(data, at + length)
        at += length + more
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"the element {kind:X} at {at} is cut short")
        yield kind, at, stop
        at = stop


def _laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of each frame of a block whose frames begin at ``at``."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("a fixed-size lace doesn't divide evenly")
        return [(at + k * each, each) for k in range(n)]
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, length = _vint(data, at)
        sizes, at = [size], at + length
        for _ in range(n - 2):
            step, length = _vint(data, at)
            step = (1 << 7 * length) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << 7 * length - 1) - 1))
            at += length
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Media:
    """Read a container; a ValueError says what is wrong with one that can't be read."""
    media = Media()
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0

    def block(a: int, b: int, time: int, group_key: bool | None) -> None:
        track, length = _vint(data, a)
        relative, flags = struct.unpack_from(">hB", data, a + length)
        key = bool(flags & 0x80) if group_key is None else group_key
        step = media.tracks.get(track, {}).get("frame_ns", 0)
        for k, (at, size) in enumerate(_laced(data, a + length + 3, b, flags & 6)):
            media.packets.append((track, ((time + relative) * media.scale + k * step) // 1_000_000, key, at, size))

    for kind, start, stop in top:
        if kind != SEGMENT:
            continue
        for child, a, b in elements(data, start, stop):
            if child == INFO:
                for k, c, d in elements(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        media.scale = number(c, d)
                    elif k == DURATION:
                        media.duration = real(c, d)
            elif child == TRACKS:
                for k, c, d in elements(data, a, b):
                    if k != TRACK_ENTRY:
                        continue
                    track = {"frame_ns": 0}
                    for x, e, f in elements(data, c, d):
                        if x in (TRACK_NUMBER, TRACK_TYPE):
                            track["number" if x == TRACK_NUMBER else "type"] = number(e, f)
                        elif x == CODEC_ID:
                            track["codec"] = data[e:f].decode("ascii", "replace")
                        elif x == DEFAULT_DURATION:
                            track["frame_ns"] = number(e, f)
                        elif x == AUDIO:
                            for y, g, h in elements(data, e, f):
                                if y == SAMPLING_FREQUENCY:
                                    track["rate"] = real(g, h)
                                elif y in (CHANNELS, BIT_DEPTH):
                                    track["channels" if y == CHANNELS else "bits"] = number(g, h)
                    media.tracks[track.get("number", 0)] = track
            elif child == CLUSTER:
                time = 0
                media.clusters.append(a)
                for k, c, d in elements(data, a, b):
                    if k == TIMESTAMP:
                        time = number(c, d)
                    elif k == SIMPLE_BLOCK:
                        block(c, d, time, None)
                    elif k == BLOCK_GROUP:
                        inner = list(elements(data, c, d))
                        refers = any(x == REFERENCE_BLOCK for x, _, _ in inner)
                        for x, e, f in inner:
                            if x == BLOCK:
                                block(e, f, time, not refers)
            elif child == CUES:
                for k, c, d in elements(data, a, b):
                    if k != CUE_POINT:
                        continue
                    when, spots = 0, []
                    for x, e, f in elements(data, c, d):
                        if x == CUE_TIME:
                            when = number(e, f)
                        elif x == CUE_TRACK_POSITIONS:
                            spot = {y: number(g, h) for y, g, h in elements(data, e, f)}
                            spots.append((spot.get(CUE_TRACK, 0), start + spot.get(CUE_CLUSTER_POSITION, 0)))
                    media.cues += [(when * media.scale // 1_000_000, t, p) for t, p in spots]
    return media


def payload_of(data: bytes, media: Media) -> bytes:
    return b"".join([data[at : at + n] for _, _, _, at, n in media.packets])


def padded(raw: bytes) -> bytes:
    """``raw`` with PAD up to a positive multiple of FRAME."""
    return raw + PAD * (-len(raw) % FRAME if raw else FRAME)


def feature(payload: bytes, media: Media) -> str:
    """A short digest of packets and samples: counts, duration, mean and mean square of the samples and of their steps."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    step = np.diff(samples)
    n = max(1, len(samples))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={int(media.duration)};mean={int(samples.sum()) / n:.4f};power={int((samples * samples).sum()) / n:.4f};change={int((step * step).sum()) / n:.4f}"


_SLICE = 4 << 20  # bytes of media that a task gives out at once


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8, padded, in a container. Null and empty texts are a frame of padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            first, held, sizes, media = 0, 0, [], []
            for k in range(len(texts)):
                raw = texts[k].as_py() or b""
                sizes.append(len(raw))
                media.append(mux(padded(raw)))
                held += len(media[-1])
                if held >= _SLICE or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    first, held, sizes, media = k + 1, 0, [], []

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary")


def packets(stored: DataFrame) -> DataFrame:
    """The packet table of stored media: (id, packet, track, ms, keyframe, byte, bytes); one row a packet, in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = demux(batch.column("media")[k].as_py()).packets
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("id")[k].as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                    ["id", "packet", "track", "ms", "keyframe", "byte", "bytes"],
                )

    return stored.select("id", "media").mapInArrow(run, "id long, packet int, track int, ms long, keyframe boolean, byte long, bytes long")


def restore(stored: DataFrame) -> DataFrame:
    """Stored media read back: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    tail_crc32 is of the last 32 bytes of the payload. Equal media give equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column("media"):
                data = item.as_py()
                media = demux(data)
                payload = payload_of(data, media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, media)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return stored.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
