"""Media columns: Matroska files in a binary column, and their packet tables.

Method. A file is a tree of EBML elements, each a variable-length id, a variable-length size and
data. The reader walks segment, tracks, clusters and cues, undoes Xiph, fixed-size and EBML lacing,
and gives one row per frame with track, timestamp and byte range. The writer stores a payload as
8-bit mono PCM in frames of 576 samples, eight to a laced block, with a cue for each cluster.

Defined results: null text is empty and stored as one frame of padding; bytes that aren't a whole
file raise ValueError naming the place (``packet_table`` gives no rows for a null); repeated rows
give repeated results; a very long text is one file of as many clusters as it takes, and closes its Arrow batch;
an empty table gives no rows; other columns are ignored."""

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

from fleethealth.llm.common import batched, rows_of

FRAME = 576
RATE = 48_000
FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8, 8
#: Element ids of the format.
EBML, SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DEFAULT_DURATION, VOID, CRC_32 = 0x4282, 0x23E383, 0xEC, 0xBF
XIPH, FIXED, EBML_LACING = 1, 2, 3
SCALE = 1_000_000  # nanoseconds of a tick


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; all-ones values are reserved."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Block data after the header for more than one frame."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file with the payload, whose length is a multiple of FRAME, as 8-bit samples."""
    header = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, SCALE))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ticks = FRAME * 1000 // RATE
    body, cues, at = [info, track], [], len(info) + len(track)
    for c in range(0, len(frames), FRAMES_A_BLOCK * BLOCKS_A_CLUSTER):
        blocks = []
        for k, b in enumerate(range(c, min(len(frames), c + FRAMES_A_BLOCK * BLOCKS_A_CLUSTER), FRAMES_A_BLOCK)):
            held = frames[b : b + FRAMES_A_BLOCK]
            kind = (FIXED, EBML_LACING, XIPH)[k % 3] if len(held) > 1 else 0
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (b - c) * ticks, 0x80 | kind << 1) + (lace(held, kind) if kind else held[0])))
        cluster = element(CLUSTER, unsigned(TIMESTAMP, c * ticks) + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, c * ticks) + element(CUE_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    cluster: int
    start: int
    length: int
    keyframe: bool
    lacing: int


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # nanoseconds, track, place of the cluster
    clusters: list[int] = field(default_factory=list)


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int]:
    """Value and next place; ids keep their marker. -1 is an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. An unknown size lasts to a sibling's start or the range's end."""
    while at < end:
        ident, at = _vint(data, at, True)
        size, at = _vint(data, at, False)
        stop = at + size if size >= 0 else _unknown_end(data, ident, at, end)
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} runs over its parent")
        yield ident, at, stop
        at = stop


def _unknown_end(data: bytes, ident: int, at: int, end: int) -> int:
    while ident == CLUSTER and at < end:
        child, then = _vint(data, at, True)
        if child in (CLUSTER, CUES, TRACKS, INFO):
            return at
        size, then = _vint(data, then, False)
        at = then + max(size, 0)
    return end


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def read(data: bytes) -> Media:
    """Packets, tracks and cues of a file."""
    out, scale = Media(), SCALE
    for top, a, b in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for ident, c, d in elements(data, a, b):
            if ident == INFO:
                scale = next((_uint(data, x, y) for i, x, y in elements(data, c, d) if i == TIMESTAMP_SCALE), scale)
            elif ident == TRACKS:
                for _, x, y in elements(data, c, d):
                    fields = {i: (s, e) for i, s, e in elements(data, x, y)}
                    if TRACK_NUMBER in fields:
                        out.tracks[_uint(data, *fields[TRACK_NUMBER])] = {"codec": data[slice(*fields.get(CODEC_ID, (0, 0)))].decode(), "default_ns": _uint(data, *fields.get(DEFAULT_DURATION, (0, 0)))}
            elif ident == CLUSTER:
                out.clusters.append(c)
                _cluster(data, c, d, a, scale, out)
            elif ident == CUES:
                for point, x, y in elements(data, c, d):
                    if point == CUE_POINT:
                        fields = {i: (s, e) for i, s, e in elements(data, x, y)}
                        inner = {i: _uint(data, s, e) for i, s, e in elements(data, *fields[CUE_POSITIONS])}
                        out.cues.append((_uint(data, *fields[CUE_TIME]) * scale, inner[CUE_TRACK], a + inner[CUE_CLUSTER]))
    return out


def _cluster(data: bytes, a: int, b: int, segment: int, scale: int, out: Media) -> None:
    base = 0
    for ident, c, d in elements(data, a, b):
        if ident == TIMESTAMP:
            base = _uint(data, c, d)
        elif ident == SIMPLE_BLOCK:
            _block(data, c, d, base, scale, a, bool(data[_vint(data, c, False)[1] + 2] & 0x80), out)
        elif ident == BLOCK_GROUP:
            inside = list(elements(data, c, d))
            for i, x, y in inside:
                if i == BLOCK:
                    _block(data, x, y, base, scale, a, all(j != 0xFB for j, _, _ in inside), out)  # 0xFB refers to another block


def _block(data: bytes, at: int, end: int, base: int, scale: int, cluster: int, key: bool, out: Media) -> None:
    track, at = _vint(data, at, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, kind = at + 3, flags >> 1 & 3
    if not kind:
        sizes = [end - at]
    else:
        count, at = data[at] + 1, at + 1
        sizes = []
        if kind == FIXED:
            if (end - at) % count:
                raise ValueError(f"uneven lacing at byte {at}")
            sizes = [(end - at) // count] * count
        elif kind == XIPH:
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        else:
            for k in range(count - 1):
                width = 9 - data[at].bit_length()
                n, at = _vint(data, at, False)
                sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * width - 1) - 1))
        if kind != FIXED:
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError(f"bad lacing before byte {at}")
    step = out.tracks.get(track, {}).get("default_ns", 0)
    for k, n in enumerate(sizes):
        out.packets.append(Packet(track, (base + relative) * scale + k * step, cluster, at, n, key, kind))
        at += n


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and those with 255s up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

        def each():
            for doc_id, text in rows_of(batches):
                n, payload = padded(text)
                yield doc_id, n, write_pcm(payload)

        yield from batched(each(), schema, 500)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_PACKET_FIELDS = "doc_id long, packet int, track int, timestamp_ns long, cluster_start long, start long, length int, keyframe boolean, lacing int, cue_ns long"


def packet_table(media: DataFrame) -> DataFrame:
    """One row per frame of the ``media`` column, with the last cue that leads to its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
        schema = pa.schema([(f.split()[0], k) for f, k in zip(_PACKET_FIELDS.split(", "), kinds, strict=True)])

        def each():
            for doc_id, data in rows_of(batches):
                found = read(data) if data is not None else Media()
                cue = {c: max((ns for ns, _, at in found.cues if at <= c), default=None) for c in found.clusters}
                for k, p in enumerate(found.packets):
                    yield doc_id, k, p.track, p.timestamp_ns, p.cluster, p.start, p.length, p.keyframe, p.lacing, cue[p.cluster]

        yield from batched(each(), schema, 5000)

    return media.select("doc_id", "media").mapInArrow(run, _PACKET_FIELDS)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(data: bytes, found: Media, payload: bytes) -> str:
    """Packets, clusters, lacings, duration and the signal's mean and deviation from its mid value."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    laced = [sum(p.lacing == k for p in found.packets) for k in range(4)]
    last = max((p.timestamp_ns for p in found.packets), default=0) + next(iter(found.tracks.values()), {}).get("default_ns", 0)
    return f"packets={len(found.packets)};clusters={len(found.clusters)};cues={len(found.cues)};lacing={'/'.join(map(str, laced))};ms={last // 1_000_000};sum={int(x.sum())};energy={int((x * x).sum())}"


def read_column(media: DataFrame) -> DataFrame:
    """Payload digests and features of each file, from its packets' byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for doc_id, n, data in rows_of(batches):
                found = read(data)
                payload = b"".join(data[p.start : p.start + p.length] for p in found.packets)
                yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(data, found, payload)

        yield from batched(each(), _DIGESTS, 5000)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
