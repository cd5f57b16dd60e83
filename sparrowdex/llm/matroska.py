"""Media columns in Matroska (operator 6).

Bytes are stored as 8-bit PCM samples of one audio track: an EBML header, then a segment with info,
tracks, clusters of laced simple blocks, and cues. Reading parses variable-length EBML elements
(unknown sizes, void and unknown elements too), clusters, simple blocks and block groups with Xiph,
fixed-size and EBML lacing, and cues, and gives a packet table: track, time, byte range in the file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Element ids of the container format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CODEC, SAMPLE_RATE, SCALE_NS = b"A_PCM/INT/LIT", 8000, 1_000_000
#: Samples of a frame (64 ms), frames of a block, blocks of a cluster.
FRAME, LACED, BLOCKS = 512, 8, 64
#: Payloads are padded to a multiple of this many bytes.
UNIT = 64
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}


class Packet(NamedTuple):
    track: int
    time_ns: int
    start: int
    size: int
    keyframe: bool


class Media(NamedTuple):
    tracks: dict
    packets: list
    clusters: int
    cues: list


def vint(n: int) -> bytes:
    """A size of as few bytes as hold it; all ones is kept for the unknown size."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def signed_vint(n: int) -> bytes:
    """A difference of frame sizes in EBML lacing."""
    length = 1
    while not -(1 << 7 * length - 1) < n < 1 << 7 * length - 1:
        length += 1
    return (n + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block_body(track: int, time: int, frames: list[bytes]) -> bytes:
    """The body of a simple block; equal frames get fixed-size lacing, others EBML lacing."""
    head = vint(track) + time.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    steps = vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-1], sizes[1:-1]))
    return head + b"\x86" + bytes([len(frames) - 1]) + steps + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """Samples as a Matroska file."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, SCALE_NS) + element(DURATION, np.array(len(samples) * 1000 / SAMPLE_RATE, ">f8").tobytes()) + element(MUXING_APP, b"sparrowdex") + element(WRITING_APP, b"sparrowdex"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(SAMPLE_RATE, ">f4").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, CODEC) + number(DEFAULT_DURATION, FRAME * 10**9 // SAMPLE_RATE) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues, per_block = sum(map(len, parts)), [], FRAME * LACED
    for first in range(0, len(samples), per_block * BLOCKS):
        time = first * 1000 // SAMPLE_RATE
        blocks = []
        for start in range(first, min(first + per_block * BLOCKS, len(samples)), per_block):
            stop = min(start + per_block, len(samples))
            frames = [samples[i : min(i + FRAME, stop)] for i in range(start, stop, FRAME)]
            blocks.append(element(SIMPLE_BLOCK, block_body(1, start * 1000 // SAMPLE_RATE - time, frames)))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, number(TIMESTAMP, time) + b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """A variable-length number: value, place after it, its length in bytes."""
    if at >= len(data):
        raise ValueError(f"no number at byte {at}")
    length = 9 - data[at].bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    return (value if keep_marker else value ^ 1 << 7 * length), at + length, length


def demux(data: bytes) -> Media:
    """Tracks, packets, the number of clusters, and cues (time, track, byte of the cluster)."""
    kind, body, size_at, stop = None, 0, 0, 0
    kind, at, _ = read_vint(data, 0, True)
    size, body, _ = read_vint(data, at)
    if kind != EBML:
        raise ValueError("no EBML header")
    tracks, packets, cues, clusters = {}, [], [], 0
    scale, base, segment = SCALE_NS, 0, 0
    stack, at = [], body + size  # (kind, end, values)

    def closed(kind: int, values: dict) -> None:
        if kind == TRACK_ENTRY:
            tracks[values[TRACK_NUMBER]] = values
        elif kind == AUDIO and stack:
            stack[-1][2].update(values)
        elif kind == CUE_TRACK_POSITIONS and stack:
            cues.append((stack[-1][2].get(CUE_TIME, 0), values.get(CUE_TRACK, 0), segment + values[CUE_CLUSTER_POSITION]))

    while at < len(data) or stack:
        while stack and (at >= stack[-1][1] or at >= len(data)):
            kind, _, values = stack.pop()
            closed(kind, values)
        if at >= len(data):
            continue
        kind, size_at, _ = read_vint(data, at, True)
        size, body, length = read_vint(data, size_at)
        unknown = size == (1 << 7 * length) - 1
        if kind in _TOP:  # ends a cluster of unknown size
            while stack and stack[-1][0] != SEGMENT:
                closed(*(lambda x: (x[0], x[2]))(stack.pop()))
        stop = (stack[-1][1] if stack else len(data)) if unknown else body + size
        if stop > len(data):
            raise ValueError(f"element at byte {at} is cut off")
        if kind in _MASTERS:
            if kind == SEGMENT:
                segment = body
            clusters += kind == CLUSTER
            stack.append((kind, stop, {}))
            at = body
            continue
        raw, values = data[body:stop] if kind not in (SIMPLE_BLOCK, BLOCK) else b"", stack[-1][2] if stack else {}
        if kind in (SIMPLE_BLOCK, BLOCK):
            packets += block_packets(data, body, stop, base, scale, tracks, kind == SIMPLE_BLOCK)
        elif kind == CODEC_ID:
            values[kind] = raw
        elif kind in (SAMPLING_FREQUENCY, DURATION):
            values[kind] = float(np.frombuffer(raw, ">f4" if len(raw) == 4 else ">f8")[0])
        elif len(raw) <= 8:
            values[kind] = int.from_bytes(raw, "big")
            if kind == TIMESTAMP:
                base = values[kind]
            elif kind == TIMESTAMP_SCALE:
                scale = values[kind]
        at = stop
    return Media(tracks, packets, clusters, cues)


def block_packets(data: bytes, at: int, stop: int, base: int, scale: int, tracks: dict, simple: bool) -> list[Packet]:
    """The frames of a block, each with its time and byte range."""
    track, at, _ = read_vint(data, at)
    time, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    sizes = []
    if lacing:
        frames = data[at] + 1
        at += 1
        if lacing == 1:  # Xiph: sums of bytes up to the first below 255
            for _ in range(frames - 1):
                n = 0
                while data[at] == 255:
                    n += 255
                    at += 1
                sizes.append(n + data[at])
                at += 1
        elif lacing == 3:  # EBML: a size, then differences
            for i in range(frames - 1):
                n, at, length = read_vint(data, at)
                sizes.append(n if not i else sizes[-1] + n - (1 << 7 * length - 1) + 1)
        else:
            if (stop - at) % frames:
                raise ValueError("frames of a fixed-size lace differ")
            sizes = [(stop - at) // frames] * (frames - 1)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    step, out = tracks.get(track, {}).get(DEFAULT_DURATION, 0), []
    for i, n in enumerate(sizes):
        out.append(Packet(track, (base + time) * scale + i * step, at, n, bool(flags & 128) or not simple))
        at += n
    return out


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's padded bytes as a Matroska file. A null text counts as empty; an
    empty text is stored as 64 zero bytes. Rows are taken one by one, so repeated rows give equal files."""
    common.small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(payload(t)) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(work, f"{id_col} {id_type}, n_bytes long, media binary")


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet: id, packet, track, time_ns, start, size, keyframe, cluster_cued. Null media have no packets."""
    common.small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, data in zip(batch.column(0), batch.column(1).to_pylist()):
                if data is None:
                    continue
                found, times = (m := demux(data)).packets, None
                times = {t * SCALE_NS for t, _, _ in m.cues}
                yield pa.RecordBatch.from_arrays([pa.array([one.as_py()] * len(found), batch.column(0).type), pa.array(range(len(found)), pa.int64()), *(pa.array([p[i] for p in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))), pa.array([p.time_ns in times for p in found], pa.bool_())], [id_col, "packet", "track", "time_ns", "start", "size", "keyframe", "cued"])

    return df.select(id_col, media_col).mapInArrow(work, f"{id_col} {id_type}, packet long, track long, time_ns long, start long, size long, keyframe boolean, cued boolean")


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read stored media back by their packet tables: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. Null media give null values."""
    common.small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def measured(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        media = demux(data)
        samples = b"".join([data[p.start : p.start + p.size] for p in media.packets])
        level = np.frombuffer(samples, np.uint8)
        total, squares = int(level.sum(dtype=np.int64)), int((level.astype(np.uint32) ** 2).sum(dtype=np.int64))
        crossings = int(np.count_nonzero(np.diff(level >= 128)))
        rate = media.tracks[1][SAMPLING_FREQUENCY]
        feature = f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};last_ms={media.packets[-1].time_ns // SCALE_NS};rate={rate:.0f};sum={total};squares={squares};crossings={crossings};peak={int(level.max())}"
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(d) for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, "n_bytes", *names])

    return df.select(id_col, "n_bytes", media_col).mapInArrow(work, f"{id_col} {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_matroska(spark, sf_dir):
    return media_features(to_media(common.table(spark, sf_dir, "documents")))
