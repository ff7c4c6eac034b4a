"""Matroska: EBML elements, clusters, lacing and cues, read into packet tables; and a writer for one PCM track.

read() walks the element tree of a file by its variable-length ids and sizes and returns tracks, cues and one packet
for each frame: track, timestamp, position in its block's lacing, and byte range. Sizes may be unknown for segments and
clusters; unknown elements are skipped.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, DURATION, MUXER, WRITER = 0x4282, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, FRAME_NS = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, TRACKS, TRACK, AUDIO, INFO, CLUSTER, GROUP, CUES, CUE, CUE_PLACE}
#: Elements that end a cluster or segment of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


def element_id(data: bytes, at: int) -> tuple[int, int]:
    """An element's id, with its length marker, and where it ends."""
    if at >= len(data) or not (n := 9 - data[at].bit_length()) <= 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def number(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length number without its marker, None if all bits are set (unknown), and where it ends."""
    if at >= len(data) or (n := 9 - data[at].bit_length()) > 8 or at + n > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    x = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if x == (1 << 7 * n) - 1 else x), at + n


def vint(x: int, n: int = 0) -> bytes:
    n = n or next(k for k in range(1, 9) if x < (1 << 7 * k) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    #: (track, timestamp in ns, frame's place in its block, number of frames in the block, lacing, keyframe, first byte, size)
    packets: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's body; kind: 0 none, 1 Xiph, 2 fixed-size, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("lacing without a frame count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("frames of fixed size don't fill the block")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while True:
                    size, at, more = size + data[at], at + 1, data[at] == 255
                    if not more:
                        break
            else:
                start = at
                size, at = number(data, at)
                if k:
                    size = sizes[-1] + size - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("a lace passes the end of its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read(data: bytes) -> Media:
    """The packet table of a whole file; an empty file has no packets. Raises ValueError where the file is malformed."""
    m = Media()
    segment = 0

    def block(at: int, end: int, base: int, key: bool | None) -> list:
        track, at = number(data, at)
        if at + 3 > end:
            raise ValueError("a block without a header")
        rel, flags = struct.unpack(">hB", data[at : at + 3])
        kind = flags >> 1 & 3
        frames = lace(data, at + 3, end, kind)
        key = bool(flags & 128) if key is None else key
        return [[track, (base + rel) * m.scale, k, len(frames), kind, key, lo, n] for k, (lo, n) in enumerate(frames)]

    def walk(at: int, end: int, inside: int, into: dict) -> int:
        nonlocal segment
        while at < end:
            start = at
            kind, at = element_id(data, at)
            size, at = number(data, at)
            if size is None and inside == CLUSTER and kind in TOP:
                return start
            if kind in TOP and inside == CLUSTER:  # the cluster's size was unknown
                return start
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"the element at byte {start} passes the end of its parent")
            if size is None and kind not in (SEGMENT, CLUSTER):
                raise ValueError(f"the element at byte {start} has no size")
            if kind == SEGMENT:
                segment = at
            if kind == CLUSTER:
                m.clusters.append(start - segment)
            body = lambda: int.from_bytes(data[at:stop], "big")  # noqa: B023, E731
            if kind == EBML or kind in MASTERS:
                own: dict = {} if kind != CUE_PLACE else into
                stop = walk(at, stop, kind, own)
                if kind == TRACK:
                    m.tracks.append(own)
                elif kind == AUDIO:
                    into.update(own)
                elif kind == CUE:
                    m.cues.append(own)
                elif kind == EBML:
                    m.doc_type = own.get("doc_type", "")
                elif kind == GROUP and "packets" in own:
                    for p in own["packets"]:
                        p[5] = not own.get("reference", False)
                    m.packets += map(tuple, block_base(own["packets"], into))
            elif kind in (SIMPLE, BLOCK):
                if kind == SIMPLE:
                    m.packets += map(tuple, block_base(block(at, stop, 0, None), into))
                else:
                    into["packets"] = block(at, stop, 0, True)
            elif kind == TIME:
                into["time"] = body()
            elif kind == SCALE:
                m.scale = body()
            elif kind == REFERENCE:
                into["reference"] = True
            elif kind == DOC_TYPE:
                into["doc_type"] = data[at:stop].rstrip(b"\0").decode("ascii", "replace")
            elif kind == CODEC:
                into["codec"] = data[at:stop].rstrip(b"\0").decode("ascii", "replace")
            elif kind == RATE:
                into["rate"] = struct.unpack(">f" if stop - at == 4 else ">d", data[at:stop])[0] if stop - at in (4, 8) else 0.0
            elif kind in (NUMBER, TYPE, CHANNELS, DEPTH, FRAME_NS, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                into[{NUMBER: "number", TYPE: "type", CHANNELS: "channels", DEPTH: "depth", FRAME_NS: "frame_ns", CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[kind]] = body()
            at = stop
        return at

    def block_base(packets: list, cluster: dict) -> list:
        for p in packets:
            p[1] += cluster.get("time", 0) * m.scale
        return packets

    walk(0, len(data), 0, {})
    # Laced frames follow one another by the track's frame duration.
    step = {t.get("number"): t.get("frame_ns", 0) for t in m.tracks}
    m.packets = [(t, ts + k * step.get(t, 0), *rest) for t, ts, k, *rest in ((p[0], p[1], p[2], p[2], *p[3:]) for p in m.packets)]
    return m


def write(samples: bytes, frame: int = 576, rate: int = 48_000, frames_per_block: int = 8, blocks_per_cluster: int = 32) -> bytes:
    """A file with samples as one track of 8-bit PCM, in frames of `frame` samples, laced with a fixed size. The last
    block may have fewer frames; samples must be a positive multiple of frame."""
    if not samples or len(samples) % frame:
        raise ValueError(f"{len(samples)} samples aren't a positive multiple of {frame}")
    ns = frame * 1_000_000_000 // rate
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    frames = len(samples) // frame
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * ns / 1e6)) + element(MUXER, b"tickforge") + element(WRITER, b"tickforge"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(rate))) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(FRAME_NS, ns) + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    per = frames_per_block * blocks_per_cluster
    for first in range(0, frames, per):
        base = first * ns // 1_000_000
        parts = [uint(TIME, base)]
        for k in range(first, min(first + per, frames), frames_per_block):
            n = min(frames_per_block, frames - k)
            body = samples[k * frame : (k + n) * frame]
            start = vint(1) + struct.pack(">hB", k * ns // 1_000_000 - base, 128 | (4 if n > 1 else 0)) + (bytes([n - 1]) if n > 1 else b"")
            parts.append(element(SIMPLE, start + body))
        cues.append(element(CUE, uint(CUE_TIME, base) + element(CUE_PLACE, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        clusters.append(element(CLUSTER, b"".join(parts)))
        at += len(clusters[-1])
    return head + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


PACKETS = "track long, timestamp_ns long, lace_index int, lace_count int, lacing int, keyframe boolean, byte_start long, byte_size long"


def packets(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """The packet table of the files in a binary column: key and a row for each packet, with error (null unless the file
    is malformed, which then has that one row). Null and empty files have no row."""
    names = [c.split()[0] for c in PACKETS.split(", ")]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                rows, of = [], []
                for i, data in enumerate(b.column(1).to_pylist()):
                    try:
                        got = [(*p, None) for p in read(data or b"").packets]
                    except (ValueError, IndexError) as e:
                        got = [(*[None] * len(names), str(e))]
                    rows += got
                    of += [i] * len(got)
                cols = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, *names, "error"])

    return df.select(key, F.col(media).cast("binary").alias("\x00media")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {PACKETS}, error string")


def store_texts(df: DataFrame, frame: int = 576) -> DataFrame:
    """doc_id and media (binary): each text of (doc_id, text) in UTF-8 as samples of a file; null counts as empty. Bytes
    255, that UTF-8 never has, fill up to a positive multiple of frame."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([write(padded(x or b"", frame), frame) for x in texts_of(b.column(1))], pa.binary())], names=["doc_id", "media"])

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, media binary")


def padded(x: bytes, frame: int) -> bytes:
    return x + b"\xff" * (-len(x) % frame or (0 if x else frame))


def samples_of(data: bytes, m: Media, track: int = 1) -> bytes:
    return b"".join(data[p[6] : p[6] + p[7]] for p in m.packets if p[0] == track)


def features(samples: bytes, m: Media) -> str:
    """A track's shape and the level of its samples as JSON."""
    t = m.tracks[0] if m.tracks else {}
    x = np.frombuffer(samples, np.uint8)
    tally = np.bincount(x, minlength=256)
    mean = float(tally @ np.arange(256)) / len(x)
    mean_square = float(tally @ (np.arange(256) ** 2)) / len(x)
    return json.dumps({
        "codec": t.get("codec"), "rate": int(t.get("rate", 0)), "depth": t.get("depth"), "packets": len(m.packets), "clusters": len(m.clusters), "cues": len(m.cues),
        "last_ns": m.packets[-1][1] if m.packets else None, "mean": round(mean, 6), "deviation": round(max(0.0, mean_square - mean * mean) ** 0.5, 6), "peak": int(x.max(initial=0)),
    }, separators=(",", ":"))


def stored_features(df: DataFrame, frame: int = 576) -> DataFrame:
    """Stores each text of (doc_id, text) as store_texts() does, reads the file back by its packet table, and returns
    digests: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null text is
    stored like an empty one, equal texts alike; a repeated row gives a repeated result, an empty table an empty one."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in texts_of(b.column(1)):
            media = write(padded(x or b"", frame), frame)
            m = read(media)
            back = samples_of(media, m)
            out.append((len(x or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back, m)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return map_batches(
        df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        fn,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
