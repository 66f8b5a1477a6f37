"""Media columns: Matroska files of 8-bit samples, and packet tables parsed from them.

The parser reads variable-length EBML elements (identifiers and sizes, unknown
sizes included), clusters with their timestamps, simple blocks and block groups
with no, Xiph, fixed-size or EBML lacing, and cues, into packets: track,
timestamp, offset and size of the packet's bytes in the file.

The writer makes deterministic files (no dates, no random identifiers): a PCM
track whose frames of FRAME samples are laced into blocks, blocks into clusters,
and a cue for each cluster. A text's bytes are padded with 255, which UTF-8 never
holds, to a positive multiple of FRAME.

Null and empty texts make one frame of padding; very long texts make a file of as
many clusters as they need, one file at a time. Broken or foreign bytes raise
ValueError in parse(); in packets() they make no rows. Equal texts make equal
files; repeated rows each get their row; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, each_text, session

FRAME, RATE = 576, 8000
LACED, BLOCKS = 8, 32
#: Element identifiers.
EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NUMBER, UID, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH, SCALE, DURATION, LACING = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x2AD7B1, 0x23E383, 0x9C
_VERSION, _READ_VERSION, _ID_LENGTH, _SIZE_LENGTH, _DOC, _DOC_VERSION, _DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
_UNKNOWN = -1


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place behind it; keep leaves the length marker in (identifiers)."""
    if at >= len(data) or not data[at]:
        raise ValueError("no variable-length integer")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("cut variable-length integer")
    value = int.from_bytes(data[at : at + n], "big")
    if not keep:
        value -= 1 << 7 * n
        if value == (1 << 7 * n) - 1:
            value = _UNKNOWN
    return value, at + n


def as_vint(value: int, size: int = 0) -> bytes:
    n = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(identifier: int, body: bytes) -> bytes:
    return identifier.to_bytes((identifier.bit_length() + 7) // 8, "big") + as_vint(len(body)) + body


def number(identifier: int, value: int) -> bytes:
    return element(identifier, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int, track: int, when: int, key: bool = True) -> bytes:
    """A simple block's body; lacing 0 none, 1 Xiph, 2 fixed-size, 3 EBML."""
    head = as_vint(track) + when.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])
    if not lacing:
        return head + frames[0]
    sizes = [len(x) for x in frames]
    head += bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:
        head += as_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1))
            head += as_vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def _unlace(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, key flag, and (offset, size) of the frames of a block."""
    track, at = vint(data, at)
    if at + 3 > end:
        raise ValueError("cut block")
    when, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, when, bool(flags & 0x80), [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("uneven fixed-size lacing")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == 1:
                n = 0
                while data[at] == 255:
                    n += 255
                    at += 1
                n += data[at]
                at += 1
            elif k == 0:
                n, at = vint(data, at)
            else:
                begin = at
                n, at = vint(data, at)
                if n == _UNKNOWN:
                    n = (1 << 7 * (at - begin)) - 1
                n += sizes[-1] - (1 << 7 * (at - begin) - 1) + 1
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("broken lacing")
    frames = []
    for n in sizes:
        frames.append((at, n))
        at += n
    return track, when, bool(flags & 0x80), frames


@dataclass
class Media:
    """What a file holds: packets are (track, timestamp in ms, offset, size, key frame)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000


_MASTERS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {CLUSTER, CUES, INFO, TRACKS}


def parse(data: bytes) -> Media:
    """The packet table and cues of a Matroska file."""
    out = Media()
    head, at = vint(data, 0, keep=True)
    if head != EBML:
        raise ValueError("not an EBML file")
    size, at = vint(data, at)
    at += size
    stack: list[tuple[int, int]] = []  # open masters: identifier, end
    segment = cluster_time = 0
    track: dict = {}
    cue: dict = {}
    while True:
        while stack and at >= stack[-1][1]:
            kind, _ = stack.pop()
            if kind == ENTRY:
                out.tracks[track.get("number", 0)] = track
            elif kind == CUE_POINT:
                out.cues.append((cue.get("time", 0), cue.get("track", 0), cue.get("cluster", 0)))
        if at >= len(data):
            return out
        begin = at
        kind, at = vint(data, at, keep=True)
        size, at = vint(data, at)
        end = len(data) if size == _UNKNOWN else at + size
        if end > len(data):
            raise ValueError("an element goes beyond the file")
        if kind in _TOP:  # ends a cluster of unknown size
            while stack and stack[-1][0] not in (SEGMENT,):
                stack.pop()
        if kind in _MASTERS:
            stack.append((kind, end))
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                out.clusters.append(begin - segment)
            elif kind == ENTRY:
                track = {"lacing": 1}
            elif kind == CUE_POINT:
                cue = {}
            continue
        body = data[at:end]
        if kind in (SIMPLE_BLOCK, BLOCK):
            number_, when, key, frames = _unlace(data, at, end)
            step = out.tracks.get(number_, {}).get("step", 0)
            start = (cluster_time + when) * out.scale // 1_000_000
            out.packets += [(number_, start + k * step, o, n, key) for k, (o, n) in enumerate(frames)]
        elif kind == TIMESTAMP:
            cluster_time = int.from_bytes(body, "big")
        elif kind == SCALE:
            out.scale = int.from_bytes(body, "big")
        elif kind == NUMBER:
            track["number"] = int.from_bytes(body, "big")
        elif kind == CODEC:
            track["codec"] = body.decode()
        elif kind == DURATION:
            track["step"] = int.from_bytes(body, "big") // 1_000_000
        elif kind == CUE_TIME:
            cue["time"] = int.from_bytes(body, "big")
        elif kind == CUE_TRACK:
            cue["track"] = int.from_bytes(body, "big")
        elif kind == CUE_CLUSTER:
            cue["cluster"] = int.from_bytes(body, "big")
        at = end


_HEAD = element(EBML, number(_VERSION, 1) + number(_READ_VERSION, 1) + number(_ID_LENGTH, 4) + number(_SIZE_LENGTH, 8) + element(_DOC, b"matroska") + number(_DOC_VERSION, 4) + number(_DOC_READ, 2))
_STEP = FRAME * 1000 // RATE
_SETUP = element(INFO, number(SCALE, 1_000_000)) + element(
    TRACKS,
    element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DURATION, _STEP * 1_000_000) + element(AUDIO, element(FREQUENCY, bytes.fromhex("45fa0000")) + number(CHANNELS, 1) + number(DEPTH, 8))),
)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or FRAME * (not text))


def write(payload: bytes, lacing: int = 2) -> bytes:
    """A file with the payload as frames of FRAME samples; lacing as in laced()."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    parts, cues, at = [_SETUP], [], len(_SETUP)
    for c in range(0, len(frames), LACED * BLOCKS):
        own = frames[c : c + LACED * BLOCKS]
        body = [number(TIMESTAMP, c * _STEP)]
        for b in range(0, len(own), LACED):
            block = own[b : b + LACED]
            body.append(element(SIMPLE_BLOCK, laced(block, lacing if len(block) > 1 else 0, 1, b * _STEP)))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * _STEP) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media, the Matroska file of each row's text."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(doc_id=batch.column("doc_id"), media=pa.array([write(padded(x)) for x in each_text(batch.column("text"))], pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, media binary")


def packets(media: DataFrame) -> DataFrame:
    """doc_id, packet, track, timestamp_ms, byte_start, byte_length and key_frame of each packet of a media column."""
    session(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            for i, data in enumerate(batch.column("media")):
                try:
                    found = parse(data.as_py() or b"").packets
                except (ValueError, IndexError):
                    continue
                rows += [(i, k, *p) for k, p in enumerate(found)]
            if rows:
                at, *columns = zip(*rows)
                names = ("packet", "track", "timestamp_ms", "byte_start", "byte_length", "key_frame")
                yield batch_of(doc_id=batch.column("doc_id").take(pa.array(at)), **{n: pa.array(c, pa.bool_() if n == "key_frame" else pa.int64()) for n, c in zip(names, columns)})

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, packet long, track long, timestamp_ms long, byte_start long, byte_length long, key_frame boolean")


def digest(media: DataFrame) -> DataFrame:
    """What the files of a media column hold, read back through their packets: sizes, digests and features."""
    session(media)

    def row(data: bytes) -> tuple:
        found = parse(data)
        payload = b"".join(data[o : o + n] for _, _, o, n, _ in sorted(found.packets))
        samples = np.frombuffer(payload, np.uint8).astype(np.int32)
        steps = np.abs(np.diff(samples))
        cued = sum(1 for _, _, c in found.cues if c in found.clusters)
        feature = f"codec={found.tracks[1]['codec']},packets={len(found.packets)},clusters={len(found.clusters)},cues={cued},ms={len(payload) * 1000 // RATE},sum={int(samples.sum())},steps={int(steps.sum())},crossings={int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))}"
        return len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        for batch in batches:
            columns = zip(*(row(x.as_py()) for x in batch.column("media"))) if batch.num_rows else [()] * 7
            yield batch_of(doc_id=batch.column("doc_id"), **{n: pa.array(c, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, c in zip(names, columns)})

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
