"""Media columns: Matroska files in a binary column.

``mux`` stores bytes as 8-bit PCM samples in Matroska files; ``demux`` parses any
Matroska file (variable-length EBML elements, elements of unknown size, clusters,
SimpleBlocks and BlockGroups, all four lacings, cues) into packet tables with
track, timestamp, flags and byte range. All of it is row-local: no shuffle, and
no more than a few MB of files in a task's Python at once.

Cases: a null payload is empty, and an empty one is padded to one frame of 576
bytes; repeated rows give equal files; an empty table gives an empty table; a
null file, or one that breaks off, gives the packets in front of the fault, with
the fault named in ``error``; other columns are kept by ``mux``, of which one
that is called ``media`` is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import batch, pieces, unused, utf8

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE  # 72, whole
LACED, PER_CLUSTER = 8, 32  # frames in a block, blocks in a cluster: block times, relative to the cluster, have 16 bits

#: Element ids of the format.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, LACING, AUDIO, RATE_HZ, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION, MAX_ID, MAX_SIZE = 0x4282, 0x4287, 0x4285, 0x42F2, 0x42F3
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

PACKET = T.StructType([
    T.StructField("track", T.LongType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("keyframe", T.BooleanType()), T.StructField("lacing", T.IntegerType()), T.StructField("cluster_offset", T.LongType()),
])
CUE = T.StructType([T.StructField("timestamp_ns", T.LongType()), T.StructField("track", T.LongType()), T.StructField("cluster_offset", T.LongType())])


def number(n: int, size: int = 0) -> bytes:
    """A variable-length size; all ones are kept for an unknown size."""
    size = size or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """What follows the header of a block."""
    if kind == NO_LACING:
        return b"".join(frames)
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            k = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += number(b - a + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(frames)


HEAD = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8))
TRACK = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE_HZ, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % FRAME or FRAME * (not payload))


def to_matroska(samples: bytes) -> bytes:
    """A file of one PCM track; blocks take the three lacings in turn, the last one of a cluster is a BlockGroup."""
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    body = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + element(MUXING_APP, b"lectern") + element(WRITING_APP, b"lectern")), TRACK]
    at, cues = sum(map(len, body)), []
    step = LACED * PER_CLUSTER
    for first in range(0, len(frames), step):
        blocks = [uint(CLUSTER_TIME, first * FRAME_MS)]
        end = min(first + step, len(frames))
        for j in range(first, end, LACED):
            laced = frames[j : min(j + LACED, end)]
            kind = (XIPH, FIXED, EBML_LACING)[j // LACED % 3] if len(laced) > 1 else NO_LACING
            head = number(1) + struct.pack(">h", (j - first) * FRAME_MS)
            if j + LACED >= end:
                blocks.append(element(BLOCK_GROUP, element(BLOCK, head + bytes([kind << 1]) + lace(laced, kind)) + uint(BLOCK_DURATION, len(laced) * FRAME_MS)))
            else:
                blocks.append(element(SIMPLE_BLOCK, head + bytes([0x80 | kind << 1]) + lace(laced, kind)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(body))


class Fault(Exception):
    pass


class Reader:
    """Packets and cues of one file."""

    def __init__(self, data: bytes):
        self.data, self.packets, self.cues, self.error = data, [], [], None
        self.scale, self.durations, self.base, self.place = 1_000_000, {}, 0, 0
        try:
            at = 0
            while at < len(data):
                ident, start, end = self.header(at, len(data))
                if ident == SEGMENT:
                    self.base = start
                    self.segment(start, end)
                at = end
        except (Fault, IndexError, struct.error) as e:
            self.error = str(e) or type(e).__name__

    def vint(self, at: int, limit: int, keep: bool = False) -> tuple[int, int, bool]:
        """(value, place behind it, whether all its bits are ones)."""
        if at >= limit:
            raise Fault(f"the file ends at {at}")
        size = 9 - self.data[at].bit_length()
        if size > 8 or at + size > limit:
            raise Fault(f"no number at {at}")
        n = int.from_bytes(self.data[at : at + size], "big")
        plain = n & (1 << 7 * size) - 1
        return n if keep else plain, at + size, plain == (1 << 7 * size) - 1

    def header(self, at: int, limit: int) -> tuple[int, int, int]:
        ident, at, _ = self.vint(at, limit, keep=True)
        size, at, unknown = self.vint(at, limit)
        if unknown:
            return ident, at, self.until(ident, at, limit)
        if at + size > limit:
            raise Fault(f"element {ident:X} at {at} passes its parent's end")
        return ident, at, at + size

    def until(self, ident: int, at: int, limit: int) -> int:
        """End of an element of unknown size: the next one of its level or above."""
        stop = {EBML, SEGMENT} if ident == SEGMENT else TOP | {EBML, SEGMENT}
        while at < limit:
            try:
                if self.vint(at, limit, keep=True)[0] in stop:
                    return at
                at = self.header(at, limit)[2]
            except Fault:  # named again where it is met as an element of its own
                return at
        return limit

    def children(self, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        while start < end:
            self.place = start  # of the element that is handed out
            ident, body, start = self.header(start, end)
            yield ident, body, start

    def uint(self, start: int, end: int) -> int:
        return int.from_bytes(self.data[start:end], "big")

    def segment(self, start: int, end: int) -> None:
        for ident, a, b in self.children(start, end):
            if ident == INFO:
                self.scale = next((self.uint(x, y) for i, x, y in self.children(a, b) if i == TIMESTAMP_SCALE), self.scale)
            elif ident == TRACKS:
                for _, x, y in self.children(a, b):
                    entry = {i: (p, q) for i, p, q in self.children(x, y)}
                    track = self.uint(*entry[TRACK_NUMBER]) if TRACK_NUMBER in entry else 0
                    if 0x23E383 in entry:  # default duration
                        self.durations[track] = self.uint(*entry[0x23E383])
                    elif self.data[slice(*entry.get(CODEC_ID, (0, 0)))].startswith(b"A_PCM/INT") and AUDIO in entry:
                        audio = {i: (p, q) for i, p, q in self.children(*entry[AUDIO])}
                        rate = self.data[slice(*audio[RATE_HZ])] if RATE_HZ in audio else b""
                        rate = struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0] if rate else 8000.0
                        depth = self.uint(*audio[BIT_DEPTH]) if BIT_DEPTH in audio else 8
                        width = depth // 8 * (self.uint(*audio[CHANNELS]) if CHANNELS in audio else 1)
                        self.durations[track] = (width, rate)
            elif ident == CLUSTER:
                self.cluster(a, b)
            elif ident == CUES:
                for _, x, y in self.children(a, b):
                    time = 0
                    for i, p, q in self.children(x, y):
                        if i == CUE_TIME:
                            time = self.uint(p, q)
                        elif i == CUE_POSITIONS:
                            where = {k: self.uint(u, v) for k, u, v in self.children(p, q)}
                            self.cues.append((time * self.scale, where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER, 0) + self.base))

    def cluster(self, start: int, end: int) -> None:
        time, place = 0, self.place
        for ident, a, b in self.children(start, end):
            if ident == CLUSTER_TIME:
                time = self.uint(a, b)
            elif ident == SIMPLE_BLOCK:
                self.block(a, b, time, place, None)
            elif ident == BLOCK_GROUP:
                parts = {i: (x, y) for i, x, y in self.children(a, b)}
                if BLOCK in parts:
                    self.block(*parts[BLOCK], time, place, REFERENCE not in parts)

    def block(self, start: int, end: int, time: int, place: int, key: bool | None) -> None:
        track, at, _ = self.vint(start, end)
        relative, flags = struct.unpack_from(">hB", self.data, at)
        at, kind = at + 3, flags >> 1 & 3
        sizes = []
        if kind:
            count, at = self.data[at] + 1, at + 1
            if kind == XIPH:
                for _ in range(count - 1):
                    n = 0
                    while self.data[at] == 255:
                        n, at = n + 255, at + 1
                    sizes.append(n + self.data[at])
                    at += 1
            elif kind == EBML_LACING and count > 1:
                n, at, _ = self.vint(at, end)
                sizes.append(n)
                for _ in range(count - 2):
                    was = at
                    n, at, _ = self.vint(at, end)
                    sizes.append(sizes[-1] + n - ((1 << 7 * (at - was) - 1) - 1))
            elif kind == FIXED:
                sizes = [(end - at) // count] * (count - 1)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Fault(f"the lacing at {start} passes its block's end")
        stamp, duration = (time + relative) * self.scale, self.durations.get(track)
        for n in sizes:
            self.packets.append((track, stamp, at, n, bool(flags & 0x80) if key is None else key, kind, place))
            at += n
            stamp += round(n // duration[0] * 1e9 / duration[1]) if isinstance(duration, tuple) and duration[0] else duration if isinstance(duration, int) else 0

    def payload(self, track: int = 1) -> bytes:
        return b"".join(self.data[p[2] : p[2] + p[3]] for p in self.packets if p[0] == track)


def mux(df: DataFrame, payload: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns, if None) and a binary column with the Matroska file of a text's or binary column's bytes."""
    kept = [c for c in (df.columns if keep is None else keep) if c != media]
    own = unused("payload", [*kept, media])
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(media, T.BinaryType())])
    raw = utf8(payload) if isinstance(df.schema[payload].dataType, T.StringType) else F.coalesce(F.col(payload), F.lit(b""))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, own):
            files = [to_matroska(padded(b)) for b in piece.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(files, pa.binary())], names=[*kept, media])

    return df.select(*kept, raw.alias(own)).mapInArrow(write, schema)


def demux(df: DataFrame, media: str = "media", keys: list[str] | None = None) -> DataFrame:
    """keys, packets array, cues array, error of each file; ``packets`` and ``cues`` explode it.

    Keys with the names of results are left out, as in ``packets`` and ``cues``.
    """
    keys = [c for c in (df.columns if keys is None else keys) if c != media and c.lower() not in ("packets", "cues", "error")]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("packets", T.ArrayType(PACKET)), T.StructField("cues", T.ArrayType(CUE)), T.StructField("error", T.StringType())])
    packet_type = pa.list_(pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster_offset", pa.int64())]))
    cue_type = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("track", pa.int64()), ("cluster_offset", pa.int64())]))
    names, cue_names = [f.name for f in PACKET], [f.name for f in CUE]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, media):
            found = [Reader(b or b"") for b in piece.column(media).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *(piece.column(k) for k in keys), pa.array([[dict(zip(names, p, strict=True)) for p in r.packets] for r in found], packet_type),
                pa.array([[dict(zip(cue_names, c, strict=True)) for c in r.cues] for r in found], cue_type), pa.array([r.error for r in found], pa.string()),
            ], names=[*keys, "packets", "cues", "error"])

    return df.select(*keys, media).mapInArrow(parse, schema)


def packets(df: DataFrame, media: str = "media", keys: list[str] | None = None) -> DataFrame:
    """The packet table: one row per frame with its byte range in the file."""
    return _exploded(demux(df, media, keys), F.posexplode("packets").alias("packet", "row"), ["packet", *PACKET.names])


def cues(df: DataFrame, media: str = "media", keys: list[str] | None = None) -> DataFrame:
    return _exploded(demux(df, media, keys), F.posexplode("cues").alias("cue", "row"), CUE.names)


def _exploded(found: DataFrame, explode: Column, names: list[str]) -> DataFrame:
    keys = [c for c in found.columns if c not in ("packets", "cues", "error")]
    rows = found.select(F.struct(*[F.col(f"`{c}`") for c in keys], F.lit(1).alias(unused("none", keys))).alias("given"), explode)
    kept = [F.col(f"given.`{c}`").alias(c) for c in keys if c.lower() not in names]
    return rows.select(*kept, *[F.col(n) if n == "packet" else F.col(f"row.{n}") for n in names])


def feature(reader: Reader, payload: bytes) -> str:
    """Counts of packets by lacing, clusters, cues that meet a cluster, milliseconds, mean and standard deviation of samples."""
    lacing = np.bincount([p[5] for p in reader.packets], minlength=4)
    places = {p[6] for p in reader.packets}
    samples = np.frombuffer(payload, np.uint8)
    last = max((p[1] for p in reader.packets), default=0) // 1_000_000
    return f"packets={len(reader.packets)};lacing={'/'.join(map(str, lacing))};clusters={len(places)};cued={sum(c[2] in places for c in reader.cues)};last_ms={last};mean={samples.mean():.4f};sd={samples.std():.4f}"


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back and describe both."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "media"):
            out = []
            for data in piece.column("media").to_pylist():
                r = Reader(data)
                if r.error:
                    raise ValueError(r.error)
                p = r.payload()
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(r, p)))
            columns = list(zip(*out, strict=True))
            yield batch({
                key: (piece.column(key), None), "n_bytes": (piece.column("n_bytes"), None), "payload_bytes": (columns[0], pa.int64()), "payload_sha256": (columns[1], pa.string()), "tail_crc32": (columns[2], pa.int64()),
                "media_bytes": (columns[3], pa.int64()), "media_sha256": (columns[4], pa.string()), "feature": (columns[5], pa.string()),
            })

    rows = df.select(F.col(key).cast("long").alias(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    return mux(rows, text, keep=[key, "n_bytes"]).mapInArrow(read, f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
