"""Operator 7: Matroska media columns, written and parsed element by element.

The parser reads EBML's variable-length numbers and elements, clusters (of
known or unknown size), simple blocks and block groups with each kind of
lacing, and cues, into a packet table: track, timestamp, byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import modest, quoted, table, written

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, ENTRY, NUMBER, KIND, CODEC, AUDIO = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0xE1
TIME, BLOCK, GROUP, INNER, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster of unknown size.
LEVEL_ONE = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NONE, XIPH, FIXED, EBML_LACING = range(4)
FRAME, RATE = 576, 8000


class Malformed(ValueError):
    """The bytes are not the Matroska structure that they begin."""


def number(raw, at: int, marker: bool = False) -> tuple[int, int]:
    """The variable-length number at ``at`` and where it ends; an identifier keeps its ``marker``.

    A size of all ones is unknown: -1.
    """
    if at >= len(raw) or not raw[at]:
        raise Malformed(f"no number at byte {at}")
    size = 9 - raw[at].bit_length()
    if at + size > len(raw):
        raise Malformed(f"number cut short at byte {at}")
    value = int.from_bytes(raw[at : at + size], "big")
    if marker:
        return value, at + size
    value &= (1 << 7 * size) - 1
    return (-1 if value == (1 << 7 * size) - 1 else value), at + size


def coded(value: int, size: int = 0) -> bytes:
    """``value`` as a variable-length number, of ``size`` bytes or the fewest."""
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + coded(len(body)) + body


def integer(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


@dataclass
class Media:
    """A parsed file: tracks, packets (track, timestamp in ns, start, size, key) and cues."""

    durations: dict[int, int] = field(default_factory=dict)  # ns a frame, of tracks that state it
    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # position in the segment, time in ns
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, cluster position
    blocks: int = 0
    scale: int = 1_000_000


def elements(raw, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Identifier, start and end of each element's body; an unknown size reaches to ``end``."""
    while at < end:
        ident, at = number(raw, at, True)
        size, at = number(raw, at)
        stop = end if size < 0 else at + size
        if stop > end:
            raise Malformed(f"element {ident:X} runs past its parent at byte {at}")
        yield ident, at, stop
        at = stop


def value(raw, at: int, end: int) -> int:
    return int.from_bytes(raw[at:end], "big")


def laces(raw, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Start and size of each frame of a block's body."""
    if lacing == NONE:
        return [(at, end - at)]
    if at >= end:
        raise Malformed("lacing without frames")
    n, at = raw[at] + 1, at + 1
    if lacing == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise Malformed("frames of unequal size in fixed lacing")
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while at < end and raw[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise Malformed("lace sizes cut short")
                size, at = size + raw[at], at + 1
            else:
                start = at
                size, at = number(raw, at)
                if k:
                    size = sizes[-1] + size - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Malformed("lace sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(raw, at: int, end: int, media: Media, time: int, key: bool | None, lasting: int = 0) -> None:
    """The packets of one block.  A lace's frames follow each other by the track's default duration, or
    by equal shares of what the block lasts (``lasting``); where neither is stated they share its timestamp."""
    track, at = number(raw, at)
    if at + 3 > end:
        raise Malformed("block cut short")
    offset, flags = struct.unpack_from(">hB", raw, at)
    stamp = (time + offset) * media.scale
    key = bool(flags & 0x80) if key is None else key
    media.blocks += 1
    frames = laces(raw, at + 3, end, flags >> 1 & 3)
    each = media.durations.get(track) or lasting * media.scale // len(frames)
    media.packets += [(track, stamp + k * each, a, n, key) for k, (a, n) in enumerate(frames)]


def _cluster(raw, at: int, end: int, media: Media, base: int, start: int) -> int:
    """Parses a cluster's body; returns where it ends, which for an unknown size is the next top element."""
    time, place = 0, len(media.clusters)
    media.clusters.append((start - base, 0))
    while at < end:
        ident, body = number(raw, at, True)
        if ident in LEVEL_ONE:
            return at
        size, body = number(raw, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise Malformed(f"element {ident:X} runs past its cluster at byte {at}")
        if ident == TIME:
            time = value(raw, body, stop)
            media.clusters[place] = (start - base, time * media.scale)
        elif ident == BLOCK:
            _block(raw, body, stop, media, time, None)
        elif ident == GROUP:
            parts = list(elements(raw, body, stop))
            key = all(i != REFERENCE for i, _, _ in parts)
            lasting = next((value(raw, a, b) for i, a, b in parts if i == BLOCK_DURATION), 0)
            for i, a, b in parts:
                if i == INNER:
                    _block(raw, a, b, media, time, key, lasting)
        at = stop
    return at


def parse(raw: bytes) -> Media:
    """The packet table and cues of a Matroska file.  Raises :class:`Malformed`."""
    media, at = Media(), 0
    found = False
    ident, body = number(raw, 0, True)
    if ident != EBML:
        raise Malformed("no EBML header")
    size, body = number(raw, body)
    at = body + size
    while at < len(raw):
        ident, body = number(raw, at, True)
        size, body = number(raw, body)
        end = len(raw) if size < 0 else body + size
        if end > len(raw):
            raise Malformed("segment cut short")
        if ident == SEGMENT:
            found = True
            _segment(raw, body, end, media)
        at = end
    if not found:
        raise Malformed("no segment")
    return media


def _segment(raw, base: int, end: int, media: Media) -> None:
    at = base
    while at < end:
        start = at
        ident, body = number(raw, at, True)
        size, body = number(raw, body)
        stop = end if size < 0 else body + size
        if stop > end:
            raise Malformed(f"element {ident:X} runs past the segment")
        if ident == INFO:
            media.scale = next((value(raw, a, b) for i, a, b in elements(raw, body, stop) if i == SCALE), media.scale)
        elif ident == TRACKS:
            for i, a, b in elements(raw, body, stop):
                if i == ENTRY:
                    parts = {k: (x, y) for k, x, y in elements(raw, a, b)}
                    if NUMBER not in parts:
                        raise Malformed("a track without a number")
                    codec = raw[slice(*parts[CODEC])].decode() if CODEC in parts else ""
                    media.tracks[value(raw, *parts[NUMBER])] = codec
                    if DEFAULT_DURATION in parts:
                        media.durations[value(raw, *parts[NUMBER])] = value(raw, *parts[DEFAULT_DURATION])
        elif ident == CLUSTER:
            stop = _cluster(raw, body, stop, media, base, start)
        elif ident == CUES:
            for i, a, b in elements(raw, body, stop):
                if i != POINT:
                    continue
                time, places = 0, []
                for k, x, y in elements(raw, a, b):
                    if k == CUE_TIME:
                        time = value(raw, x, y) * media.scale
                    elif k == CUE_AT:
                        own = {m: value(raw, p, q) for m, p, q in elements(raw, x, y)}
                        places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0)))
                media.cues += [(time, *p) for p in places]
        at = stop


def _header(frame: int) -> tuple[bytes, bytes]:
    head = element(EBML, integer(0x4286, 1) + integer(0x42F7, 1) + integer(0x42F2, 4) + integer(0x42F3, 8)
                   + element(0x4282, b"matroska") + integer(0x4287, 4) + integer(0x4285, 2))
    info = element(INFO, integer(SCALE, 1_000_000) + element(0x4D80, b"inkspan") + element(0x5741, b"inkspan"))
    audio = element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + integer(0x9F, 1) + integer(0x6264, 8))
    track = integer(NUMBER, 1) + integer(0x73C5, 1) + integer(KIND, 2) + integer(0x9C, 1) + integer(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio
    return head, info + element(TRACKS, element(ENTRY, track))


_HEAD, _TOP = _header(FRAME)


def mux(payload: bytes, frame: int = FRAME, laced: int = 8, in_cluster: int = 256, lacing: int = FIXED) -> bytes:
    """One 8-bit mono PCM track: frames of ``frame`` samples, ``laced`` to a block, clusters with cues.

    ``payload`` is cut every ``frame`` bytes; the last frame may be shorter
    (not with fixed lacing).  In one file every cluster has its cue.
    """
    top = _TOP if frame == FRAME else _header(frame)[1]
    body, cues = [top], []
    at = len(top)
    for c in range(0, len(payload), frame * in_cluster):
        time = c * 1000 // RATE
        parts = [integer(TIME, time)]
        end = min(len(payload), c + frame * in_cluster)
        for b in range(c, end, frame * laced):
            data = payload[b : min(end, b + frame * laced)]
            sizes = [min(frame, len(data) - i) for i in range(0, len(data), frame)]
            kind = lacing if len(sizes) > 1 else NONE
            lace = b""
            if kind:
                lace = bytes([len(sizes) - 1])
            if kind == XIPH:
                lace += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
            elif kind == EBML_LACING:
                lace += coded(sizes[0]) + b"".join(coded(s - p + 8191, 2) for p, s in zip(sizes, sizes[1:-1]))
            parts.append(element(BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | kind << 1) + lace + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(POINT, integer(CUE_TIME, time) + element(CUE_AT, integer(CUE_TRACK, 1) + integer(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


def track_bytes(raw: bytes, media: Media, track: int = 1) -> bytes:
    """A track's packets, one after another."""
    return b"".join([raw[a : a + n] for t, _, a, n, _ in media.packets if t == track])


def features(samples: bytes, media: Media) -> str:
    """Packets, blocks, clusters, cues that point at their cluster, milliseconds, where the last packet
    starts, mean, deviation, crossings of the middle."""
    x = np.frombuffer(samples, np.uint8)
    at = dict(media.clusters)
    good = sum(at.get(place) == time for time, _, place in media.cues)
    total, square = int(x.sum(dtype=np.int64)), int(np.einsum("i,i", x, x, dtype=np.int64))
    n = max(len(x), 1)
    high = x > 127
    return (
        f"packets={len(media.packets)};blocks={media.blocks};clusters={len(media.clusters)};cues={good};"
        f"ms={len(x) * 1000 // RATE};last={max((p[1] for p in media.packets), default=0) // 1_000_000};mean={total / n:.6f};deviation={max(square / n - (total / n) ** 2, 0) ** 0.5:.6f};"
        f"crossings={int((high[1:] != high[:-1]).sum())}"
    )


def padded(text: bytes, frame: int = FRAME) -> bytes:
    """``text`` with bytes 255 after it, to a positive multiple of ``frame``."""
    return text + b"\xff" * (max(1, -(-len(text) // frame)) * frame - len(text))


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media``, the padded UTF-8 of ``text`` (null and empty: one frame of bytes 255) as a Matroska file.

    A column of that name, whatever its letters' case, is replaced; other
    columns stay; repeated rows repeat, equal texts giving equal files; an
    empty table gives no rows; a text of any length makes one file, held by
    one task, and must fit a cell (2 GB).
    """
    keep = [c for c in docs.columns if c.lower() != media.lower()]
    rows = modest(docs).select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column(batch.num_columns - 1))
            for i, j in W.slices(off):
                files = [mux(padded(data[a:b].tobytes())) for a, b in zip(off[i:j], off[i + 1 : j + 1])]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], pa.array(files, pa.binary())], names=[*batch.schema.names[:-1], "media"])

    return rows.mapInArrow(run, kinds + "media binary").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("media").alias(media))


def packet_table(files: DataFrame, ident: str, media: str = "media") -> DataFrame:
    """``(ident, packet, track, timestamp_ns, start, size, keyframe, error)``: a row for each packet.

    A null or empty file has no rows; a malformed one has one row with its
    ``error`` and nulls; repeated rows repeat; other columns are not looked at.
    """
    rows = files.select(F.col(quoted(ident)).alias("ident"), F.col(quoted(media)).alias("media")).filter(F.length("media") > 0)
    kind = files.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    out = [(k, *p, None) for k, p in enumerate(parse(batch.column(1)[i].as_py()).packets)]
                except (Malformed, UnicodeDecodeError) as e:
                    out = [(None,) * 6 + (str(e),)]
                cols = list(zip(*out)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                own = batch.column(0).slice(i, 1).take(pa.array([0] * len(out), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                                 names=["ident", "packet", "track", "timestamp_ns", "start", "size", "keyframe", "error"])

    out = rows.mapInArrow(run, f"ident {kind}, packet long, track long, timestamp_ns long, start long, size long, keyframe boolean, error string")
    return out.withColumnRenamed("ident", ident)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).to_pylist()
        out = []
        for n, raw in zip(sizes, (x.as_py() for x in batch.column(2))):
            media = parse(raw)
            payload = track_bytes(raw, media)
            out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload, media)))
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                         names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n", F.octet_length("text").cast("long"))
    stored = written(media_column(docs).select("doc_id", "n", "media"))
    return stored.mapInArrow(_digested, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                             "media_bytes long, media_sha256 string, feature string")
