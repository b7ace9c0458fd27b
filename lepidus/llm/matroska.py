"""Operator 7: Matroska media columns.

``packets`` parses a column of Matroska bytes into a packet table.  EBML elements have an id and a size of variable length;
segments and clusters of unknown size end where an element of a higher level begins; SimpleBlocks and BlockGroups give
frames, taken apart by their lacing (none, Xiph, fixed, EBML); cues tell which clusters a seek can land on.  Byte ranges are
absolute, so a packet can be read without parsing again.

The tables have no media, so the query makes some of them: ``mux`` lays each document out as a file of one subtitle track,
whose packets are the text's lines, cut where they exceed ``FRAME`` bytes; every lacing and both kinds of block occur.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lepidus.llm import _text

FRAME = 400
PER_BLOCK = 6
PER_CLUSTER = 4  # blocks
TICK_MS = 40  # a frame's duration
EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY, CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE, DURATION, CUES, CUE, CUE_TIME, CUE_PLACE, CUE_CLUSTER, NUMBER, DEFAULT, CUE_TRACK = (
    0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF1, 0xD7, 0x23E383, 0xF7,
)
_TOP = {EBML, SEGMENT}
_LEVEL1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}
_WIDTH = [0] + [8 - (b.bit_length() - 1) for b in range(1, 256)]


class Malformed(ValueError):
    pass


def _id(b: bytes, at: int, end: int) -> tuple[int, int]:
    n = _WIDTH[b[at]]
    if not 1 <= n <= 4 or at + n > end:
        raise Malformed("id")
    return int.from_bytes(b[at : at + n], "big"), at + n


def vint(b: bytes, at: int, end: int) -> tuple[int | None, int]:
    """(value without its length marker, where it ends); None for the reserved value of all ones."""
    if at >= end:
        raise Malformed("size")
    n = _WIDTH[b[at]]
    if not n or at + n > end:
        raise Malformed("size")
    v = int.from_bytes(b[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if v == (1 << 7 * n) - 1 else v), at + n


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, content's start, content's end) of an element's children.  One of unknown size reaches to the next element that can't be its child."""
    while at < end:
        start = at
        kind, at = _id(b, at, end)
        size, at = vint(b, at, end)
        if size is None:
            stop = _unknown(b, kind, at, end)
        else:
            stop = at + size
            if stop > end:
                yield kind, start, at, -1  # cut short
                return
        yield kind, start, at, stop
        at = stop


def _unknown(b: bytes, kind: int, at: int, end: int) -> int:
    if kind not in (SEGMENT, CLUSTER):
        raise Malformed("unknown size")
    while at < end:
        child, p = _id(b, at, end)
        if child in _TOP or (kind == CLUSTER and child in _LEVEL1):
            return at
        size, p = vint(b, p, end)
        at = min(end, _unknown(b, child, p, end) if size is None else p + size)
    return end


def frames(b: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """A block's (track, relative time, flags, [(start, size)])."""
    track, at = vint(b, at, end)
    if track is None or at + 3 > end:
        raise Malformed("block")
    time, flags = struct.unpack_from(">hB", b, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, flags, [(at, end - at)]
    if at >= end:
        raise Malformed("lacing")
    n, sizes = b[at] + 1, []
    at += 1
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("lacing")
                size += b[at]
                at += 1
                if b[at - 1] < 255:
                    break
            sizes.append(size)
    elif lacing == 3:
        for k in range(n - 1):
            width = _WIDTH[b[at]] if at < end else 0
            v, at = vint(b, at, end)
            if v is None:
                v = (1 << 7 * width) - 1
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % n:
            raise Malformed("lacing")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("lacing")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, out


def parse(b: bytes) -> tuple[list[tuple], str | None]:
    """([(packet, track, timestamp in ns, keyframe, lacing, start, size, whether a cue points at its cluster)], what ended the parse early).

    Packets before a fault are kept.
    """
    out: list[tuple] = []
    cued: set[int] = set()
    where: list[int] = []
    fault = None

    def uint(a: int, z: int) -> int:
        return int.from_bytes(b[a:z], "big")

    def block(a: int, z: int, base: int, key: bool | None, scale: int, durations: dict[int, int], cluster: int) -> None:
        track, time, flags, fs = frames(b, a, z)
        key = bool(flags & 0x80) if key is None else key
        step = durations.get(track, 0)
        for k, (start, size) in enumerate(fs):
            out.append((len(out), track, (base + time) * scale + k * step, key, flags >> 1 & 3, start, size))
            where.append(cluster)

    try:
        segment = seen = False
        for kind, _, at, stop in elements(b, 0, len(b)):
            if kind == EBML:
                seen = True
            if kind != SEGMENT:
                continue
            segment = True
            short = stop < 0
            scale, durations, base0 = 1_000_000, {}, at
            for k1, s1, a1, z1 in elements(b, at, len(b) if short else stop):
                if z1 < 0:
                    short, z1 = True, len(b)
                if k1 == INFO:
                    for k2, _, a2, z2 in elements(b, a1, z1):
                        if k2 == SCALE:
                            scale = uint(a2, z2)
                elif k1 == TRACKS:
                    for k2, _, a2, z2 in elements(b, a1, z1):
                        if k2 == ENTRY:
                            e = {k3: uint(a3, z3) for k3, _, a3, z3 in elements(b, a2, z2) if k3 in (NUMBER, DEFAULT)}
                            durations[e.get(NUMBER, 0)] = e.get(DEFAULT, 0)
                elif k1 == CUES:
                    for k2, _, a2, z2 in elements(b, a1, z1):
                        if k2 == CUE:
                            for k3, _, a3, z3 in elements(b, a2, z2):
                                if k3 == CUE_PLACE:
                                    cued |= {base0 + uint(a4, z4) for k4, _, a4, z4 in elements(b, a3, z3) if k4 == CUE_CLUSTER}
                elif k1 == CLUSTER:
                    base = 0
                    for k2, _, a2, z2 in elements(b, a1, z1):
                        if z2 < 0:
                            short = True
                            break
                        if k2 == TIME:
                            base = uint(a2, z2)
                        elif k2 == SIMPLE:
                            block(a2, z2, base, None, scale, durations, s1)
                        elif k2 == GROUP:
                            inner = {k3: (a3, z3) for k3, _, a3, z3 in elements(b, a2, z2)}
                            if BLOCK in inner:
                                block(*inner[BLOCK], base, REFERENCE not in inner, scale, durations, s1)
            if short:
                raise Malformed("cut short")
        if not (segment and seen):
            raise Malformed("no Matroska header or segment")
    except Malformed as e:
        fault = str(e)
    except IndexError:
        fault = "cut short"
    return [(*p, w in cued) for p, w in zip(out, where)], fault


def _size(n: int) -> bytes:
    for w in range(1, 9):
        if n < (1 << 7 * w) - 1:
            return (n | 1 << 7 * w).to_bytes(w, "big")
    raise ValueError(n)


def _element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(kind: int, v: int) -> bytes:
    return _element(kind, v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big"))


def _laced(sizes: list[int], way: int) -> bytes:
    if way == 1:
        return bytes([len(sizes) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if way == 2:
        return bytes([len(sizes) - 1])
    head = bytes([len(sizes) - 1]) + _size(sizes[0])
    for a, z in zip(sizes[:-2], sizes[1:-1]):
        d = z - a
        w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
        head += (d + (1 << 7 * w - 1) - 1 | 1 << 7 * w).to_bytes(w, "big")
    return head


def cut(text: bytes, most: int = FRAME) -> list[bytes]:
    return [line[k : k + most] for line in re.split(rb"(?<=\n)", text) if line for k in range(0, len(line), most)]


def mux(text: bytes) -> bytes:
    """A Matroska file whose packets, in order, are the text's bytes."""
    head = _element(EBML, _number(0x4286, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(0x4D80, b"lepidus"))
    track = _element(ENTRY, _number(NUMBER, 1) + _number(0x73C5, 1) + _number(0x83, 17) + _number(DEFAULT, TICK_MS * 1_000_000) + _element(0x86, b"S_TEXT/UTF8"))
    body, cues, at, tick, n = [info, _element(TRACKS, track)], [], 0, 0, 0
    at = sum(map(len, body))
    all_ = cut(text)
    for c in range(0, len(all_), PER_BLOCK * PER_CLUSTER):
        base, inner = tick, [_number(TIME, tick * TICK_MS)]
        for k in range(c, min(c + PER_BLOCK * PER_CLUSTER, len(all_)), PER_BLOCK):
            fs = all_[k : k + PER_BLOCK]
            way = 0 if len(fs) == 1 else 2 if len({*map(len, fs)}) == 1 else 1 + 2 * (n % 2)
            data = b"\x81" + struct.pack(">hB", (tick - base) * TICK_MS, way << 1 | (0x80 if n % 3 else 0)) + (_laced([*map(len, fs)], way) if way else b"") + b"".join(fs)
            inner.append(_element(SIMPLE, data) if n % 3 else _element(GROUP, _element(BLOCK, data) + _number(DURATION, TICK_MS * len(fs))))
            tick += len(fs)
            n += 1
        content = b"".join(inner)
        cues.append(_element(CUE, _number(CUE_TIME, base * TICK_MS) + _element(CUE_PLACE, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        # every other cluster is of unknown size
        body.append(CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + content if len(cues) % 2 else _element(CLUSTER, content))
        at += len(body[-1])
    if cues:
        body.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(body))


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every row: its text as a Matroska file; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, at in _text.slices(batches, "text"):
            raw, null = data.tobytes(), b.column(1).is_null().to_pylist()
            made = [None if null[k] else mux(raw[at[k] : at[k + 1]]) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


_NAMES = ["packet", "track", "timestamp_ns", "keyframe", "lacing", "start", "size", "cued"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]


def packets(files: DataFrame) -> DataFrame:
    """(doc_id, packet, track, timestamp_ns, keyframe, lacing, start, size, cued, fault) of (doc_id, media).

    A null or empty column has no packets; of bytes that are cut short or not Matroska, packets before the fault are given
    and a last row has only the fault.  Zero-size frames are packets.  A null doc_id stays null; repeated rows give repeated
    packets; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids, rows, faults = [], [], []
                for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not m:
                        continue
                    got, fault = parse(m)
                    rows += got
                    ids += [i] * len(got)
                    faults += [None] * len(got)
                    if fault:
                        rows.append((None,) * 8)
                        ids.append(i)
                        faults.append(fault)
                columns = [*zip(*rows)] or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _TYPES)), pa.array(faults, pa.string())], names=["doc_id", *_NAMES, "fault"])

    return files.select("doc_id", "media").mapInArrow(run, "doc_id long, packet int, track int, timestamp_ns long, keyframe boolean, lacing int, start long, size long, cued boolean, fault string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of every document, each laid out as a Matroska file and parsed again."""
    return packets(media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
